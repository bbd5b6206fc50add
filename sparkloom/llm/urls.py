"""URL filters: allow and block rules by host suffix and path prefix, then a path-template tree learned from labels.

Only DataFrame functions run here.  A path is cut into segments, digits count as ``{n}``.  Per host, from fork to fork down
to the deepest segment with support: a segment that SUPPORT urls take is a branch of its own, however many siblings it has;
the others together are the wildcard ``*`` (a literal ``*`` is written ``%2A``), if SUPPORT urls take one of them.  A branch
merges into its parent, and pools its counts there, if its labelled rate is statistically similar to that of the rest of
its parent's urls (two proportions, SIMILAR standard errors; without labels on either side nothing tells them apart).  What
does not merge is a template: its pooled rate of bad labels is smoothed towards the template above it, a host's towards the
whole corpus.  A template whose smoothed rate reaches REJECT is blocked, with all urls whose branches merged into it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textcore import materialize, pick, release

SUPPORT = 5  #: urls that a branch of its own needs
SMOOTHING = 10.0  #: labels that the parent's rate weighs
SIMILAR = 1.96  #: standard errors of a difference below which a branch merges into its parent
REJECT = 0.5

#: Verdict and rule, of which the longest that fits wins.
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path. Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: then up to
    ``?``, ``#`` or the end. A null, or a url without ``://``, gives two empty strings."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest.substr(F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, else nulls. A rule holds for its host and all subdomains, if the path begins with its path."""
    rule = verdict = F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: len(r[1])):
        of_host, slash, of_path = text.partition("/")
        fits = ((host == of_host) | host.endswith("." + of_host)) & path.startswith(slash + of_path)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def _shape(path: Column) -> Column:
    """The path without slashes around it, digits as {n}."""
    return F.rtrim(F.ltrim(F.regexp_replace(path, "[0-9]+", "{n}"), F.lit("/")), F.lit("/"))


def _apart(lab: Column, bad: Column) -> Column:
    """Whether a branch stands apart from the rest of its parent's urls (all_lab, all_bad hold the branch's own, too)."""
    l1, b1 = lab, bad
    l2, b2 = F.col("all_lab") - l1, F.col("all_bad") - b1
    p = F.col("all_bad") / F.col("all_lab")
    error = F.sqrt(F.greatest(p * (1 - p), F.lit(1e-4)) * (1 / l1 + 1 / l2))
    return F.when((l1 == 0) | (l2 == 0), False).otherwise(F.abs(b1 / l1 - b2 / l2) >= SIMILAR * error)


def grow(shapes: DataFrame) -> DataFrame:
    """host, shape, lab, bad, and chain of each shape (host, shape, n, lab, bad): the nodes on its way down that stand apart
    from their parents, by name and from the host's on, which is empty. The last one owns the shape.

    One round for each fork on a path, however long it is: what all urls of a node have in common is one step, as nodes
    with the same urls cannot differ. A node whose labels agree grows no further, since all below it would merge into it.
    """
    sums = [F.sum(c).alias(c) for c in ("n", "lab", "bad")]
    divided = lambda n, lab, bad: (F.col(n) >= SUPPORT) & (F.col(bad) > 0) & (F.col(bad) < F.col(lab))
    hosts = shapes.groupBy("host").agg(*[F.sum(c).alias(f"all_{c}") for c in ("n", "lab", "bad")])
    segments = F.when(F.col("shape") != "", F.split(F.replace("shape", F.lit("*"), F.lit("%2A")), "/")).otherwise(F.expr("cast(array() AS array<string>)"))
    placed = shapes.join(hosts, "host").select(*shapes.columns, segments.alias("rest"), F.lit("").alias("t"), F.array(F.lit("")).alias("chain"), "all_lab", "all_bad", divided("all_n", "all_lab", "all_bad").alias("open"))
    rounds, scratch = [materialize(placed)], []
    while (active := rounds[-1].where("open")).limit(1).count():
        # what the least and the greatest of a node's paths share, all share
        ends = active.groupBy("host", "t").agg(F.min("rest").alias("lo"), F.max("rest").alias("hi"))
        parting = F.array_position(F.zip_with("lo", "hi", lambda a, b: a.eqNullSafe(b)), F.lit(False)).cast("int")
        ends = ends.withColumn("m", F.when(parting == 0, F.size("lo")).otherwise(parting - 1))
        way = F.when(F.col("m") > 0, F.concat(F.lit("/"), F.array_join(F.slice("lo", F.lit(1), F.col("m")), "/"))).otherwise("")
        # s: the segment behind what is shared, null where the path ends
        here = active.join(ends.select("host", "t", "m", way.alias("way")), ["host", "t"]).withColumn("s", F.get("rest", F.col("m")))
        named = here.where("s IS NOT NULL").groupBy("host", "t", "way", "s").agg(*sums).withColumn("u", F.when(F.col("n") >= SUPPORT, F.col("s")).otherwise("*"))
        named = materialize(named)
        kids = named.groupBy("host", "t", "way", "u").agg(*sums).where(F.col("n") >= SUPPORT)
        kids = kids.select("host", "t", "u", F.concat("t", "way", F.lit("/"), "u").alias("kid"), divided("n", "lab", "bad").alias("opens"), F.col("lab").alias("kid_lab"), F.col("bad").alias("kid_bad"))
        kids = named.select("host", "t", "s", "u").join(kids, ["host", "t", "u"]).drop("u")
        out = here.drop("open").join(kids, ["host", "t", "s"], "left")
        apart = F.col("kid").isNotNull() & _apart(F.col("kid_lab"), F.col("kid_bad"))
        out = out.select(
            *shapes.columns,
            F.slice("rest", F.col("m") + 2, F.greatest(F.size("rest") - F.col("m") - 1, F.lit(0))).alias("rest"),
            F.coalesce("kid", "t").alias("t"),
            F.when(apart, F.concat("chain", F.array("kid"))).otherwise(F.col("chain")).alias("chain"),
            F.coalesce("kid_lab", "all_lab").alias("all_lab"),
            F.coalesce("kid_bad", "all_bad").alias("all_bad"),
            F.coalesce("opens", F.lit(False)).alias("open"),
        )
        rounds.append(materialize(out))
        scratch.append(named)
    settled = rounds[0].where("NOT open")
    for r in rounds[1:]:
        settled = settled.union(r.where("NOT open"))
    settled = materialize(settled.select("host", "shape", "lab", "bad", "chain"))
    release(*rounds, *scratch)
    return settled


def fit_templates(pages: DataFrame) -> DataFrame:
    """The templates that are rejected. pages: host, shape (of the path), bad (1, 0 or null where there is no label).

    Returns host, shape (those that belong to rejected templates) and template. No labels: none.
    """
    shapes = materialize(pages.groupBy("host", "shape").agg(F.count("*").alias("n"), F.count("bad").alias("lab"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")))
    total = shapes.agg(F.sum("lab").alias("lab"), F.sum("bad").alias("bad")).first()
    if not total.lab:
        return shapes.where("false").select("host", "shape", F.col("host").alias("template"))
    overall = (total.bad + 0.5) / (total.lab + 1.0)
    settled = grow(shapes)
    release(shapes)
    pooled = materialize(settled.groupBy("host", "chain").agg(F.sum("lab").alias("lab"), F.sum("bad").alias("bad")))
    own = pooled.select("host", F.element_at("chain", -1).alias("p"), "lab", "bad")
    steps = pooled.select("host", "chain", F.posexplode("chain").alias("k", "p")).join(own, ["host", "p"], "left")
    steps = steps.groupBy("host", "chain").agg(F.array_sort(F.collect_list(F.struct("k", F.coalesce("lab", F.lit(0)).alias("lab"), F.coalesce("bad", F.lit(0)).alias("bad")))).alias("steps"))
    rate = F.aggregate("steps", F.lit(overall), lambda above, x: (x["bad"] + SMOOTHING * above) / (x["lab"] + SMOOTHING))
    blocked = steps.where(rate >= REJECT).select("host", "chain", F.concat("host", F.element_at("chain", -1)).alias("template"))
    rejected = materialize(settled.join(blocked, ["host", "chain"]).select("host", "shape", "template"))
    release(settled, pooled)
    return rejected


def judge(pages: DataFrame, labels: DataFrame | None = None, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, template (of a rejection by the tree) for every row of pages (page_id, url).

    Labels for the tree: a rule's verdict where one fits; else, if labels (doc_id, quality) is given, the quality of
    the document whose number the path's last segment begins with. Urls without host are judged like any other, all
    under the empty host. Repeated rows each get their row; null page_ids stay null.
    """
    host, path = split_url(F.col("url"))
    rows = pick(pages, "page_id", "url").select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"), _shape(F.col("path")).alias("shape"))
    rows = materialize(rows)
    bad = F.when(F.col("ruled") == "block", 1).when(F.col("ruled") == "allow", 0)
    evidence = rows.select("host", "shape", bad.alias("bad"))
    if labels is not None:
        number = F.expr("try_cast(regexp_extract(path, '/([0-9]+)[^/]*/?$', 1) AS bigint)")
        quality = pick(labels, "doc_id", "quality").toDF("number", "quality").where("quality IN (0, 1) AND number IS NOT NULL").groupBy("number").agg(F.min("quality").alias("quality"))
        # rows without a number get one that no label has, each its own, so that they don't meet in one task
        number = F.coalesce(number, -1 - F.pmod(F.xxhash64("page_id", "path"), F.lit(1 << 40)))
        evidence = rows.withColumn("number", number).join(materialize(quality.where("number >= 0")), "number", "left")
        evidence = evidence.select("host", "shape", F.coalesce(bad, 1 - F.col("quality")).alias("bad"))
    rejected = fit_templates(evidence)
    out = rows.join(rejected, ["host", "shape"], "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("template").isNotNull(), "block"), F.lit("allow")).alias("verdict"), F.when(F.col("ruled").isNull(), F.col("template")).alias("template"))
