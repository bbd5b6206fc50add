"""Lookups that are joins at heart: imports against known names, longest prefixes, precedence, categories, first-seen modes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import catalog
from ..functions import text as tx
from .scan import JS_IMPORT, PY_IMPORT, STEP


def package_dependencies(files: DataFrame, sections: Sequence[str] = ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies")) -> DataFrame:
    """repo, name: the packages that the package.json files name in the sections. Unparsable files name none."""
    schema = "struct<" + ",".join(f"{s}:map<string,string>" for s in sections) + ">"
    parsed = files.where(tx.file_name("path") == "package.json").select("repo", F.from_json("text", schema).alias("j"))
    keys = F.flatten(F.array_compact(F.array(*[F.map_keys(F.col(f"j.{s}")) for s in sections])))
    return parsed.select("repo", F.explode(keys).alias("name")).distinct()


def _imports(files: DataFrame, extensions: list[str], pattern: str, flags: str) -> DataFrame:
    full = tx.pattern_flags(flags) + pattern
    rows = files.where(F.lower(tx.suffix("path")).isin(extensions)).select("repo", "path", F.explode(tx.matches(F.col("text"), full)).alias("m"))
    return rows.select("repo", "path", "m.line", "m.ordinal", F.regexp_extract("m.match", full, 1).alias("g1"), *([F.regexp_extract("m.match", full, 2).alias("g2")] if pattern == catalog.PY_IMPORT_PATTERN else []))


def _as_findings(rows: DataFrame, detector: int, snippet: str) -> DataFrame:
    return rows.select("repo", "path", F.lit("unknown_dependency_import").alias("rule"), "line", tx.snippet(F.col(snippet)).alias("snippet"), (F.lit(detector * STEP) + F.col("ordinal")).alias("seq"))


def unknown_js_imports(files: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Imports of packages that the repository does not name; none where it names no package at all."""
    rows = _imports(files, [".js", ".jsx", ".ts", ".tsx"], catalog.JS_IMPORT_PATTERN, "m")
    outside = ~F.col("g1").isin(catalog.JS_BUILTINS)
    for p in catalog.JS_LOCAL_PREFIXES:
        outside = outside & ~F.startswith("g1", F.lit(p))
    rows = rows.where(outside).withColumn("name", tx.package_name("g1"))
    rows = rows.join(dependencies.select("repo").distinct(), "repo", "left_semi").join(dependencies, ["repo", "name"], "left_anti")
    return _as_findings(rows, JS_IMPORT, "g1")


def top_directories(files: DataFrame) -> DataFrame:
    """repo, name of the directories at the root that the scan does not ignore. files: the whole listing, whatever the files hold."""
    path = tx.normalize_path("path")
    return files.select("repo", path.alias("path")).where(F.contains("path", F.lit("/"))).select("repo", F.substring_index("path", "/", 1).alias("name")).distinct().where(~tx.is_ignored("name"))


def unknown_python_imports(files: DataFrame, directories: DataFrame, stdlib: Sequence[str] = catalog.PY_STDLIB) -> DataFrame:
    """Imports of modules that are neither of the standard library, nor allowed, nor a top-level directory of the repository.

    directories: repo, name, as top_directories gives them. stdlib: pin it where results must not follow the interpreter.
    """
    rows = _imports(files, [".py"], catalog.PY_IMPORT_PATTERN, "m").withColumn("name", F.substring_index(F.coalesce(F.nullif("g1", F.lit("")), "g2"), ".", 1))
    rows = rows.where(~F.startswith("name", F.lit("_")) & ~F.col("name").isin([*stdlib, *catalog.PY_ALLOWED]))
    return _as_findings(rows.join(directories, ["repo", "name"], "left_anti"), PY_IMPORT, "name")


def longest_prefix(path: Column, roots: Sequence[tuple[str, str]]) -> Column:
    """The name whose root holds path, else empty. roots: (name, root) in configured order; the longest root wins, then order."""
    ordered = sorted(((n, r.lstrip("./")) for n, r in roots), key=lambda x: -len(x[1]))
    out = F.lit("")
    for name, root in reversed(ordered):
        out = F.when(tx.under(path, F.lit(root)), name).otherwise(out)
    return out


def ancestors(path: Column | str) -> Column:
    """The path and every directory above it."""
    parts = F.split(tx.as_column(path), "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def clean_root(root: Column | str) -> Column:
    """A configured root or prefix as paths are written; empty where it names nothing."""
    return F.rtrim(tx.normalize_path(root), F.lit("/"))


def workspace_of(files: DataFrame, roots: DataFrame) -> DataFrame:
    """repo, path, workspace of the distinct paths that lie under a root of their repository: the longest holds.

    roots: repo, name, root, ord. Of equal roots the first in order holds; one that is empty holds nothing. Every ancestor of a
    path is looked up by (repo, root), so the plan does not grow with the roots and no path is held against all of them.
    """
    first = roots.select("repo", clean_root("root").alias("root"), "name", "ord").where("root <> ''").groupBy("repo", "root").agg(F.min_by("name", "ord").alias("workspace"))
    up = files.select("repo", "path").distinct().select("repo", "path", F.explode(ancestors("path")).alias("root"))
    return up.join(first, ["repo", "root"]).groupBy("repo", "path").agg(F.max_by("workspace", F.length("root")).alias("workspace"))


def labelled(files: DataFrame, roots: DataFrame) -> DataFrame:
    """files (repo, path and more) with the column workspace, empty where no root holds the path."""
    return files.join(workspace_of(files, roots), ["repo", "path"], "left").withColumn("workspace", F.coalesce("workspace", F.lit("")))


def outside_prefixes(files: DataFrame, prefixes: DataFrame) -> DataFrame:
    """The rows of files (repo, path and more) that are not under a prefix (repo, prefix) of their repository.

    A repository's prefixes are one short list; it joins by repository, so texts are not spread over their ancestors."""
    lists = prefixes.select("repo", clean_root("prefix").alias("prefix")).where("prefix <> ''").groupBy("repo").agg(F.collect_set("prefix").alias("_prefixes"))
    rows = files.join(lists, "repo", "left")
    return rows.where(F.col("_prefixes").isNull() | ~F.arrays_overlap(ancestors("path"), "_prefixes")).select(*files.columns)


def first_paths(files: DataFrame, most: int) -> DataFrame:
    """The rows of the first so many paths of each repository, in order. Each task keeps no more than that of a repository
    before they meet, so a large repository is no large partition. files: repo, path (distinct within repo) and more."""
    nth = F.row_number().over(Window.partitionBy("repo").orderBy("path"))
    return files.withColumn("nth", nth).where(F.col("nth") <= most)


def first_nonblank(*columns: Column | str) -> Column:
    """Precedence: the first value that is not null or blank, trimmed; else empty."""
    return F.coalesce(*[F.nullif(tx.strip(c), F.lit("")) for c in columns], F.lit(""))


def command_precedence(scopes: DataFrame, keys: Sequence[str] = catalog.COMMAND_KEYS) -> DataFrame:
    """scope, key, value, level (1 local scope, 2 detected scope, 3 local root, 4 detected root): the value that holds per (scope, key).

    The root's levels 3 and 4 have scope 'root' and serve every scope.
    """
    own = scopes.where("level <= 2").groupBy("scope", "key").agg(*[F.max(F.when(F.col("level") == k, F.col("value"))).alias(f"v{k}") for k in (1, 2)])
    root = scopes.where("level >= 3").groupBy("key").agg(*[F.max(F.when(F.col("level") == k, F.col("value"))).alias(f"v{k}") for k in (3, 4)])
    names = scopes.select("scope").distinct().withColumn("key", F.explode(F.array(*[F.lit(k) for k in keys])))
    return names.join(own, ["scope", "key"], "left").join(root, "key", "left").select("scope", "key", first_nonblank("v1", "v2", "v3", "v4").alias("value"))


def categories(df: DataFrame, name: str, table: Mapping[str, Sequence[str]] = catalog.LIBRARIES) -> DataFrame:
    """One row per row of df and category of which some entry is part of the lower-cased name: df's columns and category."""
    low = F.lower(F.col(name))
    hits = [F.when(low.rlike("|".join(c.replace("-", "\\-") for c in entries)), F.lit(k)) for k, entries in table.items()]
    return df.select("*", F.explode(F.array_compact(F.array(*hits))).alias("category"))


def first_seen(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Ordered distinct: each key once, with the least order it was seen at."""
    return df.groupBy(*keys).agg(F.min(F.struct(*order)).alias("first")).select(*keys, *[F.col(f"first.{o}").alias(f"first_{o}") for o in order])


def mode_first_seen(df: DataFrame, value: str, order: Sequence[str], keys: Sequence[str] = (), skip: Sequence[str] = ("unknown",)) -> DataFrame:
    """The most frequent value per keys, of equal ones the first seen; skipped values and nulls do not count."""
    counted = df.where(F.col(value).isNotNull() & ~F.col(value).isin(list(skip))).groupBy(*keys, value).agg(F.count("*").alias("n"), F.min(F.struct(*order)).alias("first"))
    best = F.min(F.struct((-F.col("n")).alias("rank"), F.col("first"), F.col(value).alias("value"), F.col("n")))
    out = counted.groupBy(*keys).agg(best.alias("b"))
    return out.select(*keys, F.col("b.value").alias(value), F.col("b.n").alias("n")).where(F.col(value).isNotNull())


def layouts(paths: DataFrame) -> DataFrame:
    """repo, layout for each layout label of which some path exists. paths: repo, path of files and directories."""
    pairs = [(k, p) for k, ps in catalog.LAYOUTS.items() for p in ps]
    marks = F.create_map(*[F.lit(x) for p in dict.fromkeys(p for _, p in pairs) for x in (p, "|".join(k for k, q in pairs if q == p))])
    named = paths.select("repo", F.explode(F.split(F.try_element_at(marks, F.col("path")), "\\|")).alias("layout"))
    return named.distinct()


def with_ancestors(files: DataFrame) -> DataFrame:
    """repo, path, is_dir: each file and every directory above it, once."""
    parts = F.split("path", "/")
    dirs = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    up = files.where(F.contains("path", F.lit("/"))).select("repo", F.explode(dirs).alias("path")).distinct()
    return files.select("repo", "path", F.lit(False).alias("is_dir")).distinct().union(up.select("repo", "path", F.lit(True)))


def folder_structure(paths: DataFrame, most: int = 30) -> DataFrame:
    """repo, path, label, ord of the first directories of at most two levels, each followed by its children, in order."""
    dirs = paths.where("is_dir").where(~tx.is_hidden_or_skipped("path") & (F.size(F.split("path", "/")) <= 2))
    order = Window.partitionBy("repo").orderBy(F.split("path", "/"))
    return dirs.select("repo", "path", tx.directory_label("path").alias("label"), F.row_number().over(order).alias("ord")).where(F.col("ord") <= most)


def union_changed(*lists: DataFrame) -> DataFrame:
    """The distinct union of path lists, without blanks, normalised."""
    out = lists[0]
    for x in lists[1:]:
        out = out.union(x)
    return out.where(tx.strip("path") != "").select(tx.normalize_path("path").alias("path")).distinct()


def branch_changes(working: Sequence[DataFrame], merge_base: DataFrame | None = None, base: DataFrame | None = None) -> DataFrame:
    """The changed paths of a branch: the working set's lists, and the difference to the merge base; where there is none, to
    the base itself; where that is unknown too, the working set alone."""
    against = [x for x in (merge_base, base) if x is not None][:1]
    return union_changed(*against, *working)


def languages(files: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One row (or one per keys): the sorted languages of the paths, joined, or 'none'."""
    found = F.array_join(F.sort_array(F.collect_set(tx.language("path"))), ", ")
    return files.groupBy(*keys).agg(F.coalesce(F.nullif(found, F.lit("")), F.lit("none")).alias("languages"))


def dimension(spark: SparkSession, name: str) -> DataFrame:
    """The review dimensions as small tables: severity, layer, layer_category, risk_multiplier, critical_risk, bug_bucket."""
    c = catalog
    tables = {
        "severity": (list(zip(c.SEVERITIES, range(1, 9))), "severity string, ord int"),  # noqa: B905
        "layer": ([(i + 1, k) for i, k in enumerate(c.LAYERS)], "layer int, name string"),
        "layer_category": ([(i + 1, x) for i, xs in enumerate(c.LAYERS.values()) for x in xs], "layer int, category string"),
        "risk_multiplier": (list(c.RISK_MULTIPLIERS.items()), "category string, multiplier double"),
        "critical_risk": ([(x,) for x in c.CRITICAL_RISKS], "risk string"),
        "bug_bucket": (list(c.BUG_BUCKETS.items()), "bucket string, percent double"),
    }
    return spark.createDataFrame(*tables[name])


def layer_report(findings: DataFrame) -> DataFrame:
    """layer, name, severity, n, note: findings (layer, severity) counted per layer and severity, in order; an empty layer says so."""
    spark = findings.sparkSession
    counted = findings.groupBy("layer", "severity").agg(F.count("*").alias("n"))
    out = dimension(spark, "layer").join(counted, "layer", "left").join(dimension(spark, "severity"), "severity", "left")
    note = F.when(F.col("n").isNull(), F.lit("No issues")).otherwise(F.lit(""))
    return out.select("layer", "name", "severity", F.coalesce("n", F.lit(0).cast("long")).alias("n"), note.alias("note"), "ord").orderBy("layer", "ord").drop("ord")
