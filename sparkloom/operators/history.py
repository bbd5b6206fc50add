"""Changes between snapshots of repositories, working sets, and merge bases of branches.

A snapshot is repo, path, digest (not null) of its files.  A history is repo, commit, parents (array), generation: a number
greater than that of all parents, such as version-control systems keep beside their commits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..sources.shared import scratch, written

HEAD, BASE = 1, 2


def _sides(**snapshots: DataFrame) -> DataFrame:
    """repo, path, and one column of digests for each snapshot, null where it lacks the path: one grouping of all of them."""
    parts = [df.select("repo", "path", *[(F.col("digest") if k == name else F.lit(None).cast("string")).alias(k) for k in snapshots]) for name, df in snapshots.items()]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.union(p)
    return rows.groupBy("repo", "path").agg(*[F.max(k).alias(k) for k in snapshots])


def _kind(old: Column, new: Column) -> Column:
    """A (added), D (deleted), M (modified), or null."""
    return F.when(old.isNull() & new.isNotNull(), "A").when(new.isNull() & old.isNotNull(), "D").when(old != new, "M")


def _renames(changes: DataFrame) -> DataFrame:
    """repo, old_path, path: deleted files that came back elsewhere with the same content, each once.

    Files of the same name pair first, then others, in order of their paths."""
    moved = changes.where("kind IN ('A', 'D')").select("repo", "path", "kind", F.coalesce("new", "old").alias("digest"), tx.file_name("path").alias("name"))

    def pairs(rows: DataFrame, keys: list[str]) -> DataFrame:
        nth = F.row_number().over(Window.partitionBy(*keys, "kind").orderBy("path"))
        rows = rows.withColumn("nth", nth)
        gone = rows.where("kind = 'D'").select(*keys, "nth", F.col("path").alias("old_path"))
        return rows.where("kind = 'A'").join(gone, [*keys, "nth"]).select("repo", "old_path", "path")

    # only contents that both came and went can pair
    both = moved.groupBy("repo", "digest").agg(F.countDistinct("kind").alias("kinds")).where("kinds = 2").select("repo", "digest")
    moved = moved.join(both, ["repo", "digest"], "left_semi")
    same = pairs(moved, ["repo", "digest", "name"])
    used = same.select("repo", F.explode(F.array("old_path", "path")).alias("path"))
    return same.union(pairs(moved.join(used, ["repo", "path"], "left_anti"), ["repo", "digest"]))


def _with_renames(sides: DataFrame, old: str, new: str, kind: str, source: str) -> DataFrame:
    """sides with the columns kind (A, D, M, R or null) and source (a renamed file's old path). The old path of a rename is no change."""
    rows = sides.withColumn(kind, _kind(F.col(old), F.col(new)))
    found = _renames(rows.where(F.col(kind).isin("A", "D")).select("repo", "path", F.col(kind).alias("kind"), F.col(old).alias("old"), F.col(new).alias("new")))
    marks = found.select("repo", "path", F.col("old_path").alias(source), F.lit("R").alias("mark")).union(found.select("repo", F.col("old_path"), F.lit(None).cast("string"), F.lit("")))
    rows = rows.join(marks, ["repo", "path"], "left")
    return rows.withColumn(kind, F.when(F.col("mark").isNull(), F.col(kind)).when(F.col("mark") == "R", F.col("mark"))).drop("mark")


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """repo, path, kind (A, D, M, R), old_path (of a rename): what new changes of old. Only equal contents count as renames."""
    return _with_renames(_sides(old=old, new=new), "old", "new", "kind", "old_path").where("kind IS NOT NULL").select("repo", "path", "kind", "old_path")


def working_set(head: DataFrame, index: DataFrame, working: DataFrame, ignored: DataFrame | None = None) -> DataFrame:
    """repo, path, staged (head to index: A, D, M, R), old_path (of a staged rename), unstaged (index to working tree: D, M),
    untracked, of every path that any of the three names.

    ignored: repo, path of files that do not count as untracked. A null digest counts as a file that is not there.
    """
    sides = _sides(head=head, index=index, working=working)
    rows = _with_renames(sides, "head", "index", "staged", "old_path")
    unstaged = F.when(F.col("index").isNotNull(), F.when(F.col("working").isNull(), "D").when(F.col("working") != F.col("index"), "M"))
    rows = rows.withColumn("unstaged", unstaged).withColumn("untracked", F.col("index").isNull() & F.col("working").isNotNull())
    if ignored is not None:
        rows = rows.join(ignored.select("repo", "path").distinct().withColumn("known", F.lit(True)), ["repo", "path"], "left")
        rows = rows.withColumn("untracked", F.col("untracked") & F.col("known").isNull())
    return rows.where("staged IS NOT NULL OR unstaged IS NOT NULL OR untracked").select("repo", "path", "staged", "old_path", "unstaged", "untracked")


def merge_bases(commits: DataFrame, tips: DataFrame) -> DataFrame:
    """repo, head, base, commit: the best common ancestors of each pair of tips (repo, head, base): common ones that no other
    common ancestor descends from. A pair whose histories do not meet, or of which a tip is unknown, has none.

    Both histories are walked at once, downwards, and only the rows that the walk has yet to pass are kept, with the sides that
    reach them and whether they lie behind a common commit. A commit that both sides reach waits until nothing of its pair lies
    above it, so it is passed once, with all its marks: unless it is behind another, it is a result. A commit of one side is
    passed as soon as nothing of the other side lies above it. A pair is over when one side has nothing left that is not behind
    a common commit, and its rows go. So the rounds follow the distance of the branches to where they part, not the length of
    the history, and a round moves what is due there and the links of the commits, which are joined once.
    """
    key, both = ["repo", "head", "base", "commit"], HEAD | BASE
    commits = written(commits.select("repo", "commit", "parents", "generation"))
    known = commits.select("repo", "commit", "generation")
    links = commits.select("repo", F.col("commit").alias("child"), F.explode("parents").alias("commit")).join(known, ["repo", "commit"])
    links = written(links.select("repo", F.col("child").alias("commit"), F.struct("commit", "generation").alias("up")))
    starts = tips.select("repo", "head", "base").where("head IS NOT NULL AND base IS NOT NULL").distinct()
    ends = F.explode(F.array(*[F.struct(F.col(c).alias("commit"), F.lit(side).alias("sides")) for c, side in (("head", HEAD), ("base", BASE))]))
    rows = starts.select("*", ends.alias("e")).select("repo", "head", "base", "e.*").join(known, ["repo", "commit"]).withColumn("behind", F.lit(False))

    pair = Window.partitionBy("repo", "head", "base")
    common, open_ = F.col("sides") == both, ~F.col("behind")
    of = lambda side: F.col("sides") == side

    def placed(df: DataFrame) -> DataFrame:
        """One row per pair and commit: best (a result) or due (its parents are next), or neither (it waits)."""
        # one shuffle by the pair serves the grouping and the windows
        one = df.repartition("repo", "head", "base").groupBy(*key).agg(F.bit_or("sides").alias("sides"), F.max("behind").alias("behind"), F.max("generation").alias("generation"))
        tops = [F.max(F.when(of(side) | common, F.col("generation"))).over(pair).alias(name) for side, name in ((HEAD, "top_head"), (BASE, "top_base"))]
        alone = F.max(of(HEAD) & open_).over(pair) & F.max(of(BASE) & open_).over(pair)
        lowest = F.min(F.when(common & open_, F.col("generation"))).over(pair)
        one = one.select("*", *tops, alone.alias("alone"), lowest.alias("lowest")).withColumn("top", F.greatest("top_head", "top_base"))
        goes = F.col("alone") | F.coalesce(F.col("lowest") < F.col("top"), F.lit(False))
        passed = F.col("generation") >= F.when(of(HEAD), F.col("top_base")).when(of(BASE), F.col("top_head")).otherwise(F.col("top"))
        best = common & open_ & (F.col("generation") == F.col("top"))
        return one.select(*key, "sides", "behind", "generation", best.alias("best"), goes.alias("goes"), (goes & passed).alias("due")).where("best OR goes")

    now, path = written(placed(rows)), scratch(commits.sparkSession)
    while True:
        now.where("best").select(*key).write.mode("append").parquet(path)
        if now.where("due").isEmpty():
            break
        up = now.where("due").join(links, ["repo", "commit"]).select("repo", "head", "base", "up.commit", "sides", common.alias("behind"), "up.generation")
        waiting = now.where("goes AND NOT due").select("repo", "head", "base", "commit", "sides", "behind", "generation")
        now = written(placed(up.union(waiting)))
    return now.sparkSession.read.schema(now.select(*key).schema).parquet(path)


def merge_base(commits: DataFrame, tips: DataFrame) -> DataFrame:
    """repo, head, base, commit: of the best common ancestors the one of the greatest generation, of equal ones the least."""
    found = merge_bases(commits, tips).join(commits.select("repo", "commit", "generation"), ["repo", "commit"])
    return found.groupBy("repo", "head", "base").agg(F.min(F.struct((-F.col("generation")).alias("g"), "commit")).alias("b")).select("repo", "head", "base", "b.commit")


def branch_changes(commits: DataFrame, snapshots: DataFrame, tips: DataFrame, working: DataFrame | None = None) -> DataFrame:
    """repo, head, base, path of what a branch changes: against the merge base, or, where there is none, against the base itself,
    or nothing where that is unknown; and the working set's paths (repo, path) in all cases.

    snapshots: repo, commit, path, digest.
    """
    against = tips.select("repo", "head", "base").distinct().join(merge_base(commits, tips), ["repo", "head", "base"], "left")
    pair = F.to_json(F.struct("repo", "head", "base"))
    against = against.select(pair.alias("pair"), "repo", "head", "base", F.coalesce("commit", "base").alias("from"))

    def at(commit: str) -> DataFrame:
        return against.select("repo", F.col(commit).alias("commit"), "pair").join(snapshots, ["repo", "commit"]).select(F.col("pair").alias("repo"), "path", "digest")

    known = against.join(commits.select("repo", F.col("commit").alias("from")), ["repo", "from"], "left_semi").select("pair")
    found = changes(at("from"), at("head")).select(F.col("repo").alias("pair"), "path").join(known, "pair", "left_semi")
    out = found.join(against, "pair").select("repo", "head", "base", "path")
    if working is not None:
        out = out.union(against.select("repo", "head", "base").join(working.select("repo", "path"), "repo").select("repo", "head", "base", "path"))
    return out.distinct()
