"""Snapshots, working sets and merge bases against plain Python."""

import random

from sparkloom.operators import history, lookups
from sparkloom.plans import review

SNAPSHOT = "repo string, path string, digest string"


def snap(spark, rows):
    return spark.createDataFrame(rows, SNAPSHOT)


def test_changes_and_renames(spark):
    old = [("r", "a/x.py", "1"), ("r", "b/y.py", "2"), ("r", "c/z.py", "3"), ("r", "e1", "0"), ("r", "e2", "0"), ("r", "same", "9"), ("q", "a/x.py", "1")]
    new = [("r", "n/x.py", "1"), ("r", "m/w.py", "1"), ("r", "b/y.py", "4"), ("r", "d/e2", "0"), ("r", "same", "9"), ("r", "fresh", "7")]
    got = sorted(map(tuple, history.changes(snap(spark, old), snap(spark, new)).collect()))
    assert got == [("q", "a/x.py", "D", None), ("r", "b/y.py", "M", None), ("r", "c/z.py", "D", None), ("r", "d/e2", "R", "e2"), ("r", "e1", "D", None), ("r", "fresh", "A", None), ("r", "m/w.py", "A", None), ("r", "n/x.py", "R", "a/x.py")]
    assert history.changes(snap(spark, old), snap(spark, old)).collect() == []


def test_working_set(spark):
    head = [("r", p, d) for p, d in (("kept", "1"), ("staged", "1"), ("both", "1"), ("gone", "1"), ("rm", "1"), ("old", "5"))]
    index = [("r", p, d) for p, d in (("kept", "1"), ("staged", "2"), ("both", "2"), ("gone", "1"), ("new", "3"), ("moved", "5"), ("lost", "8"))]
    work = [("r", p, d) for p, d in (("kept", "1"), ("staged", "2"), ("both", "3"), ("new", "3"), ("moved", "5"), ("extra", "4"), ("junk", "4"), ("rm", "1"))]
    got = {r.path: tuple(r)[2:] for r in history.working_set(snap(spark, head), snap(spark, index), snap(spark, work), snap(spark, [("r", "junk", "")])).collect()}
    assert got == {"staged": ("M", None, None, False), "both": ("M", None, "M", False), "gone": (None, None, "D", False), "rm": ("D", None, None, True), "moved": ("R", "old", None, False), "new": ("A", None, None, False), "lost": ("A", None, "D", False), "extra": (None, None, None, True)}


def bases_plainly(parents, a, b):
    def above(c):
        out, todo = set(), [c]
        while todo:
            x = todo.pop()
            if x not in out:
                out.add(x)
                todo += parents[x]
        return out

    if a not in parents or b not in parents:
        return set()
    common = above(a) & above(b)
    return {c for c in common if not any(c != d and c in above(d) for d in common)}


def test_merge_bases_of_random_graphs(spark):
    """Criss-cross merges, several roots, tips that are ancestors of each other, and unknown tips."""
    rng = random.Random(5)
    commits, tips, want = [], [], set()
    for g in range(25):
        parents = {}
        for i in range(14):
            parents[f"c{i:02d}"] = sorted({f"c{rng.randrange(max(0, i - 4), i):02d}" for _ in range(rng.choice([1, 1, 2, 3]))}) if i and rng.random() > 0.08 else []
        level = {}
        for c, ps in parents.items():
            level[c] = 1 + max((level[p] for p in ps), default=0)
        commits += [(f"g{g}", c, ps, level[c]) for c, ps in parents.items()]
        for _ in range(6):
            a, b = rng.choice([*parents, "none"]), rng.choice(list(parents))
            tips.append((f"g{g}", a, b))
            want |= {(f"g{g}", a, b, c) for c in bases_plainly(parents, a, b)}
    df = spark.createDataFrame(commits, "repo string, commit string, parents array<string>, generation int")
    pairs = spark.createDataFrame([*tips, ("g0", None, "c01")], "repo string, head string, base string")
    found = set(map(tuple, history.merge_bases(df, pairs).collect()))
    assert found == want and len({x[:3] for x in found}) < len(found)
    one = {tuple(r)[:3]: r.commit for r in history.merge_base(df, pairs).collect()}
    assert set(one) == {x[:3] for x in want} and {(*k, c) for k, c in one.items()} <= want


def test_merge_bases_read_commits_once_and_stop_early(spark, monkeypatch):
    """Commits are computed once, however many rounds; a pair whose one side has ended takes no more of them. Generations with gaps."""
    rng = random.Random(6)
    rows, tips, want = [("deep", f"c{i}", [f"c{i - 1}"] if i else [], i) for i in range(30)] + [("deep", "root", [], 40)], [("deep", "c29", "root")], set()
    for g in range(40):
        parents = {str(i): sorted({str(rng.randrange(max(0, i - 5), i)) for _ in range(rng.choice([1, 2, 3]))}) if i and rng.random() > 0.1 else [] for i in range(12)}
        rows += [(f"g{g}", c, ps, 3 * int(c)) for c, ps in parents.items()]
        for _ in range(5):
            a, b = rng.choice(list(parents)), rng.choice(list(parents))
            tips.append((f"g{g}", a, b))
            want |= {(f"g{g}", a, b, c) for c in bases_plainly(parents, a, b)}
    read, tables = spark.sparkContext.accumulator(0), []

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    schema, keep = "repo string, commit string, parents array<string>, generation int", history.written
    monkeypatch.setattr(history, "written", lambda df: tables.append(1) or keep(df))
    commits = spark.createDataFrame(rows, schema).mapInArrow(counted, schema)
    assert set(map(tuple, history.merge_bases(commits, spark.createDataFrame(tips, "repo string, head string, base string")).collect())) == want
    assert read.value == len(rows) and len(tables) < 20


def test_branch_changes(spark):
    commits = spark.createDataFrame([("r", "0", [], 1), ("r", "1", ["0"], 2), ("r", "2", ["1"], 3), ("r", "3", ["1"], 3), ("r", "9", [], 1)], "repo string, commit string, parents array<string>, generation int")
    files = {"1": {"a": "1", "b": "1"}, "2": {"a": "2", "b": "1"}, "3": {"a": "1", "b": "3", "c": "1"}, "9": {"z": "7"}}
    snaps = spark.createDataFrame([("r", c, p, d) for c, x in files.items() for p, d in x.items()], "repo string, commit string, path string, digest string")
    tips = spark.createDataFrame([("r", "3", "2"), ("r", "9", "2"), ("r", "3", "gone")], "repo string, head string, base string")
    got = sorted((r.head, r.base, r.path) for r in history.branch_changes(commits, snaps, tips, spark.createDataFrame([("r", "w")], "repo string, path string")).collect())
    assert got == [("3", "2", "b"), ("3", "2", "c"), ("3", "2", "w"), ("3", "gone", "w"), ("9", "2", "a"), ("9", "2", "b"), ("9", "2", "w"), ("9", "2", "z")]


def test_workspaces_by_keyed_join(spark):
    """100,000 roots in one plan, ties as configured, roots that hold nothing."""
    many = spark.range(100_000).selectExpr("concat('r', id % 10) AS repo", "concat('w', id) AS name", "concat('./p', id % 1000, '/q', id, '/') AS root", "CAST(id AS int) AS ord")
    some = [("r1", "first", "a/b", 0), ("r1", "second", "./a/b/", 1), ("r1", "short", "a", 2), ("r1", "dot", ".", 3), ("r2", "other", "a/b", 0)]
    roots = many.union(spark.createDataFrame(some, many.schema))
    paths = [("r1", "a/b/c.py"), ("r1", "a/b"), ("r1", "a/bc/d.py"), ("r1", "z.py"), ("r2", "a/x.py"), ("r3", "p13/q13/deep/er/x.py"), ("r3", "p13/q1/x.py"), ("r1", "z.py")]
    out = lookups.labelled(spark.createDataFrame(paths, "repo string, path string"), roots)
    assert [(r.path, r.workspace) for r in out.orderBy("repo", "path").collect()] == [("a/b", "first"), ("a/b/c.py", "first"), ("a/bc/d.py", "short"), ("z.py", ""), ("z.py", ""), ("a/x.py", ""), ("p13/q1/x.py", ""), ("p13/q13/deep/er/x.py", "w13")]
    few = lookups.labelled(out.select("repo", "path"), roots.limit(3))
    size = lambda df: len(df._jdf.queryExecution().optimizedPlan().toString())
    assert abs(size(lookups.labelled(out.select("repo", "path"), roots)) - size(few)) < 400


def test_settings_of_each_repository(spark):
    configs = spark.createDataFrame([("r", '{"workspaces": {"a": {"root": "./web/"}, "lib": {}, "dot": {"root": "."}}, "paths": {"generated": ["gen/"], "ignore": ["./web/old"]}}'), ("s", "{bad"), ("t", None)], "repo string, text string")
    files = [(r, p, "eval(1)") for r in "rst" for p in ("web/x.py", "web/old/y.py", "gen/z.py", "lib/q.py", "gen2/k.py")]
    got = {(r.repo, r.path): r.workspace for r in review.findings(spark.createDataFrame(files, "repo string, path string, text string"), review.Settings.from_json(configs)).where("rule = 'unsafe_eval'").collect()}
    assert got == {("r", "web/x.py"): "a", ("r", "lib/q.py"): "lib", ("r", "gen2/k.py"): "", **{(r, p): "" for r in "st" for p in ("web/x.py", "web/old/y.py", "gen/z.py", "lib/q.py", "gen2/k.py")}}
    capped = review.scanned(spark.createDataFrame(files, "repo string, path string, text string"), review.Settings.from_json(configs), most=2)
    assert sorted((r.repo, r.path) for r in capped.collect()) == [("r", "gen2/k.py"), ("r", "lib/q.py"), ("s", "gen/z.py"), ("s", "gen2/k.py"), ("t", "gen/z.py"), ("t", "gen2/k.py")]
