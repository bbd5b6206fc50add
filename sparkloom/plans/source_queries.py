"""Registered queries over trees, histories and repositories that are made from table rows, each with a DuckDB twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import catalog
from ..functions import text as tx
from ..operators import history, lookups
from ..sources import tree
from ..sources.shared import scratch
from . import profile, review
from .queries import PAGE_HOST, host_of, quoted, spread, table

FOLDERS = ["", "src/deep/er/", ".hidden/", "web/node_modules/", "a b/", "build/"]


def tree_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document written as a file of a tree, some below folders that a scan does not enter; the tree listed, read and
    decoded: size of each file, characters and line ends of those that are not binary, -1 for the others."""
    key = F.col("doc_id")
    folder = F.element_at(F.array(*[F.lit(f) for f in FOLDERS]), (key % len(FOLDERS) + 1).cast("int"))
    content = F.concat(F.encode(F.coalesce("text", F.lit("")), "utf-8"), F.when(key % 7 == 0, F.unhex(F.lit("00"))).when(key % 5 == 0, F.unhex(F.lit("FF0D0A41C3"))).otherwise(F.unhex(F.lit(""))))
    rows = spread(table(spark, sf_dir, "documents").select(F.concat(folder, "source", F.lit("/f"), key.cast("string"), F.lit(".txt")).alias("path"), content.alias("content")))
    root = f"{scratch(spark)}/tree"
    tree.write_tree(rows, root)
    files = tree.read_tree(spark, root, "docs")
    texts = tree.decoded(files).select("path", F.length("text").alias("chars"), F.regexp_count("text", F.lit("\n")).alias("breaks"))
    none = F.lit(-1)
    return files.select("path", "size").join(texts, "path", "left").select("path", "size", F.coalesce("chars", none).alias("chars"), F.coalesce("breaks", none).alias("breaks"))


def snapshot(spark: SparkSession, sf_dir: str, where: str, path: str, digest: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where(where).select(F.col("source").alias("repo"), F.expr(path).alias("path"), F.expr(digest).alias("digest"))


#: where, path, digest of each snapshot, in words that both engines read alike.
SNAPSHOTS = {
    "head": ("doc_id % 10 <> 3", "concat('src/', doc_id, '.py')", "md5(text)"),
    "index": ("doc_id % 10 <> 4", "concat(CASE WHEN doc_id % 17 = 0 THEN 'lib/' WHEN doc_id % 19 = 0 THEN 'lib/new' ELSE 'src/' END, doc_id, '.py')", "CASE WHEN doc_id % 13 = 0 THEN md5(concat(text, 'i')) ELSE md5(text) END"),
    "working": ("doc_id % 11 <> 5", "concat(CASE WHEN doc_id % 17 = 0 THEN 'lib/' WHEN doc_id % 23 = 0 THEN 'tmp/' ELSE 'src/' END, doc_id, '.py')", "CASE WHEN doc_id % 9 = 0 THEN md5(concat(text, 'w')) WHEN doc_id % 13 = 0 THEN md5(concat(text, 'i')) ELSE md5(text) END"),
}


def working_set_states(spark, sf_dir):
    """Every changed path of three snapshots that documents stand for: staged, unstaged and untracked, with renames."""
    head, index, working = (snapshot(spark, sf_dir, *SNAPSHOTS[k]) for k in ("head", "index", "working"))
    ignored = working.where("path LIKE 'tmp/%7.py'")
    return history.working_set(head, index, working, ignored)


def working_set_sql() -> str:
    shots = ", ".join(f"{k}_ AS (SELECT source AS repo, {p} AS path, {d} AS digest FROM documents WHERE {w})" for k, (w, p, d) in SNAPSHOTS.items())
    return rf"""WITH {shots},
        sides AS (SELECT repo, path, max(h) AS h, max(i) AS i, max(w) AS w FROM (SELECT repo, path, digest AS h, NULL AS i, NULL AS w FROM head_ UNION ALL SELECT repo, path, NULL, digest, NULL FROM index_ UNION ALL SELECT repo, path, NULL, NULL, digest FROM working_) AS u GROUP BY 1, 2),
        kinds AS (SELECT *, CASE WHEN h IS NULL AND i IS NOT NULL THEN 'A' WHEN i IS NULL AND h IS NOT NULL THEN 'D' WHEN h <> i THEN 'M' END AS staged FROM sides),
        moved AS (SELECT repo, path, staged AS kind, coalesce(i, h) AS digest, regexp_extract(path, '[^/]*$') AS name FROM kinds WHERE staged IN ('A', 'D')),
        one AS (SELECT *, row_number() OVER (PARTITION BY repo, digest, name, kind ORDER BY path) AS nth FROM moved),
        same AS (SELECT a.repo, d.path AS old_path, a.path FROM one AS a JOIN one AS d ON a.kind = 'A' AND d.kind = 'D' AND d.repo = a.repo AND d.digest = a.digest AND d.name = a.name AND d.nth = a.nth),
        two AS (SELECT *, row_number() OVER (PARTITION BY repo, digest, kind ORDER BY path) AS nth FROM moved WHERE (repo, path) NOT IN (SELECT (repo, path) FROM same UNION ALL SELECT (repo, old_path) FROM same)),
        renames AS (SELECT * FROM same UNION ALL SELECT a.repo, d.path, a.path FROM two AS a JOIN two AS d ON a.kind = 'A' AND d.kind = 'D' AND d.repo = a.repo AND d.digest = a.digest AND d.nth = a.nth),
        done AS (SELECT k.repo, k.path, CASE WHEN r.path IS NOT NULL THEN 'R' WHEN o.path IS NOT NULL THEN NULL ELSE staged END AS staged, r.old_path, CASE WHEN i IS NOT NULL AND w IS NULL THEN 'D' WHEN w <> i THEN 'M' END AS unstaged,
            i IS NULL AND w IS NOT NULL AND NOT regexp_matches(k.path, '^tmp/.*7[.]py$') AS untracked FROM kinds AS k LEFT JOIN renames AS r ON r.repo = k.repo AND r.path = k.path LEFT JOIN renames AS o ON o.repo = k.repo AND o.old_path = k.path)
        SELECT * FROM done WHERE staged IS NOT NULL OR unstaged IS NOT NULL OR untracked"""


COMMITS = 8  #: commits of a repository


def order_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders as histories of eight commits: each has a parent, every third skips one, every fourth merges."""
    ranked = table(spark, sf_dir, "orders").selectExpr("o_custkey", "row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS n")
    i = F.col("n") % COMMITS
    parents = F.array_compact(F.array(F.when(i >= 2, i - F.when(i % 3 == 2, 2).otherwise(1)).when(i == 1, 0), F.when((i >= 3) & (i % 4 == 3), i - 3)))
    repo = F.concat_ws("-", "o_custkey", F.expr(f"n div {COMMITS}"))
    return ranked.select(repo.alias("repo"), i.cast("string").alias("commit"), F.transform(parents, lambda p: p.cast("string")).alias("parents"), i.alias("generation"))


def merge_base_pairs(spark, sf_dir):
    """The best common ancestors of every history's last commit with the one before it and with the one in the middle."""
    commits = order_commits(spark, sf_dir)
    last = commits.groupBy("repo").agg(F.max("generation").alias("n"))
    tips = last.select("repo", F.col("n").cast("string").alias("head"), F.explode(F.array((F.col("n") - 1).cast("string"), F.floor(F.col("n") / 2).cast("string"))).alias("base"))
    return history.merge_bases(commits, tips)


MERGE_BASE_SQL = f"""WITH RECURSIVE ranked AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS n FROM orders),
    commits AS (SELECT o_custkey || '-' || n // {COMMITS} AS repo, n % {COMMITS} AS i FROM ranked),
    edges AS (SELECT repo, i, CASE WHEN i = 1 THEN 0 WHEN i % 3 = 2 THEN i - 2 ELSE i - 1 END AS p FROM commits WHERE i > 0 UNION SELECT repo, i, i - 3 FROM commits WHERE i >= 3 AND i % 4 = 3),
    above AS (SELECT repo, i, i AS a FROM commits UNION SELECT x.repo, x.i, e.p FROM above AS x JOIN edges AS e ON e.repo = x.repo AND e.i = x.a),
    last AS (SELECT repo, max(i) AS n FROM commits GROUP BY repo), tips AS (SELECT DISTINCT repo, n AS head, unnest([n - 1, n // 2]) AS base FROM last),
    common AS (SELECT t.repo, t.head, t.base, x.a FROM tips AS t JOIN above AS x ON x.repo = t.repo AND x.i = t.head JOIN above AS y ON y.repo = t.repo AND y.i = t.base AND y.a = x.a)
    SELECT repo, head::VARCHAR AS head, base::VARCHAR AS base, a::VARCHAR AS commit FROM common AS c
    WHERE NOT EXISTS (SELECT 1 FROM common AS d JOIN above AS z ON z.repo = d.repo AND z.i = d.a WHERE d.repo = c.repo AND d.head = c.head AND d.base = c.base AND d.a <> c.a AND z.a = c.a)"""

PAGE_PATH = r"regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*/([^?#]*)', 1), '(\.html|/)$', '')"


def workspace_labels(spark, sf_dir):
    """Workspaces of page paths, with a host's own roots: its languages, and the pages whose number ends in 3, in order of page."""
    pages = table(spark, sf_dir, "pages").select(host_of("url").alias("repo"), F.expr(PAGE_PATH.replace("\\", "\\\\")).alias("path"), "page_id")
    numbered = pages.select("repo", F.concat(F.lit("p"), "page_id").alias("name"), F.concat(F.lit("./"), "path", F.lit("/")).alias("root"), F.col("page_id").alias("ord")).where("path LIKE '%3'")
    languages = pages.select("repo", F.substring_index("path", "/", 1).alias("name"), F.substring_index("path", "/", 1).alias("root"), F.lit(-1).cast("long").alias("ord")).distinct()
    files = pages.select("repo", F.concat("path", F.when(F.col("page_id") % 2 == 0, "/x.py").otherwise("")).alias("path"), "page_id")
    return lookups.labelled(files, numbered.union(languages)).select("page_id", "repo", "path", "workspace")


WORKSPACE_LABELS_SQL = f"""WITH p AS (SELECT page_id, {PAGE_HOST} AS repo, {PAGE_PATH} AS path FROM pages),
    roots AS (SELECT repo, 'p' || page_id AS name, path AS root, page_id AS ord FROM p WHERE path LIKE '%3' UNION ALL SELECT DISTINCT repo, string_split(path, '/')[1], string_split(path, '/')[1], -1 FROM p),
    files AS (SELECT page_id, repo, path || CASE WHEN page_id % 2 = 0 THEN '/x.py' ELSE '' END AS path FROM p)
    SELECT page_id, f.repo, path, coalesce((SELECT arg_min(name, (-length(root), ord)) FROM roots AS r WHERE r.repo = f.repo AND root <> '' AND (path = root OR starts_with(path, root || '/'))), '') AS workspace FROM files AS f"""

GLOBS = {"en/*": "^en/[^/]*$", "*/1*": "^[^/]*/1[^/]*$", "**": "^.+$", "**/*7": "^([^/]+/)*[^/]*7$", "fr/**/x": "^fr/([^/]+/)*x$", "[!e]?/2?": "^[^e/][^/]/2[^/]$", "./de/**/": "^de(/[^/]+)*$", "*/*5*/*": "^[^/]*/[^/]*5[^/]*/[^/]*$", "none/*": "^none/[^/]*$"}


def workspace_globs(spark, sf_dir):
    """Directories that each host's workspace globs take, from the paths of its pages."""
    files = table(spark, sf_dir, "pages").select(host_of("url").alias("repo"), F.concat(F.expr(PAGE_PATH.replace("\\", "\\\\")), F.lit("/x/y.py")).alias("path"))
    dirs = lookups.with_ancestors(files).where("is_dir").select("repo", "path")
    patterns = files.select("repo").distinct().select("repo", F.explode(F.array(*[F.lit(g) for g in GLOBS])).alias("pattern"))
    return profile.expanded(patterns, dirs)


WORKSPACE_GLOBS_SQL = f"""WITH f AS (SELECT DISTINCT {PAGE_HOST} AS repo, {PAGE_PATH} AS path FROM pages), parts AS (SELECT repo, string_split(path || '/x', '/') AS p FROM f),
    dirs AS (SELECT DISTINCT repo, array_to_string(p[1:k], '/') AS path FROM (SELECT repo, p, unnest(range(1, len(p) + 1)) AS k FROM parts) AS x),
    globs(pattern, regex) AS (VALUES {", ".join(f"({quoted(g)}, {quoted(r)})" for g, r in GLOBS.items())})
    SELECT repo, pattern, path FROM dirs JOIN globs ON regexp_matches(path, regex)"""


def naming_of_large_repositories(spark, sf_dir):
    """Naming and test styles where only the first 60 files listed count, and 25 of their source files give names: sources as repositories."""
    kind = F.element_at(F.array(*[F.lit(x) for x in (".py", ".md", "_b.ts", ".test.ts", ".txt")]), (F.col("doc_id") % 5 + 1).cast("int"))
    path = F.concat(F.element_at(F.array(F.lit("src/a"), F.lit("web/Main"), F.lit(".git/x"), F.lit("lib/one-")), (F.col("doc_id") % 4 + 1).cast("int")), F.col("doc_id").cast("string"), kind)
    files = table(spark, sf_dir, "documents").select("source", path.alias("path")).select(F.col("source").alias("repo"), "path", F.lit("").alias("text"))
    return profile.naming(files, 25, 60)


def naming_sql() -> str:
    stripped = r"regexp_replace(regexp_extract(path, '[^/]*$'), '(\.test\.ts|\.[^.]+)$', '')"
    style = f"CASE WHEN contains({stripped}, '-') THEN 'kebab-case' WHEN contains({stripped}, '_') THEN 'snake_case' WHEN regexp_full_match({stripped}, '[A-Z][A-Za-z0-9]+') THEN 'PascalCase' ELSE 'camelCase' END"
    return f"""WITH f AS (SELECT source AS repo, ['src/a', 'web/Main', '.git/x', 'lib/one-'][doc_id % 4 + 1] || doc_id || ['.py', '.md', '_b.ts', '.test.ts', '.txt'][doc_id % 5 + 1] AS path FROM documents),
        listed AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY path) AS a FROM f WHERE NOT starts_with(path, '.git/')),
        code AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY path) AS nth FROM listed WHERE a <= 60 AND regexp_matches(path, '[.](py|ts)$')),
        marks AS (SELECT repo, 'files' AS kind, nth, {style} AS style FROM code WHERE nth <= 25 UNION ALL SELECT repo, 'tests', nth, '*.test.ts' FROM code WHERE ends_with(path, '.test.ts')),
        counted AS (SELECT repo, kind, style, count(*) AS n, min(nth) AS first FROM marks GROUP BY ALL)
        SELECT repo, kind, arg_min(style, (-n, first)) AS style FROM counted GROUP BY repo, kind"""


def _report(spark, sf_dir):
    labels, key = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id"), F.col("doc_id")
    severity = F.element_at(F.array(*[F.lit(s) for s in catalog.SEVERITIES]), (key % 4 + 1).cast("int"))
    layer = F.when(F.col("toxic") == 1, 4).when(F.col("quality") == 0, 6).when(F.col("lang") == "fr", 2).otherwise(9)
    found = labels.select(severity.alias("severity"), F.concat(F.lit("Document "), key).alias("title"), layer.alias("layer"), F.concat(F.lit("docs/"), key, F.lit(":1")).alias("location"), F.lit("i").alias("impact"), F.lit("e").alias("evidence"), F.lit("f").alias("fix"), key.alias("key"))
    events = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("key"))
    checks = events.select(F.concat(F.lit("count "), "event_type").alias("command"), (F.col("n") % 2).cast("int").alias("exit_code"), F.col("n").cast("string").alias("output"), F.lit("counted").alias("interpretation"), "key")
    skipped = table(spark, sf_dir, "region").select(F.lower("r_name").alias("value"), F.col("r_regionkey").alias("key"))
    return review.report_document(found, checks, skipped)


def review_document(spark, sf_dir):
    """The lines of a whole review document over labels, events and regions, with their place in it."""
    return _report(spark, sf_dir)


def review_document_sql() -> str:
    titles = ", ".join(f"({i + 1}, {quoted(t)})" for i, t in enumerate(catalog.LAYER_TITLES))
    severities = ", ".join(quoted(s) for s in catalog.SEVERITIES)
    lines = lambda part, layer, ord_, source, *values: f"SELECT {part} AS part, {layer} AS layer, {ord_} AS ord, key, unnest(range({len(values)})) AS line, unnest([{', '.join(values)}]) AS value FROM {source}"
    none = "(SELECT 0 AS key)"
    return f"""WITH titles(layer, title) AS (VALUES {titles}),
        marked AS (SELECT doc_id AS key, (doc_id % 4)::INT + 1 AS ord, CASE WHEN toxic = 1 THEN 4 WHEN quality = 0 THEN 6 WHEN lang = 'fr' THEN 2 END AS layer FROM labels JOIN documents USING (doc_id)),
        found AS (SELECT * FROM marked JOIN titles USING (layer)), events_ AS (SELECT event_type, count(*) AS n, min(event_id) AS key FROM events GROUP BY 1)
        SELECT part::INT AS part, layer::INT AS layer, ord::INT AS ord, key::BIGINT AS key, line::INT AS line, value FROM (
        {lines(1, 0, 0, none, "'## Findings by Layer'", "''")} UNION ALL {lines(1, "layer", 0, "(SELECT *, 0 AS key FROM titles) AS t", "'### Layer ' || layer || ': ' || title", "''")}
        UNION ALL {lines(1, "layer", 1, "(SELECT *, 0 AS key FROM titles WHERE layer NOT IN (SELECT layer FROM found)) AS t", "'- No issues found in this layer.'", "''")}
        UNION ALL {lines(1, "layer", "ord", "found", f"'### [' || upper(left([{severities}][ord], 1)) || substring([{severities}][ord], 2) || '] Document ' || key", "''", "'- Layer: Layer ' || layer || ': ' || title", "'- Location: `docs/' || key || ':1`'", "'- Impact: i'", "'- Evidence: e'", "'- Fix: f'", "''")}
        UNION ALL {lines(2, 0, 0, none, "'## Verification'", "''")} UNION ALL {lines(2, 0, 1, "events_", "'- Command: `count ' || event_type || '`'", "'- Exit code: `' || (n % 2) || '`'", "'- Relevant output: `' || n || '`'", "'- Interpretation: `counted`'", "''")}
        UNION ALL {lines(3, 0, 0, none, "'- Not run / not verified:'")} UNION ALL {lines(3, 0, 1, "(SELECT *, r_regionkey AS key FROM region) AS r", "'  - ' || lower(r_name)")}) AS d"""


QUERIES = {f.__name__: f for f in (tree_files, working_set_states, merge_base_pairs, workspace_labels, workspace_globs, naming_of_large_repositories, review_document)}


def oracle_sql() -> dict[str, str]:
    folder = "[" + ", ".join(quoted(f) for f in FOLDERS) + f"][doc_id % {len(FOLDERS)} + 1]"
    kept = " AND ".join(f"doc_id % {len(FOLDERS)} <> {i}" for i, f in enumerate(FOLDERS) if set(f.split("/")) & set(catalog.IGNORED_PARTS))
    binary, tail = "doc_id % 7 = 0", "doc_id % 5 = 0"
    return {
        "tree_files": f"""SELECT {folder} || source || '/f' || doc_id || '.txt' AS path, strlen(coalesce(text, '')) + CASE WHEN {binary} THEN 1 WHEN {tail} THEN 5 ELSE 0 END AS size,
            CASE WHEN NOT {binary} THEN length(coalesce(text, '')) + CASE WHEN {tail} THEN 2 ELSE 0 END ELSE -1 END::INT AS chars,
            CASE WHEN NOT {binary} THEN length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) + CASE WHEN {tail} THEN 1 ELSE 0 END ELSE -1 END::INT AS breaks FROM documents WHERE {kept}""",
        "working_set_states": working_set_sql(),
        "merge_base_pairs": MERGE_BASE_SQL,
        "workspace_labels": WORKSPACE_LABELS_SQL,
        "workspace_globs": WORKSPACE_GLOBS_SQL,
        "naming_of_large_repositories": naming_sql(),
        "review_document": review_document_sql(),
    }
