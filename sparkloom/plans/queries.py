"""The registered queries: the operators applied to whole tables, each with a DuckDB twin where SQL can express it.

Documents stand for files at ``source/doc_id.txt`` and pages for files at ``host/page_id.ts``; these paths decide which
rules apply to them. Repositories of code are tested on fixtures, since no table holds code.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import catalog
from ..functions import text as tx
from ..operators import lookups, scan
from . import profile, review

#: Rules that a regular-expression engine without lookaround can express as they are.
PLAIN_RULES = [r for r in catalog.RULES if "(?<" not in r[1] and "(?!" not in r[1] and "(?=" not in r[1]]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df dealt over all cores, if it comes in fewer pieces than there are cores; larger inputs are not moved."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return spread(table(spark, sf_dir, "documents").select(F.lit("").alias("repo"), path.alias("path"), "text"))


def host_of(url: str) -> F.Column:
    return F.regexp_extract(url, "^[a-z]+://([^/?#]*)", 1)


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page as a crawler's dump: its source, and a last line that logs its url, without a certificate check for plain http."""
    path = F.concat(host_of("url"), F.lit("/"), F.col("page_id").cast("string"), F.lit(".ts"))
    options = F.when(F.col("url").startswith("http://"), ", {rejectUnauthorized: false}").otherwise("")
    text = F.concat("html", F.lit('\nconsole.log("'), "url", F.lit('"'), options, F.lit(")"))
    return spread(table(spark, sf_dir, "pages").select(F.lit("").alias("repo"), path.alias("path"), text.alias("text")))


def rule_findings_documents(spark, sf_dir):
    """Every plain rule over documents."""
    return scan.rule_findings(review.scanned(document_files(spark, sf_dir)), PLAIN_RULES).select("rule", "line", "path", "snippet")


def rule_findings_pages(spark, sf_dir):
    """Every plain rule over dumps of pages."""
    return scan.rule_findings(review.scanned(page_files(spark, sf_dir)), PLAIN_RULES).select("rule", "line", "path", "snippet")


def magic_number_findings(spark, sf_dir):
    """One rule with line numbers, snippets and order of matches: long integers in documents."""
    rules = [r for r in catalog.RULES if r[0] == "magic_number"]
    found = scan.rule_findings(review.scanned(document_files(spark, sf_dir)), rules)
    return found.select("path", "line", "snippet", (F.col("seq") % scan.STEP).alias("ordinal"))


def rule_hit_counts(spark, sf_dir):
    found = scan.rule_findings(review.scanned(document_files(spark, sf_dir)), PLAIN_RULES)
    return found.groupBy("rule").agg(F.count("*").alias("hits"), F.countDistinct("path").alias("files"))


def all_findings_documents(spark, sf_dir):
    """All detectors over documents, with workspaces by source."""
    config = review.Config((("first", "src1"), ("tenth", "src10")))
    return review.findings(document_files(spark, sf_dir), config).select("workspace", "rule", "line", "path", "snippet", "seq")


def rendered_findings(spark, sf_dir):
    """Ordered findings as lines of text."""
    rules = [r for r in catalog.RULES if r[0] in ("hardcoded_credential", "placeholder", "tls_disabled")]
    found = scan.rule_findings(review.scanned(document_files(spark, sf_dir)), rules)
    return review.rendered(found.withColumn("workspace", lookups.longest_prefix(F.col("path"), [("first", "src1"), ("tenth", "src10/")])))


def repeated_literals(spark, sf_dir):
    """Double- or single-quoted literals that occur four times or more on the pages of a host."""
    pages = spread(table(spark, sf_dir, "pages").select(host_of("url").alias("host"), F.col("html").alias("text")))
    return scan.repeated_literals(pages, ["host"], places=False)


def marker_density(spark, sf_dir):
    """Documents in which a word occurs more than five times: the first line and the count."""
    rows = table(spark, sf_dir, "documents").select("doc_id", tx.matches(F.col("text"), tx.pattern_flags("i") + r"\b(trash|scum|idiot|token)\b").alias("m"))
    return rows.where(F.size("m") > 5).select("doc_id", F.col("m")[0]["line"].alias("line"), F.size("m").alias("n"))


def name_style_census(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("name"))
    brand = table(spark, sf_dir, "part").select(F.col("p_brand").alias("name"))
    names = part.union(brand).union(table(spark, sf_dir, "customer").select("c_name")).union(table(spark, sf_dir, "events").select("event_type"))
    return names.groupBy(tx.name_style("name").alias("style")).agg(F.count("*").alias("n"))


def mode_first_seen(spark, sf_dir):
    """Each user's most frequent kind of event, of equal ones the first seen; clicks do not count."""
    return lookups.mode_first_seen(table(spark, sf_dir, "events"), "event_type", ["ts", "event_id"], ["user_id"], ["click"]).select("user_id", "event_type", "n")


def ordered_distinct(spark, sf_dir):
    """Each text once, by its first document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("digest"))
    return lookups.first_seen(docs, ["digest"], ["doc_id"])


def changed_set_union(spark, sf_dir):
    """The distinct union of three path lists, without what is ignored."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    path = F.concat(F.lit("./src/"), F.col("doc_id").cast("string"), F.lit(".py"))
    lists = [labels.where("toxic = 1").select(path.alias("path")), labels.where("quality = 0").select(path.alias("path")), docs.where("lang = 'es'").select(path.alias("path")), docs.select(F.concat(F.lit("build/"), "source").alias("path"))]
    return lookups.union_changed(*lists).where(~tx.is_ignored("path"))


def language_lookup(spark, sf_dir):
    """Languages of the repository's files by extension, per host: the pages stand for files of several kinds."""
    names = F.array(*[F.lit(x) for x in ("a.py", "b.TSX", "c.h", "d.md", "e.rs", "f.mjs")])
    files = table(spark, sf_dir, "pages").select(host_of("url").alias("host"), F.element_at(names, (F.col("page_id") % 6 + 1).cast("int")).alias("path"))
    known = files.select("host", tx.language("path").alias("language")).where("language IS NOT NULL")
    return known.groupBy("host").agg(F.array_join(F.sort_array(F.collect_set("language")), ", ").alias("languages"))


def longest_prefix_label(spark, sf_dir):
    """Workspaces of page paths: nested roots, of which the longest holds."""
    roots = [("all", "example.com"), ("english", "example.com/en"), ("one", "example.com/en/1"), ("dot", "."), ("french", "example.com/fr/")]
    path = F.concat(F.regexp_replace(host_of("url"), "^.*\\.(example\\.[a-z]+)$", "$1"), F.regexp_extract("url", "^[a-z]+://[^/?#]*([^?#]*)", 1))
    rows = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace(path, "(\\.html|/)$", "").alias("path"))
    return rows.select("page_id", "path", lookups.longest_prefix(F.col("path"), roots).alias("workspace"))


def unknown_keys_anti(spark, sf_dir):
    """Words of part names that no allow-list holds: an anti-join after extraction."""
    words = table(spark, sf_dir, "part").select("p_partkey", F.explode(F.split("p_type", " ")).alias("name"))
    known = table(spark, sf_dir, "nation").select(F.lower("n_name").alias("name")).union(spark.createDataFrame([("STEEL",), ("TIN",)], "name string"))
    return words.join(known.distinct(), "name", "left_anti").groupBy("name").agg(F.count("*").alias("n"))


def keyword_categories(spark, sf_dir):
    """Categories of part types by substring, many to many."""
    groups = {"metal": ["steel", "tin", "copper", "nickel", "brass"], "finish": ["polished", "brushed", "plated", "anodized", "burnished"], "size": ["small", "medium", "large"], "mixed": ["tin", "small", "economy"]}
    return lookups.categories(table(spark, sf_dir, "part").select("p_partkey", "p_type"), "p_type", groups)


def library_categories(spark, sf_dir):
    """The library categories over words of documents: substrings of names, many to many."""
    words = spread(table(spark, sf_dir, "documents").select("text")).select(F.explode(F.array_distinct(F.split("text", "[\\x20\\x09-\\x0D]+"))).alias("name"))
    return lookups.categories(words.groupBy("name").agg(F.count("*").alias("n")), "name").groupBy("category").agg(F.count("*").alias("names"), F.sum("n").alias("documents"))


def command_precedence(spark, sf_dir):
    """Four levels of precedence per (scope, key), with blank values that do not count."""
    c = table(spark, sf_dir, "customer").withColumn("k", F.element_at(F.array(F.lit("lint"), F.lit("test"), F.lit("build")), (F.col("c_custkey") % 3 + 1).cast("int")))
    blank = lambda x: F.when(F.col("c_custkey") % 5 == 0, F.lit("  ")).otherwise(x)
    own = c.groupBy(F.concat(F.lit("n"), F.col("c_nationkey")).alias("scope"), F.col("k").alias("key"), (F.col("c_custkey") % 2 + 1).cast("int").alias("level")).agg(F.max(blank(F.col("c_name"))).alias("value"))
    root = c.groupBy(F.lit("root").alias("scope"), F.col("k").alias("key"), (F.col("c_custkey") % 2 + 3).cast("int").alias("level")).agg(F.max("c_mktsegment").alias("value"))
    return lookups.command_precedence(own.select("scope", "key", "value", "level").union(root.select("scope", "key", "value", "level")), ["lint", "test", "build"])


def json_keys(spark, sf_dir):
    """Keys of JSON objects, counted."""
    return table(spark, sf_dir, "events").select(F.explode(F.json_object_keys("props")).alias("key")).groupBy("key").agg(F.count("*").alias("n"))


def first_paragraph(spark, sf_dir):
    """The first paragraph of each document."""
    return table(spark, sf_dir, "documents").select("doc_id", profile.first_paragraph(F.col("text")).alias("paragraph"))


def layer_report(spark, sf_dir):
    """Findings per review layer and severity, empty layers included. The mapping of kinds to layers is this query's own."""
    kinds = F.when(F.col("quality") == 0, 6).otherwise(2)
    found = table(spark, sf_dir, "labels").select(F.when(F.col("toxic") == 1, 4).otherwise(kinds).alias("layer"), F.when(F.col("toxic") == 1, "critical").when(F.col("quality") == 0, "low").otherwise("medium").alias("severity"))
    return lookups.layer_report(found)


def top_paths_capped(spark, sf_dir):
    """The first thirty directories of two levels with their labels, from page paths."""
    path = F.concat(F.regexp_extract("url", "^[a-z]+://[^/]*/([^/?#]+)", 1), F.lit("/"), host_of("url"), F.lit("/x.py"))
    files = table(spark, sf_dir, "pages").select(F.lit("").alias("repo"), path.alias("path"))
    return lookups.folder_structure(lookups.with_ancestors(files)).select("path", "label", "ord")


def test_patterns(spark, sf_dir):
    """Test naming of files, with the mode of the first seen."""
    forms = F.array(*[F.lit(x) for x in ("a.test.ts", "b.spec.tsx", "c_test.go", "test_d.py", "e_spec.rb", "f.py")])
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", tx.test_pattern(F.element_at(forms, (F.col("doc_id") * 7 % 6 + 1).cast("int"))).alias("pattern"))
    return lookups.mode_first_seen(rows, "pattern", ["doc_id"], ["source"], ()).select("source", "pattern", "n")


def bounded_listing(spark, sf_dir):
    """The first 500 paths in order, then those of a kind: the cap comes before the kind."""
    return review.scanned(document_files(spark, sf_dir), most=500).select("path", F.length("text").alias("chars"))


QUERIES = {
    f.__name__: f
    for f in (
        magic_number_findings, rule_findings_documents, rule_findings_pages, rule_hit_counts, all_findings_documents, rendered_findings, repeated_literals, marker_density, name_style_census,
        mode_first_seen, ordered_distinct, changed_set_union, language_lookup, longest_prefix_label, unknown_keys_anti, keyword_categories, library_categories, command_precedence, json_keys, first_paragraph, layer_report,
        top_paths_capped, test_patterns, bounded_listing,
    )
}


# DuckDB twins


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


DOCUMENT_FILES = "SELECT source || '/' || doc_id || '.txt' AS path, text FROM documents WHERE text <> ''"
PAGE_HOST = "regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)"
PAGE_FILES = f"""SELECT {PAGE_HOST} || '/' || page_id || '.ts' AS path,
    html || chr(10) || 'console.log("' || url || '"' || CASE WHEN starts_with(url, 'http://') THEN ', {{rejectUnauthorized: false}}' ELSE '' END || ')' AS text FROM pages WHERE html IS NOT NULL AND url IS NOT NULL"""
BREAKS = "coalesce(list_sum(list_transform({}, lambda x: length(x) - length(replace(x, chr(10), '')))), 0)"


def matches_sql(files: str, pattern: str, flags: str, keep: str) -> str:
    """keep, i (from 1), match, line of each match over files (keep, text)."""
    p = quoted((f"(?{flags})" if flags else "") + pattern)
    before = f"1 + {BREAKS.format('g[1:i]')} + {BREAKS.format('m[1:i - 1]')}"
    return f"""SELECT {keep}, i, m[i] AS match, ({before})::INT AS line FROM (
        SELECT {keep}, m, g, unnest(range(1, len(m) + 1)) AS i FROM (SELECT {keep}, regexp_extract_all(text, {p}) AS m, string_split_regex(text, {p}) AS g FROM ({files}) AS files WHERE regexp_matches(text, {p})) AS found) AS each_match"""


def rules_sql(files: str, rules: list[tuple]) -> str:
    parts = []
    for name, pattern, flags, globs in rules:
        skip = " AND ".join(f"NOT regexp_matches(path, {quoted(tx.glob_regex(g))}) AND NOT regexp_matches(string_split(path, '/')[-1], {quoted(tx.glob_regex(g))})" for g in globs) or "true"
        found = matches_sql(f"SELECT * FROM ({files}) AS f WHERE {skip}", pattern, flags, "path")
        parts.append(f"SELECT {quoted(name)} AS rule, line, path, left(replace(match, chr(10), ' '), 140) AS snippet FROM ({found}) AS x")
    return "\nUNION ALL\n".join(parts)


def style_sql(x: str) -> str:
    return f"CASE WHEN {x} IS NULL OR {x} = '' THEN 'unknown' WHEN contains({x}, '-') THEN 'kebab-case' WHEN contains({x}, '_') THEN 'snake_case' WHEN regexp_full_match({x}, '[A-Z][A-Za-z0-9]+') THEN 'PascalCase' WHEN regexp_full_match({x}, '[a-z][A-Za-z0-9]*') THEN 'camelCase' ELSE 'unknown' END"


def categories_sql(source: str, name: str, groups: dict) -> str:
    return " UNION ALL ".join(f"SELECT *, {quoted(k)} AS category FROM ({source}) AS s WHERE " + " OR ".join(f"contains(lower({name}), {quoted(e)})" for e in entries) for k, entries in groups.items())


def oracle_sql() -> dict[str, str]:
    some = [r for r in catalog.RULES if r[0] in ("hardcoded_credential", "placeholder", "tls_disabled")]
    languages = "CASE page_id % 6 " + " ".join(f"WHEN {i} THEN {quoted(v)}" for i, v in ((0, "python"), (1, "typescript"), (2, "cpp"), (4, "rust"), (5, "javascript"))) + " END"
    labels = "CASE " + " ".join(f"WHEN regexp_extract(path, '[^/]*$') = {quoted(k)} THEN {quoted(v)}" for k, v in catalog.DIRECTORY_LABELS.items()) + " ELSE 'application code' END"
    layers = ", ".join(f"({i + 1}, {quoted(k)})" for i, k in enumerate(catalog.LAYERS))
    groups = {"metal": ["steel", "tin", "copper", "nickel", "brass"], "finish": ["polished", "brushed", "plated", "anodized", "burnished"], "size": ["small", "medium", "large"], "mixed": ["tin", "small", "economy"]}
    words = r"SELECT name, count(*) AS n FROM (SELECT unnest(list_distinct(string_split_regex(text, '[\x20\x09-\x0D]+'))) AS name FROM documents) AS w GROUP BY name"
    page_path = "regexp_replace(" + PAGE_HOST + r", '^.*\.(example\.[a-z]+)$', '\1') || regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)"
    own = "SELECT 'n' || c_nationkey AS scope, ['lint', 'test', 'build'][c_custkey % 3 + 1] AS key, c_custkey % 2 + 1 AS level, max(CASE WHEN c_custkey % 5 = 0 THEN '  ' ELSE c_name END) AS value FROM customer GROUP BY ALL"
    root = "SELECT ['lint', 'test', 'build'][c_custkey % 3 + 1] AS key, c_custkey % 2 + 3 AS level, max(c_mktsegment) AS value FROM customer GROUP BY ALL"
    level = lambda t, k: f"(SELECT nullif(trim(max(value)), '') FROM {t} WHERE {t}.key = s.key AND level = {k}" + (" AND o.scope = s.scope)" if t == "o" else ")")
    return {
        "rule_findings_documents": rules_sql(DOCUMENT_FILES, PLAIN_RULES),
        "rule_findings_pages": rules_sql(PAGE_FILES, PLAIN_RULES),
        "rule_hit_counts": f"SELECT rule, count(*) AS hits, count(DISTINCT path) AS files FROM ({rules_sql(DOCUMENT_FILES, PLAIN_RULES)}) AS f GROUP BY rule",
        "rendered_findings": f"""SELECT CASE WHEN starts_with(path, 'src1/') THEN '[first]' WHEN starts_with(path, 'src10/') THEN '[tenth]' ELSE '' END || '[' || rule || '] ' || path || ':' || line || ' :: ' || snippet AS value FROM ({rules_sql(DOCUMENT_FILES, some)}) AS f""",
        # a number is a whole run of word characters and dots, so runs are taken first and then tested
        "magic_number_findings": "SELECT path, line, match AS snippet, row_number() OVER (PARTITION BY path ORDER BY i) - 1 AS ordinal FROM (" + matches_sql(DOCUMENT_FILES, r"[\p{L}\p{M}\p{N}_.]+", "", "path") + ") AS runs WHERE regexp_full_match(match, '1[0-9]{3,}|[2-9][0-9]{3,}')",
        "repeated_literals": f"""SELECT host, trim(literal, chr(32) || chr(9)) AS literal, count(*) AS n FROM (SELECT host, unnest(list_transform(regexp_extract_all(text, {quoted(r'''"[^'"\n\\]{10,}"|'[^'"\n\\]{10,}' '''.strip())}), lambda x: x[2:-2])) AS literal FROM (SELECT {PAGE_HOST} AS host, html AS text FROM pages) AS p) AS l
            WHERE NOT starts_with(literal, 'http://') AND NOT starts_with(literal, 'https://') GROUP BY 1, 2 HAVING count(*) >= 4""",
        "marker_density": f"SELECT doc_id, min(line) AS line, count(*)::INT AS n FROM ({matches_sql('SELECT doc_id, text FROM documents', chr(92) + 'b(trash|scum|idiot|token)' + chr(92) + 'b', 'i', 'doc_id')}) AS m GROUP BY doc_id HAVING count(*) > 5",
        "name_style_census": f"SELECT {style_sql('name')} AS style, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS name FROM part UNION ALL SELECT p_brand FROM part UNION ALL SELECT c_name FROM customer UNION ALL SELECT event_type FROM events) AS x GROUP BY 1",
        "mode_first_seen": "SELECT user_id, event_type, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, first) AS rank FROM (SELECT user_id, event_type, count(*) AS n, min({'t': ts, 'e': event_id}) AS first FROM events WHERE event_type <> 'click' GROUP BY 1, 2) AS c) AS r WHERE rank = 1",
        "ordered_distinct": "SELECT md5(text) AS digest, min(doc_id) AS first_doc_id FROM documents GROUP BY 1",
        "changed_set_union": "SELECT DISTINCT 'src/' || doc_id || '.py' AS path FROM (SELECT doc_id FROM labels WHERE toxic = 1 OR quality = 0 UNION SELECT doc_id FROM documents WHERE lang = 'es') AS d",
        "language_lookup": f"SELECT host, string_agg(language, ', ' ORDER BY language) AS languages FROM (SELECT DISTINCT {PAGE_HOST} AS host, {languages} AS language FROM pages) AS x WHERE language IS NOT NULL GROUP BY host",
        "longest_prefix_label": rf"""SELECT page_id, path, CASE WHEN path = 'example.com/en/1' OR starts_with(path, 'example.com/en/1/') THEN 'one' WHEN path = 'example.com/fr' OR starts_with(path, 'example.com/fr/') THEN 'french'
            WHEN path = 'example.com/en' OR starts_with(path, 'example.com/en/') THEN 'english' WHEN path = 'example.com' OR starts_with(path, 'example.com/') THEN 'all' ELSE '' END AS workspace FROM (SELECT page_id, regexp_replace({page_path}, '(\.html|/)$', '') AS path FROM pages) AS p""",
        "unknown_keys_anti": "SELECT name, count(*) AS n FROM (SELECT unnest(string_split(p_type, ' ')) AS name FROM part) AS w WHERE NOT EXISTS (SELECT 1 FROM nation WHERE lower(n_name) = name) AND name NOT IN ('STEEL', 'TIN') GROUP BY name",
        "keyword_categories": categories_sql("SELECT p_partkey, p_type FROM part", "p_type", groups),
        "library_categories": f"SELECT category, count(*) AS names, sum(n)::BIGINT AS documents FROM ({categories_sql(words, 'name', catalog.LIBRARIES)}) AS c GROUP BY category",
        "command_precedence": f"WITH o AS ({own}), r AS ({root}) SELECT s.scope, s.key, coalesce({level('o', 1)}, {level('o', 2)}, {level('r', 3)}, {level('r', 4)}, '') AS value FROM (SELECT scope, key FROM (SELECT DISTINCT scope FROM o UNION SELECT 'root') AS a, (SELECT DISTINCT key FROM r UNION SELECT key FROM o) AS b) AS s",
        "json_keys": "SELECT key, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS key FROM events) AS k GROUP BY key",
        "first_paragraph": r"""SELECT doc_id, coalesce(trim(list_filter(list_transform(string_split(array_to_string(list_transform(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: NOT starts_with(x, '#') AND NOT starts_with(x, '![') AND NOT starts_with(x, '[![')), lambda x: CASE WHEN x = '' THEN chr(1) ELSE x END), ' '), chr(1)), lambda x: trim(x)), lambda x: x <> '')[1]), '') AS paragraph FROM documents""",
        "layer_report": f"""SELECT l.layer, l.name, f.severity, coalesce(f.n, 0) AS n, CASE WHEN f.n IS NULL THEN 'No issues' ELSE '' END AS note FROM (VALUES {layers}) AS l(layer, name) LEFT JOIN
            (SELECT CASE WHEN toxic = 1 THEN 4 WHEN quality = 0 THEN 6 ELSE 2 END AS layer, CASE WHEN toxic = 1 THEN 'critical' WHEN quality = 0 THEN 'low' ELSE 'medium' END AS severity, count(*) AS n FROM labels GROUP BY ALL) AS f ON f.layer = l.layer""",
        "top_paths_capped": f"""SELECT path, {labels} AS label, ord::INT AS ord FROM (SELECT path, row_number() OVER (ORDER BY string_split(path, '/')) AS ord FROM (SELECT DISTINCT unnest([lang, lang || '/' || host]) AS path FROM (SELECT regexp_extract(url, '^[a-z]+://[^/]*/([^/?#]+)', 1) AS lang, {PAGE_HOST} AS host FROM pages) AS p) AS d) AS o WHERE ord <= 30""",
        "test_patterns": "SELECT source, pattern, n FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, first) AS rank FROM (SELECT source, pattern, count(*) AS n, min(doc_id) AS first FROM (SELECT source, doc_id, ['*.test.ts', '*.spec.tsx', '*_test.go', 'test_*.py', '*_spec.rb', NULL][doc_id * 7 % 6 + 1] AS pattern FROM documents) AS p WHERE pattern IS NOT NULL GROUP BY 1, 2) AS c) AS r WHERE rank = 1",
        "bounded_listing": "SELECT path, length(text)::INT AS chars FROM (SELECT source || '/' || doc_id || '.txt' AS path, text FROM documents ORDER BY path LIMIT 500) AS d WHERE text <> ''",
    }
