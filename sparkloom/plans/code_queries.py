"""Registered queries over code: files made from table rows by templates that SQL repeats, so that every detector has hits.

A part stands for one file of three pieces around its name; the DuckDB twins read the same texts with another regular
expression engine, and rules with lookaround are extracted without it and filtered afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import catalog
from ..functions import text as tx
from ..operators import lookups, scan
from ..sources import tree
from . import review
from .queries import DOCUMENT_FILES, PLAIN_RULES, matches_sql, quoted, spread, table

#: Pieces of code: for each rule some that it takes and some that come close.
PIECES = [
    "# todo: later", "todos = 1", "dummy-key = x", "try:\n    a()\nexcept:\n    pass", "except ValueError:\n    raise", "catch (e) { }", "q = 'select a from t' +\n  b", "insert into t", "get(u, verify = False)", "verify=True", "rejectUnauthorized : false",
    "console.log(a, my_token)", "console.log(a)", "logger.info(password)", "os.system('a' + b)", "os.system(a)", "ip = '999.1.1.1'", "ip = 1.1.1.1", "API_KEY = 'x'", "api_key = ''", "token: \"abc\"", "print (x)", "fingerprint(x)", "fmt.Println(1)",
    "/** HACK", "HACK", "# temp", "eval(x); exec (y)", "re.exec(y)", "new Function ()", "p.then(f)", "p.then(f).catch(g)", "p.then(f(1)) .finally(h)", "p.catch(f)", "q.then(a).then(b).catch(c).then(d)", "process.env.FOO || 1", "process.env.F ?? 2", "process.env['ABC']",
    "process.env['ABC'] || 3", "process.env.BAR", "os.environ['HOME']", "process.environ", "pickle.load (f)", "yaml.load(f)", "yaml.load(f, Loader=L)", "Marshal.load(x)", "unserialize(x)", "  rescue\nb", "rescue Foo", "except Exception as e:", "catch (Error e)", "x = 'http://localhost:1/'",
    "http://example.com/", "https://staging-7.x/", "a = 1234 + 99999", "v1.2345 0123 a1234 123", "catch { }", "catch { x }", "except KeyError: pass", "\n  def f(a, b={}):\n    c()", "def f(a=None):", "async def g(x=[]):", "_ = err", "  _, _, err := f()", "err := f()",
    "panic (x) recover()", "panicky()", "throw ex ;", "throw;", "where a != 'x' or b", "where a != 'x' or a is null", "a <> \"y\"; b is null", "sum(x) over (order by a)", "sum(x) over (order by a rows 1 preceding)", "over (partition by a)", "over (\n order by b\n)", "mysql_query(q)", "mysqli_query(q)",
    "def calculate" + "a" * 32 + " (", "def calculate(", "function processEverythingThatComesAlongTheWayHere(", "TODO FIXME TODO", "s = 'a long literal' + \"a long literal\"", "t = 'a long literal'; u = 'a long literal'", "v = 'http://a.b/c/d'",
]
EXTENSIONS = [".py", ".ts", ".js", ".go", ".rs", ".php", ".cs", ".sql", ".rb", ".java", ".md", ".json", ".txt", ".test.ts", ".d.ts", ".lock", ".cpp", ".example"]


def _at(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index % len(values) + 1).cast("int"))


def _at_sql(values: list[str], index: str) -> str:
    return f"[{', '.join(quoted(v) for v in values)}][({index}) % {len(values)} + 1]"


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """repo, path, text: one file per part."""
    key = F.col("p_partkey")
    folder = F.when(key % 11 == 0, "vendor").when(key % 7 == 0, "scripts").otherwise(F.concat(F.lit("lib"), key % 5))
    path = F.concat(folder, F.lit("/f"), key, _at(EXTENSIONS, key * 5 + 1))
    text = F.concat_ws("\n", _at(PIECES, key), _at(PIECES, key * 7 + 3), "p_name", _at(PIECES, key * 13 + 5))
    return spread(table(spark, sf_dir, "part").select(F.lit("").alias("repo"), path.alias("path"), text.alias("text")))


CODE_FILES = f"""SELECT CASE WHEN p_partkey % 11 = 0 THEN 'vendor' WHEN p_partkey % 7 = 0 THEN 'scripts' ELSE 'lib' || (p_partkey % 5) END || '/f' || p_partkey || {_at_sql(EXTENSIONS, "p_partkey * 5 + 1")} AS path,
    concat_ws(chr(10), {_at_sql(PIECES, "p_partkey")}, {_at_sql(PIECES, "p_partkey * 7 + 3")}, p_name, {_at_sql(PIECES, "p_partkey * 13 + 5")}) AS text FROM part"""
_suffixes = ", ".join(quoted(e) for e in catalog.TEXT_EXTENSIONS)
SCANNED = f"SELECT * FROM ({CODE_FILES}) AS c WHERE NOT starts_with(path, 'vendor/') AND regexp_extract(path, '[.][^.]+$') IN ({_suffixes})"


def rule_findings_code(spark, sf_dir):
    """All 26 rules over code: line, snippet and order of the matches."""
    found = scan.rule_findings(review.scanned(code_files(spark, sf_dir)))
    return found.select("rule", "line", "path", "snippet", (F.col("seq") % scan.STEP).alias("ordinal"))


def _all_matches(pattern: str, flags: str, files: str) -> str:
    """path, i, match, line, after (the text behind the match) of each match in files."""
    inner = matches_sql(files, pattern, flags, "path")
    place = "list_sum(list_transform(m[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0)"
    return inner.replace("AS line FROM (", f"AS line, substring(text, ({place})::INT + 1) AS after FROM (", 1).replace("SELECT path, m, g, unnest", "SELECT path, text, m, g, unnest").replace("(SELECT path, regexp_extract_all", "(SELECT path, text, regexp_extract_all")


def _globs(name: str) -> str:
    globs = next(r[3] for r in catalog.RULES if r[0] == name)
    return " AND ".join(f"NOT regexp_matches(path, {quoted(tx.glob_regex(g))}) AND NOT regexp_matches(string_split(path, '/')[-1], {quoted(tx.glob_regex(g))})" for g in globs) or "true"


def _picked(name: str, source: str, match: str = "match", where: str = "true") -> str:
    return f"SELECT {quoted(name)} AS rule, line, path, left(replace({match}, chr(10), ' '), 140) AS snippet, row_number() OVER (PARTITION BY path ORDER BY i) - 1 AS ordinal FROM ({source}) AS x WHERE ({where}) AND {_globs(name)}"


def lookaround_sql(files: str) -> list[str]:
    """The rules with lookaround: matched without it, then filtered by what stands before, behind or inside."""
    env = r"""process\.env(?:\.[A-Z0-9_]+|\[['"][A-Z0-9_]+['"]\])|os\.environ\[['"][A-Z0-9_]+['"]\]"""
    falls_back, dotted = r"regexp_matches(after, '^\s*(\|\||\?\?)') AND NOT starts_with(lower(match), 'os')", r"regexp_matches(match, '(?i)env\.')"
    # a stretch without .catch or .finally; if one ends it, a bracket right before that does not count
    stretches = rf"""SELECT path, k AS i, s, sum(length(s) - length(replace(s, chr(10), '')) ) OVER (PARTITION BY path ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS above, k < n AS cut FROM
        (SELECT path, unnest(parts) AS s, unnest(range(1, len(parts) + 1)) AS k, len(parts) AS n FROM (SELECT path, string_split_regex(text, '(?i)\.(catch|finally)') AS parts FROM ({files}) AS t) AS p) AS q"""
    then = rf"""SELECT path, i, regexp_extract(s, '(?is)\.then\s*\(.*\)') AS match, coalesce(above, 0) + 1 + length(head) - length(replace(head, chr(10), '')) AS line FROM
        (SELECT *, regexp_replace(s, '(?is)\.then\s*\(.*\).*$', '') AS head FROM (SELECT path, i, above, CASE WHEN cut THEN regexp_replace(s, '\)\s*$', '') ELSE s END AS s FROM ({stretches}) AS a) AS b) AS c WHERE regexp_matches(s, '(?is)\.then\s*\(.*\)')"""
    numbers = _all_matches(r"[\p{L}\p{M}\p{N}_.]+", "", files)
    return [
        _picked("unsafe_eval", _all_matches(r"\beval\s*\(|new Function\s*\(|\.?\bexec\s*\(", "i", files), where="NOT starts_with(match, '.')"),
        _picked("unhandled_promise", f"SELECT path, i, match, line::INT AS line FROM ({then}) AS t"),
        _picked("env_no_default", _all_matches(env, "i", files), f"CASE WHEN {falls_back} THEN left(match, length(match) - 1) ELSE match END", rf"NOT ({falls_back}) OR ({dotted} AND regexp_matches(match, '[A-Za-z0-9_]{{2,}}$'))"),
        _picked("unsafe_deserialization", _all_matches(r"pickle\.load\s*\(|yaml\.load\s*\(|Marshal\.load\s*\(|\bunserialize\s*\(", "is", files), where=r"NOT starts_with(lower(match), 'yaml') OR NOT regexp_matches(after, '(?is)^[^)]*Loader\s*=')"),
        _picked("magic_number", numbers, where="regexp_full_match(match, '1[0-9]{3,}|[2-9][0-9]{3,}')"),
        _picked("sql_null_blind_not_equal", _all_matches(r"""(?:!=|<>)\s*['"][^'"]+['"]""", "i", files), where=r"NOT regexp_matches(after, '(?i)^[^;\n]*(?:IS\s+NULL|IS\s+NOT\s+NULL|COALESCE|IFNULL)')"),
        _picked("sql_window_missing_frame", _all_matches(r"\bOVER\s*\([^)]*\)", "is", files), where=r"regexp_matches(match, '(?is)\bORDER\s+BY\b') AND NOT regexp_matches(match, '(?is)\b(?:ROWS|RANGE|GROUPS)\b')"),
    ]


def all_rules_sql(files: str = SCANNED) -> str:
    plain = [_picked(name, _all_matches(pattern, flags, files)) for name, pattern, flags, _ in PLAIN_RULES]
    return "\nUNION ALL\n".join(plain + lookaround_sql(files))


def all_findings_sql() -> str:
    """Every detector over documents: the rules, marker density and repeated literals; the others take no text files."""
    numbers = "CASE rule " + " ".join(f"WHEN {quoted(r[0])} THEN {k}" for k, r in enumerate(catalog.RULES)) + " END"
    todo = matches_sql(DOCUMENT_FILES, catalog.TODO_PATTERN, "i", "path")
    literals = matches_sql(DOCUMENT_FILES, r'''"[^'"\n\\]{10,}"|'[^'"\n\\]{10,}\'''', "", "path")
    return f"""SELECT CASE WHEN starts_with(path, 'src1/') THEN 'first' WHEN starts_with(path, 'src10/') THEN 'tenth' ELSE '' END AS workspace, * FROM (
        SELECT rule, line, path, snippet, ({numbers})::BIGINT * {scan.STEP} + ordinal AS seq FROM ({all_rules_sql(DOCUMENT_FILES)}) AS r
        UNION ALL SELECT 'high_todo_density', min(line), path, count(*) || ' TODO/FIXME markers', {scan.TODO * scan.STEP} FROM ({todo}) AS t GROUP BY path HAVING count(*) > {catalog.TODO_LIMIT}
        UNION ALL SELECT 'magic_string', min(line), path, left(literal, 140), {scan.MAGIC * scan.STEP} + min(i) - 1 FROM (SELECT *, trim(match[2:-2]) AS literal FROM ({literals}) AS m) AS l WHERE NOT starts_with(literal, 'http') GROUP BY path, literal HAVING count(*) >= 4) AS f"""


# Counts per file


def counted_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files in which a marker stands a number of times around its limit."""
    key = F.col("p_partkey")
    piece = _at(["x # TODO a\n", "y as any;\n", "Rc < RefCell<T>>\n", "fixme. z as Foo<T>\n", "$a = 1;\n"], key)
    head = F.when(key % 5 == 0, F.concat(F.lit(" \n<?php\n"), F.repeat(F.lit("//\n"), (key % 6).cast("int")), F.lit("declare( strict_types = 1 );\n"))).when(key % 5 < 3, F.lit("<?php\n")).otherwise("")
    text = F.concat(head, F.repeat(piece, (key % 9).cast("int")), F.lit("end"))
    path = F.concat(F.lit("c"), key, _at([".ts", ".rs", ".php", ".tsx", ".py", ".PHP"], key * 7 + 2))
    return spread(table(spark, sf_dir, "part").select(F.lit("").alias("repo"), path.alias("path"), text.alias("text")))


COUNTED_FILES = f"""SELECT 'c' || p_partkey || {_at_sql([".ts", ".rs", ".php", ".tsx", ".py", ".PHP"], "p_partkey * 7 + 2")} AS path,
    CASE WHEN p_partkey % 5 = 0 THEN ' ' || chr(10) || '<?php' || chr(10) || repeat('//' || chr(10), p_partkey % 6) || 'declare( strict_types = 1 );' || chr(10) WHEN p_partkey % 5 < 3 THEN '<?php' || chr(10) ELSE '' END
    || repeat({_at_sql(["x # TODO a" + chr(10), "y as any;" + chr(10), "Rc < RefCell<T>>" + chr(10), "fixme. z as Foo<T>" + chr(10), "$a = 1;" + chr(10)], "p_partkey")}, p_partkey % 9) || 'end' AS text FROM part"""


def count_findings_code(spark, sf_dir):
    """Marker densities and PHP files without strict types, around their limits."""
    return scan.count_findings(review.scanned(counted_files(spark, sf_dir))).select("rule", "line", "path", "snippet")


def _density_sql(rule: str, pattern: str, flags: str, limit: int, said: str, where: str) -> str:
    found = matches_sql(COUNTED_FILES, pattern, flags, "path")
    return f"SELECT {quoted(rule)} AS rule, min(line) AS line, path, count(*) || {quoted(said)} AS snippet FROM ({found}) AS m WHERE {where} GROUP BY path HAVING count(*) > {limit}"


def count_findings_sql() -> str:
    strict = r"""SELECT 'php_missing_strict_types' AS rule, 1 AS line, path, 'missing declare(strict_types=1)' AS snippet FROM (SELECT path, regexp_replace(text, '^\s+', '') AS text FROM ({files}) AS f) AS t
        WHERE regexp_matches(path, '(?i)[.]php$') AND starts_with(text, '<?php') AND NOT contains(replace(array_to_string(string_split(text, chr(10))[1:5], chr(10)), ' ', ''), 'declare(strict_types=1)')""".replace("{files}", COUNTED_FILES)
    return "\nUNION ALL\n".join(
        [
            _density_sql("high_todo_density", catalog.TODO_PATTERN, "i", catalog.TODO_LIMIT, " TODO/FIXME markers", "true"),
            _density_sql("typescript_as_density", catalog.AS_PATTERN, "", catalog.AS_LIMIT, " TypeScript 'as' assertions", "regexp_matches(path, '[.]tsx?$')"),
            _density_sql("rust_refcell_overuse", catalog.REFCELL_PATTERN, "", catalog.REFCELL_LIMIT, " Rc<RefCell< occurrences", "path LIKE '%.rs'"),
            strict,
        ]
    )


def literal_findings_code(spark, sf_dir):
    """Quoted literals that a file repeats, in the order in which they are first seen."""
    key = F.col("p_partkey")
    text = F.concat(F.lit("\n"), F.repeat(F.concat(F.lit("a = '"), "p_name", F.lit("', ")), (key % 7).cast("int")), F.repeat(F.concat(F.lit('\n" '), "p_type", F.lit(' "')), (key % 6).cast("int")), F.lit(" 'http://x.y/zzzzzzz'" * 5))
    files = table(spark, sf_dir, "part").select(F.lit("").alias("repo"), F.concat(F.lit("l"), key, F.lit(".py")).alias("path"), text.alias("text"))
    found = scan.literal_findings(spread(files))
    return found.select("path", "line", "snippet", (F.col("seq") % scan.STEP).cast("int").alias("first"))


LITERAL_FILES = "SELECT 'l' || p_partkey || '.py' AS path, chr(10) || repeat('a = ''' || p_name || ''', ', p_partkey % 7) || repeat(chr(10) || '\" ' || p_type || ' \"', p_partkey % 6) || repeat(' ''http://x.y/zzzzzzz''', 5) AS text FROM part"


def literal_findings_sql() -> str:
    found = matches_sql(LITERAL_FILES, r'''"[^'"\n\\]{10,}"|'[^'"\n\\]{10,}\'''', "", "path")
    return f"SELECT path, min(line) AS line, left(literal, 140) AS snippet, min(i)::INT - 1 AS first FROM (SELECT *, trim(match[2:-2]) AS literal FROM ({found}) AS m) AS l WHERE NOT starts_with(literal, 'http') GROUP BY path, literal HAVING count(*) >= 4"


# Line blocks


def block_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions and docstrings of lengths around the limits, nested, tabbed, open at the end; braces in strings."""
    key = F.col("p_partkey")
    n = (F.lit(74) + key % 13).cast("int")
    doc = F.concat(F.lit('    """Doc\n'), F.repeat(F.lit("    more\n"), (key % 8).cast("int")), F.lit('    """\n'))
    py = F.concat(F.lit("import os\n\ndef f(a):\n"), F.when(key % 4 < 2, doc).otherwise("    # c\n\n"), F.repeat(F.lit("    x = 1\n"), n), F.when(key % 5 == 0, F.lit("# note\n    y = 2\n")).otherwise(""), F.when(key % 3 == 0, F.lit("z = 3\n")).when(key % 3 == 1, F.concat(F.lit("    async def g():\n"), F.repeat(F.lit("        q()\n"), n))).otherwise(""))
    js = F.concat(F.lit("// x\n"), _at(["export async function go(", "const go = async (", "  go("], key), F.lit("a, b)"), _at([" {\n", " => {\n", " {\n"], key), F.repeat(F.lit('  s("{", "}");\n'), n - 1), F.when(key % 7 == 0, F.lit("  if (x) {\n")).otherwise(""), F.lit("}\nlast()\n"))
    ext = _at([".py", ".js", ".tsx"], key)
    return spread(table(spark, sf_dir, "part").select(F.lit("").alias("repo"), F.concat(F.lit("b"), key, ext).alias("path"), F.when(ext == ".py", py).otherwise(js).alias("text")))


BLOCK_FILES = rf"""SELECT 'b' || p_partkey || {_at_sql([".py", ".js", ".tsx"], "p_partkey")} AS path, CASE WHEN p_partkey % 3 = 0
    THEN 'import os' || chr(10) || chr(10) || 'def f(a):' || chr(10) || CASE WHEN p_partkey % 4 < 2 THEN '    {'"' * 3}Doc' || chr(10) || repeat('    more' || chr(10), p_partkey % 8) || '    {'"' * 3}' || chr(10) ELSE '    # c' || chr(10) || chr(10) END
        || repeat('    x = 1' || chr(10), 74 + p_partkey % 13) || CASE WHEN p_partkey % 5 = 0 THEN '# note' || chr(10) || '    y = 2' || chr(10) ELSE '' END
        || CASE p_partkey % 3 WHEN 0 THEN 'z = 3' || chr(10) WHEN 1 THEN '    async def g():' || chr(10) || repeat('        q()' || chr(10), 74 + p_partkey % 13) ELSE '' END
    ELSE '// x' || chr(10) || {_at_sql(["export async function go(", "const go = async (", "  go("], "p_partkey")} || 'a, b)' || {_at_sql([" {" + chr(10), " => {" + chr(10), " {" + chr(10)], "p_partkey")} || repeat('  s("{{", "}}");' || chr(10), 73 + p_partkey % 13)
        || CASE WHEN p_partkey % 7 = 0 THEN '  if (x) {{' || chr(10) ELSE '' END || '}}' || chr(10) || 'last()' || chr(10) END AS text FROM part"""


def block_findings_code(spark, sf_dir):
    """Long functions of Python and JavaScript, and long docstrings."""
    return scan.block_findings(review.scanned(block_files(spark, sf_dir))).select("rule", "line", "path", "snippet")


def block_findings_sql() -> str:
    lines = f"""SELECT path, line, i, n, length(line) - length(ltrim(line, ' ')) AS indent FROM (SELECT path, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS i, len(l) AS n FROM
        (SELECT path, string_split(regexp_replace(text, '\\n$', ''), chr(10)) AS l FROM ({BLOCK_FILES}) AS f) AS s) AS u"""
    quotes = "'" + '"' * 3 + "'"
    return rf"""WITH lines AS ({lines}),
        defs AS (SELECT path, i, n, indent, name, coalesce(lead(i) OVER (PARTITION BY path ORDER BY i), n + 1) AS next FROM (SELECT *, regexp_extract(line, '^\s*(?:async\s+def|def)\s+([A-Za-z_][A-Za-z0-9_]*)\s*\(', 1) AS name FROM lines WHERE path LIKE '%.py') AS d WHERE name <> ''),
        bodies AS (SELECT d.path, d.i, d.n, d.indent, d.name, d.next, l.i AS k, l.line, l.indent AS deep FROM defs AS d JOIN lines AS l ON l.path = d.path AND l.i > d.i AND l.i < d.next AND trim(l.line) <> ''),
        ends AS (SELECT d.path, d.i, d.name, least(d.next, coalesce(min(b.k) FILTER (b.deep <= d.indent AND NOT starts_with(ltrim(b.line), '#')), d.next)) AS stop FROM defs AS d LEFT JOIN bodies AS b ON b.path = d.path AND b.i = d.i GROUP BY d.path, d.i, d.name, d.next),
        opened AS (SELECT * FROM bodies QUALIFY row_number() OVER (PARTITION BY path, i ORDER BY k) = 1),
        docs AS (SELECT o.path, o.i, o.name, o.k, min(l.i) AS shut FROM opened AS o JOIN lines AS l ON l.path = o.path AND l.i > o.k AND contains(l.line, {quotes}) WHERE o.deep > o.indent AND starts_with(ltrim(o.line), {quotes}) GROUP BY ALL),
        depths AS (SELECT *, sum(length(replace(line, '}}', '')) - length(replace(line, '{{', ''))) OVER (PARTITION BY path ORDER BY i) AS depth FROM lines WHERE path NOT LIKE '%.py'),
        heads AS (SELECT path, i, depth, regexp_extract(line, '(?:function\s+|const\s+|^\s*)([A-Za-z_$][A-Za-z0-9_$]*)(?:\s*=\s*async\s*)?\s*\(', 1) AS name FROM depths WHERE regexp_matches(line, '^\s*(?:export\s+async\s+function\s+go|const\s+go|go)\b.*\{{')),
        shuts AS (SELECT h.path, h.i, h.name, min(d.i) AS stop FROM heads AS h JOIN depths AS d ON d.path = h.path AND d.i > h.i AND d.depth < h.depth GROUP BY ALL)
        SELECT 'long_function' AS rule, i::INT AS line, path, name || ' exceeds 80 lines' AS snippet FROM ends WHERE stop - i > 80
        UNION ALL SELECT 'excessive_docstring', i::INT, path, name || ' has a ' || (shut - k + 1) || '-line docstring' FROM docs WHERE shut - k + 1 > 5
        UNION ALL SELECT 'long_function', i::INT, path, name || ' exceeds 80 lines' FROM shuts WHERE stop - i > 80""".replace("{{", "{").replace("}}", "}")


# Imports

IMPORTS = [
    "import os", "import numpy as np", "from flask import x", "import leftpad.core", "from _private import y", "from tools.sub import z", "  import yaml, json", "from . import w", "import React from 'react'", "const a = require('lodash/fp')", "import '@scope/pkg/deep'", "import x from './local'",
    "require( \"fs\" )", "import { a } from 'node:path'", "import b from '@/c'", "import 'left-pad'", "from vendor.lib import q", "import emptydir",
]
PACKAGES = ['{"dependencies": {"react": "1", "lodash": "4"}}', '{"devDependencies": {"left-pad": "1"}, "peerDependencies": {"@scope/pkg": "2"}}', '{"name": "x"}', "{bad"]


def import_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repositories by size of the part: code in src, a package.json in some, and a directory that holds no text."""
    part = table(spark, sf_dir, "part")
    key, repo = F.col("p_partkey"), F.concat(F.lit("r"), F.col("p_size"))
    code = part.select(repo.alias("repo"), F.concat(F.lit("src/i"), key, _at([".py", ".ts", ".jsx"], key)).alias("path"), F.concat_ws("\n", F.lit("x"), _at(IMPORTS, key), _at(IMPORTS, key * 5 + 1), _at(IMPORTS, key * 11 + 7)).alias("text"))
    repos = part.select(F.col("p_size").alias("n"), repo.alias("repo")).distinct()
    packages = repos.where("n % 5 < 4").select("repo", F.lit("package.json").alias("path"), _at(PACKAGES, F.col("n") % 5).alias("text"))
    others = repos.where("n % 2 = 0").select("repo", F.lit("tools/picture.png").alias("path"), F.lit("p").alias("text")).union(repos.where("n % 3 = 0").select("repo", F.lit("vendor/x.py"), F.lit("y")))
    return code.union(packages).union(others)


IMPORT_CODE = f"""SELECT 'r' || p_size AS repo, 'src/i' || p_partkey || {_at_sql([".py", ".ts", ".jsx"], "p_partkey")} AS path, p_size AS size,
    concat_ws(chr(10), 'x', {_at_sql(IMPORTS, "p_partkey")}, {_at_sql(IMPORTS, "p_partkey * 5 + 1")}, {_at_sql(IMPORTS, "p_partkey * 11 + 7")}) AS text FROM part"""


def unknown_imports_code(spark, sf_dir):
    """Imports that neither the language, the repository's packages nor its directories explain."""
    files = import_files(spark, sf_dir)
    code = review.scanned(files)
    found = lookups.unknown_python_imports(code, lookups.top_directories(files)).union(lookups.unknown_js_imports(code, lookups.package_dependencies(files)))
    return found.select("repo", "path", "rule", "line", "snippet")


def unknown_imports_sql() -> str:
    outside = ", ".join(quoted(b) for b in catalog.JS_BUILTINS)
    known = ", ".join(quoted(b) for b in sorted({"os", "json", "yaml"} & set(catalog.PY_STDLIB)) + catalog.PY_ALLOWED)
    # one import a line, as the pieces are written
    lines = f"SELECT repo, path, size, unnest(l) AS text, unnest(range(1, len(l) + 1))::INT AS line FROM (SELECT *, string_split(text, chr(10)) AS l FROM ({IMPORT_CODE}) AS c) AS s"
    js = r"""SELECT *, regexp_extract(text, '(?:import\s+(?:[^''"]+?\s+from\s+)?|require\s*\()\s*[''"]([^''"]+)[''"]', 1) AS s FROM lines WHERE path NOT LIKE '%.py'"""
    py = r"""SELECT *, regexp_extract(text, '^\s*(?:from\s+([A-Za-z_][\w.]*)\s+import|import\s+[A-Za-z_])', 1) AS f, regexp_extract(text, '^\s*import\s+([A-Za-z_][\w.]*)', 1) AS g FROM lines WHERE path LIKE '%.py'"""
    return f"""WITH lines AS ({lines}), packages AS (SELECT 'r' || n AS repo, {_at_sql(PACKAGES, "n % 5")} AS j FROM (SELECT DISTINCT p_size AS n FROM part) AS d WHERE n % 5 < 3),
        deps AS (SELECT repo, unnest(list_concat(list_concat(coalesce(json_keys(j, '$.dependencies'), []), coalesce(json_keys(j, '$.devDependencies'), [])), coalesce(json_keys(j, '$.peerDependencies'), []))) AS name FROM packages)
        SELECT repo, path, 'unknown_dependency_import' AS rule, line, s AS snippet FROM ({js}) AS x WHERE s <> '' AND s NOT IN ({outside}) AND NOT regexp_matches(s, '^([./#]|@/|node:)') AND repo IN (SELECT repo FROM deps)
            AND NOT EXISTS (SELECT 1 FROM deps WHERE deps.repo = x.repo AND deps.name = CASE WHEN s LIKE '@%' THEN array_to_string(string_split(s, '/')[1:2], '/') ELSE string_split(s, '/')[1] END)
        UNION ALL SELECT repo, path, 'unknown_dependency_import', line, name FROM (SELECT *, string_split(CASE WHEN f <> '' THEN f ELSE g END, '.')[1] AS name FROM ({py}) AS p) AS y
            WHERE name <> '' AND NOT starts_with(name, '_') AND name NOT IN ({known}) AND name <> 'src' AND NOT (name = 'tools' AND size % 2 = 0)"""


# Languages, records, names


def tree_languages(spark, sf_dir):
    """Languages of each host's files below a root: a skipped directory above the checkout hides all of them."""
    root = _at(["/home/a", "/srv/build/b", "/home/vendor.d"], F.col("page_id"))
    path = F.concat(_at(["src/", "node_modules/x/", "target/", ".github/"], F.col("page_id") * 3 + 1), _at(["a.py", "b.TSX", "c.h", "d.md", "e.rs", "f.mjs", "g.php"], F.col("page_id")))
    files = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1).alias("repo"), root.alias("root"), path.alias("path"))
    return lookups.languages(files.where(tx.kept_for_languages("root", "path")).unionByName(files.select("repo", F.lit("").alias("root"), F.lit("").alias("path")).distinct()), ["repo"])


def tree_languages_sql() -> str:
    ext = "regexp_extract(path, '[.][^.]+$')"
    names = "CASE lower(" + ext + ") " + " ".join(f"WHEN {quoted(e)} THEN {quoted(v)}" for e, v in catalog.LANGUAGES.items()) + " END"
    return f"""SELECT repo, coalesce(string_agg(DISTINCT language, ', ' ORDER BY language), 'none') AS languages FROM (SELECT repo, CASE WHEN NOT list_has_any(string_split(root || '/' || path, '/'), [{", ".join(quoted(x) for x in catalog.LANGUAGE_SKIPPED)}]) THEN {names} END AS language FROM
        (SELECT regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS repo, {_at_sql(["/home/a", "/srv/build/b", "/home/vendor.d"], "page_id")} AS root, {_at_sql(["src/", "node_modules/x/", "target/", ".github/"], "page_id * 3 + 1")} || {_at_sql(["a.py", "b.TSX", "c.h", "d.md", "e.rs", "f.mjs", "g.php"], "page_id")} AS path FROM pages) AS p) AS l GROUP BY repo"""


def review_records(spark, sf_dir):
    """Finding and verification records in the report's shape."""
    labels = table(spark, sf_dir, "labels")
    severity = F.when(F.col("toxic") == 1, "critical").otherwise("low")
    found = labels.where("toxic = 1 OR quality = 0").select(severity.alias("severity"), F.concat(F.lit("Document "), "doc_id").alias("title"), F.when(F.col("toxic") == 1, 4).otherwise(6).alias("layer"), F.concat(F.lit("docs/"), "doc_id", F.lit(":1")).alias("location"), F.lit("i").alias("impact"), F.lit("e").alias("evidence"), F.lit("f").alias("fix"))
    checks = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n")).select(F.concat(F.lit("count "), "event_type").alias("command"), (F.col("n") % 2).cast("int").alias("exit_code"), F.col("n").cast("string").alias("output"), F.lit("counted").alias("interpretation"))
    return review.finding_records(found).select("value").union(review.verification_records(checks).select("value"))


def review_records_sql() -> str:
    titles = "CASE layer " + " ".join(f"WHEN {i + 1} THEN {quoted(k)}" for i, k in enumerate(catalog.LAYER_TITLES)) + " END"
    return f"""SELECT concat_ws(chr(10), '### [' || severity || '] Document ' || doc_id, '', '- Layer: Layer ' || layer || ': ' || {titles}, '- Location: `docs/' || doc_id || ':1`', '- Impact: i', '- Evidence: e', '- Fix: f') AS value
        FROM (SELECT doc_id, CASE WHEN toxic = 1 THEN 'Critical' ELSE 'Low' END AS severity, CASE WHEN toxic = 1 THEN 4 ELSE 6 END AS layer FROM labels WHERE toxic = 1 OR quality = 0) AS f
        UNION ALL SELECT concat_ws(chr(10), '- Command: `count ' || event_type || '`', '- Exit code: `' || (n % 2) || '`', '- Relevant output: `' || n || '`', '- Interpretation: `counted`') FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1) AS e"""


def branch_diff(spark, sf_dir):
    """Changed paths against a merge base, against a base without one, and without a base."""
    labels, key = table(spark, sf_dir, "labels"), F.col("doc_id").cast("string")
    paths = lambda where, folder, ext=".py": labels.where(where).select(F.concat(F.lit(folder), key, F.lit(ext)).alias("path"))
    working = [paths("toxic = 1", "./src/"), paths("quality = 0", "src/"), labels.where("doc_id % 50 = 0").select(F.lit(" \t").alias("path"))]
    merge, base = paths("doc_id % 3 = 0", "src/", ".ts"), paths("doc_id % 2 = 0", "lib//")
    kinds = {"merge base": (merge, base), "base": (None, base), "none": (None, None)}
    parts = [lookups.branch_changes(working, *given).select(F.lit(kind).alias("kind"), "path") for kind, given in kinds.items()]
    return parts[0].union(parts[1]).union(parts[2])


BRANCH_DIFF_SQL = """WITH w AS (SELECT 'src/' || doc_id || '.py' AS path FROM labels WHERE toxic = 1 OR quality = 0), m AS (SELECT 'src/' || doc_id || '.ts' AS path FROM labels WHERE doc_id % 3 = 0), b AS (SELECT 'lib/' || doc_id || '.py' AS path FROM labels WHERE doc_id % 2 = 0)
    SELECT 'merge base' AS kind, path FROM (SELECT path FROM w UNION SELECT path FROM m) AS x UNION ALL SELECT 'base', path FROM (SELECT path FROM w UNION SELECT path FROM b) AS y UNION ALL SELECT 'none', path FROM (SELECT DISTINCT path FROM w) AS z"""


def decoded_contents(spark, sf_dir):
    """Texts from bytes: what does not decode goes, line ends become newlines, binaries and unreadable files are left out."""
    key = F.col("doc_id")
    bytes_ = F.concat(F.encode("text", "utf-8"), F.when(key % 3 == 0, F.unhex(F.lit("FF0D0A41C3"))).when(key % 3 == 1, F.unhex(F.lit("0D42E282"))).otherwise(F.unhex(F.lit("EFBBBF0A"))), F.when(key % 7 == 0, F.unhex(F.lit("00"))).otherwise(F.unhex(F.lit(""))))
    files = table(spark, sf_dir, "documents").select("source", key, F.when(key % 11 == 0, F.lit(None)).otherwise(bytes_).alias("content"))
    read = tree.decoded(spread(files.select(F.col("source").alias("repo"), key.cast("string").alias("path"), "content")))
    return read.select("repo", "path", F.md5("text").alias("digest"), F.length("text").alias("chars"))


DECODED_SQL = """SELECT repo, path, md5(text) AS digest, length(text)::INT AS chars FROM (SELECT source AS repo, doc_id::VARCHAR AS path, text || CASE doc_id % 3 WHEN 0 THEN chr(10) || 'A' WHEN 1 THEN chr(10) || 'B' ELSE chr(65279) || chr(10) END AS text FROM documents WHERE doc_id % 7 <> 0 AND doc_id % 11 <> 0) AS d"""


def review_dimensions(spark, sf_dir):
    """The review's fixed tables side by side, joined to the findings that labels stand for."""
    d = lambda n: lookups.dimension(spark, n)
    layers = d("layer").join(d("layer_category"), "layer").select(F.concat_ws("/", "name", "category").alias("name"), F.col("layer").cast("double").alias("value"))
    rows = layers.union(d("risk_multiplier").toDF("name", "value")).union(d("bug_bucket").toDF("name", "value")).union(d("severity").select("severity", F.col("ord").cast("double"))).union(d("critical_risk").select("risk", F.lit(1.0)))
    n = table(spark, sf_dir, "labels").agg(F.count("*").alias("n"))
    return rows.crossJoin(F.broadcast(n)).select("name", (F.col("value") * F.col("n")).alias("weight"))


def review_dimensions_sql() -> str:
    rows = [(f"{k}/{x}", i + 1) for i, (k, xs) in enumerate(catalog.LAYERS.items()) for x in xs] + [*catalog.RISK_MULTIPLIERS.items(), *catalog.BUG_BUCKETS.items()] + [(s, i + 1) for i, s in enumerate(catalog.SEVERITIES)] + [(r, 1) for r in catalog.CRITICAL_RISKS]
    return f"SELECT name, value * (SELECT count(*) FROM labels) AS weight FROM (VALUES {', '.join(f'({quoted(k)}, {v}::DOUBLE)' for k, v in rows)}) AS v(name, value)"


NAMES = ["Foo.test.tsx", "bar.d.ts", ".env", "archive.tar.gz", "Makefile", "trailing.", "x.spec.js", "a/b/.hidden/c.py", "src/.github/d.yml", "node_modules/e.js", "./../f.ts", "lib//g.py", "UPPER.PY", "no_ext/file", "Cargo.lock"]
SPECIFIERS = ["react", "lodash/fp", "@scope/pkg/deep/er", "@only", "", "a/", "requests[socks]>=2", "numpy ~= 1", "x<y"]


def path_functions(spark, sf_dir):
    """Stems, suffixes, compound names, hidden and ignored paths, globs, package and requirement names."""
    base = table(spark, sf_dir, "part").select("p_partkey", _at(NAMES, F.col("p_partkey")).alias("path"), _at(SPECIFIERS, F.col("p_partkey") * 4 + 1).alias("spec"))
    return base.select(
        "p_partkey", tx.stem("path").alias("stem"), tx.suffix("path").alias("suffix"), tx.stripped_name("path").alias("stripped"), tx.is_hidden_or_skipped("path").alias("hidden"), tx.is_ignored(tx.normalize_path("path"), ["lib/"]).alias("ignored"), tx.normalize_path("path").alias("normal"),
        tx.matches_any("path", ["*.ts*", "[!a-z]*.py", "?ar.d.ts"]).alias("globbed"), tx.package_name("spec").alias("package"), tx.requirement_name("spec").alias("requirement"),
    )


def path_functions_sql() -> str:
    name = "string_split(path, '/')[-1]"
    skipped = ", ".join(quoted(x) for x in catalog.IGNORED_PARTS)
    compound = "CASE " + " ".join(f"WHEN ends_with({name}, {quoted(s)}) THEN left({name}, length({name}) - {len(s)})" for s in catalog.STRIPPED_SUFFIXES) + " ELSE stem END"
    return rf"""SELECT p_partkey, stem, suffix, {compound} AS stripped, list_has_any(string_split(path, '/'), [{skipped}]) OR len(list_filter(string_split(path, '/'), lambda p: starts_with(p, '.') AND p <> '.github')) > 0 AS hidden,
        list_has_any(string_split(normal, '/'), [{skipped}]) OR string_split(normal, '/')[-1] IN ({", ".join(quoted(x) for x in catalog.LOCKFILES)}) OR starts_with(normal, 'lib/') AS ignored, normal,
        path SIMILAR TO '.*\.ts.*' OR regexp_matches({name}, '^[^a-z].*\.py$') OR regexp_matches(path, '^[^a-z].*\.py$') OR {name} = 'bar.d.ts' AS globbed,
        CASE WHEN starts_with(spec, '@') THEN array_to_string(string_split(spec, '/')[1:2], '/') ELSE string_split(spec, '/')[1] END AS package, regexp_extract(spec, '^[^<>=!~\s\[]*') AS requirement
        FROM (SELECT *, ltrim(regexp_replace(replace(path, '//', '/'), '/[.]/', '/', 'g'), './') AS normal, left({name}, length({name}) - length(suffix)) AS stem FROM (SELECT p_partkey, path, spec, regexp_extract({name}, '^.+([.][^.]+)$', 1) AS suffix FROM
            (SELECT p_partkey, {_at_sql(NAMES, "p_partkey")} AS path, {_at_sql(SPECIFIERS, "p_partkey * 4 + 1")} AS spec FROM part) AS p) AS s) AS t"""


QUERIES = {f.__name__: f for f in (rule_findings_code, count_findings_code, literal_findings_code, block_findings_code, unknown_imports_code, tree_languages, branch_diff, decoded_contents, review_records, review_dimensions, path_functions)}


def oracle_sql() -> dict[str, str]:
    return {
        "all_findings_documents": all_findings_sql(),
        "rule_findings_code": all_rules_sql(),
        "count_findings_code": count_findings_sql(),
        "literal_findings_code": literal_findings_sql(),
        "block_findings_code": block_findings_sql(),
        "unknown_imports_code": unknown_imports_sql(),
        "tree_languages": tree_languages_sql(),
        "branch_diff": BRANCH_DIFF_SQL,
        "decoded_contents": DECODED_SQL,
        "review_records": review_records_sql(),
        "review_dimensions": review_dimensions_sql(),
        "path_functions": path_functions_sql(),
    }
