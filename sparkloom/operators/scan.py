"""Findings of one file each: the regex rules, counts with thresholds, and line blocks.

Input: repo, path (normalised), text. Output: repo, path, rule, line, snippet, seq; seq orders findings as the detectors
run (detector number, then ordinal). All of it is built-in expressions; only line blocks and repeated literals shuffle.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import catalog
from ..functions import text as tx

#: Detectors after the rules, in order.
TODO, LONG_PY, DOCSTRING, PY_IMPORT, LONG_JS, JS_IMPORT, AS, STRICT, REFCELL, MAGIC = range(len(catalog.RULES), len(catalog.RULES) + 10)
STEP = 1 << 32

#: Literals of which a rule's match holds at least one (lower-case ones where the rule ignores case): texts without any of
#: them are passed over by a byte search, which costs far less than the pattern.
HINTS = {
    "placeholder": ["todo", "fixme", "changeme", "dummy", "your", "lorem ipsum"],
    "swallowed_exception": ["except", "catch"],
    "sql_concatenation": ["select", "insert", "update", "delete"],
    "tls_disabled": ["verify", "rejectunauthorized", "node_tls_reject_unauthorized"],
    "secret_logging": ["console.log(", "logger."],
    "shell_injection_risk": ["subprocess.", "exec(", "spawn(", "os.system("],
    "hardcoded_ip": ["'", '"'],
    "hardcoded_credential": ["password", "secret", "api", "access", "token"],
    "debug_print": ["console.log", "print", "Print", "debugger"],
    "dead_code_marker": ["hack", "xxx", "temp", "removeme"],
    "unsafe_eval": ["eval", "new function", "exec"],
    "unhandled_promise": [".then"],
    "env_no_default": ["process.env", "os.environ"],
    "unsafe_deserialization": ["load", "unserialize"],
    "broad_exception": ["catch", "except", "rescue"],
    "hardcoded_url": ["http://", "https://"],
    "empty_catch": ["catch", "except"],
    "python_mutable_default": ["def"],
    "go_blank_identifier_error": ["err"],
    "go_panic_recover_business_logic": ["panic", "recover"],
    "csharp_throw_ex": ["throw"],
    "sql_null_blind_not_equal": ["!=", "<>"],
    "sql_window_missing_frame": ["over"],
    "php_deprecated_mysql": ["mysql_"],
    "robotic_function_name": ["calculate", "process", "handle"],
}
NUMBER = r"(?U)[1-9]\d{3}"  #: the same for long numbers, which have no literal: four digits in a row
QUOTES = ['"""', "'''"]  #: what opens a docstring


def _finding(rule: Column, line: Column, snippet: Column, detector: int, ordinal: Column) -> Column:
    return F.struct(rule.alias("rule"), line.cast("int").alias("line"), tx.snippet(snippet).alias("snippet"), (F.lit(detector * STEP) + ordinal).alias("seq"))


def _listed(files: DataFrame, lists: list[Column]) -> DataFrame:
    rows = files.select("repo", "path", F.explode(F.flatten(F.array(*lists))).alias("f"))
    return rows.select("repo", "path", "f.rule", "f.line", "f.snippet", "f.seq")


def _hits(found: Column, rule: str, detector: int) -> Column:
    return F.transform(found, lambda m: _finding(F.lit(rule), m["line"], m["match"], detector, m["ordinal"]))


def rule_findings(files: DataFrame, rules: list[tuple] = catalog.RULES) -> DataFrame:
    """One finding per match of each rule that the file's path does not exclude. rules: name, pattern, flags, globs."""
    lists = []
    files = files.select("repo", "path", "text", tx.folded("text").alias("folded"))
    for k, (name, pattern, flags, globs) in enumerate(rules):
        where = F.col("folded" if "i" in flags else "text")
        possible = functools.reduce(Column.__or__, [F.contains(where, F.lit(x)) for x in HINTS[name]]) if name in HINTS else F.rlike("text", F.lit(NUMBER)) if name == "magic_number" else None
        found = tx.matches(F.col("text"), tx.pattern_flags(flags) + pattern, possible)
        hits = _hits(found, name, k)
        lists.append(F.when(~tx.matches_any("path", globs), hits).otherwise(F.slice(hits, 1, 0)) if globs else hits)
    return _listed(files, lists)


def density(name: str, detector: int, pattern: str, flags: str, limit: int, message: Column, applies: Column) -> Column:
    """One finding at the first match, where there are more than limit."""
    found = tx.matches(F.col("text"), tx.pattern_flags(flags) + pattern)
    said = F.format_string(message, F.size(found)) if isinstance(message, str) else message
    hit = F.array(_finding(F.lit(name), F.element_at(found, 1)["line"], said, detector, F.lit(0)))
    return F.when(applies & (F.size(found) > limit), hit).otherwise(F.slice(F.array(_finding(F.lit(name), F.lit(1), F.lit(""), detector, F.lit(0))), 1, 0))


def count_findings(files: DataFrame, todo: int = catalog.TODO_LIMIT) -> DataFrame:
    """Marker densities, and PHP files without strict types in their first lines."""
    ext = F.lower(tx.suffix("path"))
    head = F.array_join(F.slice(F.split(F.ltrim(F.regexp_replace("text", r"(?dU)^\s+", "")), tx.LINE_ENDS), 1, 5), "\n")
    strict = (ext == ".php") & F.startswith(F.regexp_replace("text", r"(?dU)^\s+", ""), F.lit("<?php")) & ~F.contains(F.replace(head, F.lit(" "), F.lit("")), F.lit("declare(strict_types=1)"))
    missing = F.array(_finding(F.lit("php_missing_strict_types"), F.lit(1), F.lit("missing declare(strict_types=1)"), STRICT, F.lit(0)))
    return _listed(
        files,
        [
            density("high_todo_density", TODO, catalog.TODO_PATTERN, "i", todo, "%d TODO/FIXME markers", F.lit(True)),
            density("typescript_as_density", AS, catalog.AS_PATTERN, "", catalog.AS_LIMIT, "%d TypeScript 'as' assertions", ext.isin(".ts", ".tsx")),
            density("rust_refcell_overuse", REFCELL, catalog.REFCELL_PATTERN, "", catalog.REFCELL_LIMIT, "%d Rc<RefCell< occurrences", ext == ".rs"),
            F.when(strict, missing).otherwise(F.slice(missing, 1, 0)),
        ],
    )


def repeated_literals(files: DataFrame, keys: list[str] | None = None, least: int = catalog.MAGIC_STRING_LIMIT, places: bool = True) -> DataFrame:
    """Quoted literals of ten or more characters that occur least times or more under the keys: keys, literal, n, line, first.

    line and first (ordinal) are of the first occurrence; without places they are left out, and texts are read once only.
    Literals are trimmed; urls do not count.
    """
    keys = keys or ["repo", "path"]
    pattern = tx.pattern_flags("") + catalog.MAGIC_STRING_PATTERN
    if not places:
        quoted = files.select(*keys, F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(2))).alias("literal")).select(*keys, tx.strip("literal").alias("literal"))
        return quoted.where("NOT startswith(literal, 'http://') AND NOT startswith(literal, 'https://')").groupBy(*keys, "literal").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    found = files.select(*keys, F.posexplode(tx.matches(F.col("text"), pattern)).alias("pos", "m"))
    body = F.substring("m.match", F.lit(2), F.length("m.match") - 2)
    found = found.select(*keys, tx.strip(body).alias("literal"), F.col("m.line").alias("line"), "pos").where("NOT startswith(literal, 'http://') AND NOT startswith(literal, 'https://')")
    return found.groupBy(*keys, "literal").agg(F.count("*").alias("n"), F.min("line").alias("line"), F.min("pos").alias("first")).where(F.col("n") >= least)


def literal_findings(files: DataFrame) -> DataFrame:
    """repeated_literals of each file as findings, in the order in which they are first seen."""
    found = repeated_literals(files)
    return found.select("repo", "path", F.lit("magic_string").alias("rule"), F.col("line").cast("int").alias("line"), tx.snippet(F.col("literal")).alias("snippet"), (F.lit(MAGIC * STEP) + F.col("first")).alias("seq"))


# Line blocks


def _lines(files: DataFrame, extensions: list[str]) -> DataFrame:
    """repo, path, i (from 0), line of the files with the extensions; a line end at the very end begins no line."""
    code = files.where(F.lower(tx.suffix("path")).isin(extensions)).select("repo", "path", F.split("text", tx.LINE_ENDS).alias("lines"))
    lines = F.when(F.element_at("lines", -1) == "", F.slice("lines", 1, F.size("lines") - 1)).otherwise(F.col("lines"))
    return code.select("repo", "path", F.posexplode(lines).alias("i", "line"))


def _block_findings(hits: DataFrame) -> DataFrame:
    """Findings from hits (repo, path, i, detector, rule, snippet), numbered in each file by line and detector."""
    nth = F.row_number().over(Window.partitionBy("repo", "path").orderBy("i", "detector")) - 1
    return hits.select("repo", "path", "rule", (F.col("i") + 1).cast("int").alias("line"), F.substring("snippet", 1, catalog.SNIPPET).alias("snippet"), (F.col("detector").cast("long") * STEP + nth).alias("seq"))


def python_blocks(files: DataFrame) -> DataFrame:
    """Long functions and long docstrings of Python files.

    A function reaches from its ``def`` to whichever comes first: the next ``def``, a line that is not blank, no comment and
    indented no deeper, or the line after the last. So the lines from one ``def`` to the next are a group, which the last
    ``def`` so far names; what a docstring needs besides is the next line that holds its quotes, a running minimum from the end.
    Every line gets both by windows over its file and groups are summed up where they lie: lines are joined with nothing, since
    exploded lines look as small to the planner as the rows they come from, and a join would send them to the driver.
    """
    # plain searches come before patterns, since few lines hold a def or quotes
    rows = _lines(files, [".py"]).select("*", tx.strip("line").alias("stripped"), *[F.contains("line", F.lit(q)).alias(f"has{k}") for k, q in enumerate(QUOTES)])
    define = tx.pattern_flags("") + catalog.PY_DEF_PATTERN
    is_def = F.contains("line", F.lit("def")) & F.rlike("line", F.lit(define))
    head = F.struct(F.col("i").alias("start"), F.length(F.regexp_extract("line", define, 1)).alias("indent"), F.regexp_extract("line", define, 2).alias("name"))
    opens = F.when(F.startswith("stripped", F.lit(QUOTES[0])), 0).when(F.startswith("stripped", F.lit(QUOTES[1])), 1)
    twice = lambda k, q: F.when(F.col(f"has{k}"), (F.regexp_count("line", F.lit(q)) >= 2) & (F.col("stripped") != q)).otherwise(False)
    facts = rows.select(
        "repo", "path", "i", F.when(is_def, head).alias("head"), (F.col("stripped") != "").alias("solid"), F.startswith("stripped", F.lit("#")).alias("comment"),
        (F.length("line") - F.length(F.ltrim("line"))).alias("spaces"), opens.alias("opens"), "has0", "has1", *[twice(k, q).alias(f"closed{k}") for k, q in enumerate(QUOTES)],
    )
    down = Window.partitionBy("repo", "path").orderBy("i")
    up = Window.partitionBy("repo", "path").orderBy(F.desc("i"))
    above = F.max(F.when(F.col("solid"), F.col("i"))).over(down.rowsBetween(Window.unboundedPreceding, -1))
    placed = facts.select("*", F.last("head", ignorenulls=True).over(down.rowsBetween(Window.unboundedPreceding, 0)).alias("f"), above.alias("above"))
    later = [F.min(F.when(F.col(f"has{k}"), F.col("i"))).over(up.rowsBetween(Window.unboundedPreceding, -1)).alias(f"next{k}") for k in range(len(QUOTES))]
    placed = placed.select("*", *later, F.first("i").over(up.rowsBetween(Window.unboundedPreceding, 0)).alias("last")).where("f IS NOT NULL")
    quoted = lambda c: F.when(F.col("opens") == 0, F.col(f"{c}0")).when(F.col("opens") == 1, F.col(f"{c}1"))
    body, solid = F.col("head").isNull(), F.col("solid")
    stop = F.min(F.when(body & solid & ~F.col("comment") & (F.col("spaces") <= F.col("f.indent")), F.col("i")))
    # the first line that is not blank is the one with the def right above, blank lines aside
    told = body & solid & (F.col("above") == F.col("f.start")) & (F.col("spaces") > F.col("f.indent")) & ~quoted("closed")
    length = F.max(F.when(told, F.coalesce(quoted("next"), "last") - F.col("i") + 1))
    found = placed.groupBy("repo", "path", F.col("f.start").alias("i"), F.col("f.name").alias("name")).agg(F.coalesce(stop, F.max("i") + 1).alias("end"), length.alias("length"))
    hit = lambda where, detector, rule, *said: F.when(where, F.struct(F.lit(detector).alias("detector"), F.lit(rule).alias("rule"), F.concat("name", *said).alias("snippet")))
    long = hit(F.col("end") - F.col("i") > catalog.LONG_FUNCTION_LINES, LONG_PY, "long_function", F.lit(f" exceeds {catalog.LONG_FUNCTION_LINES} lines"))
    doc = hit(F.col("length") > catalog.LONG_DOCSTRING_LINES, DOCSTRING, "excessive_docstring", F.lit(" has a "), F.col("length").cast("string"), F.lit("-line docstring"))
    hits = found.select("repo", "path", "i", F.explode(F.array_compact(F.array(long, doc))).alias("h"))
    return _block_findings(hits.select("repo", "path", "i", "h.*"))


def brace_blocks(files: DataFrame) -> DataFrame:
    """Long functions of files with braces; braces in strings count, and what stays open counts for nothing.

    A function that starts at depth d ends at the first later line that leaves the depth at d or below. Such a line closes every
    level that it leaves, so starts and closed levels are events of (file, level), and a start's end is the next close there.
    Starts inside a function that was seen before are passed over: ends nest, so a running maximum of them tells.
    """
    start = tx.pattern_flags("") + catalog.JS_START_PATTERN
    name = F.coalesce(*[F.nullif(F.regexp_extract("line", start, g), F.lit("")) for g in (1, 2, 3)])
    delta = F.length(F.replace("line", F.lit("}"), F.lit(""))) - F.length(F.replace("line", F.lit("{"), F.lit("")))
    rows = _lines(files, [".js", ".jsx", ".ts", ".tsx"]).select("repo", "path", "i", "line", delta.alias("delta")).where("delta <> 0")
    rows = rows.select("repo", "path", "i", "delta", F.when(F.col("delta") > 0, name).alias("name"))
    down = Window.partitionBy("repo", "path").orderBy("i")
    depth = rows.withColumn("after", F.sum("delta").over(down)).withColumn("before", F.col("after") - F.col("delta"))
    closes = depth.where("delta < 0").select("repo", "path", F.explode(F.sequence("after", F.col("before") - 1)).alias("level"), "i", F.lit(None).cast("string").alias("name"))
    starts = depth.where("name IS NOT NULL").select("repo", "path", F.col("before").alias("level"), "i", "name")
    later = Window.partitionBy("repo", "path", "level").orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, -1)
    found = starts.union(closes).withColumn("end", F.min(F.when(F.col("name").isNull(), F.col("i"))).over(later)).where("name IS NOT NULL")
    found = found.withColumn("end", F.coalesce("end", F.lit(1 << 30)))
    seen = F.max("end").over(down.rowsBetween(Window.unboundedPreceding, -1))
    outer = found.withColumn("seen", F.coalesce(seen, F.lit(-1))).where("i > seen AND end < 1073741824")
    long = outer.where(F.col("end") - F.col("i") > catalog.LONG_FUNCTION_LINES)
    return _block_findings(long.select("repo", "path", "i", F.lit(LONG_JS).alias("detector"), F.lit("long_function").alias("rule"), F.concat("name", F.lit(f" exceeds {catalog.LONG_FUNCTION_LINES} lines")).alias("snippet")))


def block_findings(files: DataFrame) -> DataFrame:
    """Long functions of Python and JavaScript or TypeScript files, and long docstrings of Python files.

    Lines become rows of a few numbers each, and running sums and minima over a file's rows replace reading with state; all
    of it is linear in lines and braces, and no text is moved.
    """
    return python_blocks(files).union(brace_blocks(files))
