"""Rules and detectors against a plain Python oracle and against values derived by hand."""

import random
import re

import pytest

from sparkloom.functions import catalog
from sparkloom.functions import text as tx
from sparkloom.operators import lookups, scan
from sparkloom.plans import review

FLAGS = {"i": re.I, "m": re.M, "s": re.S}
#: For each rule a text that it takes and one that it leaves.
CASES = {
    "placeholder": ("x\n# todo: y", "todos"),
    "swallowed_exception": ("try:\n a\nexcept:\n pass", "except ValueError:\n raise"),
    "sql_concatenation": ("q = 'select a' +\n b + 'x'", "insert only"),
    "tls_disabled": ("get(u, verify = False)", "verify=True"),
    "secret_logging": ("console.log(a, my_token)", "console.log(a)"),
    "shell_injection_risk": ("os.system('a' + b)", "os.system('a')"),
    "hardcoded_ip": ("ip = '999.1.1.1'", "ip = 1.1.1.1"),
    "hardcoded_credential": ("API_KEY = 'x'", "api_key = ''"),
    "debug_print": ("a\nprint (x)", "fingerprint(x)"),
    "dead_code_marker": ("/** HACK", "HACK"),
    "unsafe_eval": ("eval(x); exec (y)", "re.exec(y)"),
    "unhandled_promise": ("p.then(f)", "p.catch(f)"),
    "env_no_default": ("process.env.FOO || 1", "process.environ"),
    "unsafe_deserialization": ("yaml.load(f)", "yaml.load(f, Loader=L)"),
    "broad_exception": ("a\n\n  rescue\nb", "rescue Foo"),
    "hardcoded_url": ("http://localhost:1/", "http://example.com/"),
    "magic_number": ("a = 1234 + 99999", "v1.2345 0123 a1234 123"),
    "empty_catch": ("catch { }", "catch { x }"),
    "python_mutable_default": ("\n\n  def f(a, b={}):", "def f(a=None):"),
    "go_blank_identifier_error": ("x\n_ = err\n\n  _, _, err := f()", "err := f()"),
    "go_panic_recover_business_logic": ("panic (x) recover()", "panicky()"),
    "csharp_throw_ex": ("throw ex ;", "throw;"),
    "sql_null_blind_not_equal": ("a != 'x' or b", "a != 'x' or a is null"),
    "sql_window_missing_frame": ("over (order by a)", "over (order by a rows 1 preceding)"),
    "php_deprecated_mysql": ("mysql_query(", "mysqli_query("),
    "robotic_function_name": ("def calculate" + "a" * 32 + " (", "def calculate("),
}


def expected(path, text):
    out = []
    for k, (name, pattern, flags, globs) in enumerate(catalog.RULES):
        import fnmatch

        if any(fnmatch.fnmatch(x, g) for g in globs for x in (path, path.split("/")[-1])):
            continue
        for i, m in enumerate(re.finditer(pattern, text, sum(FLAGS[f] for f in flags))):
            out.append((name, text.count("\n", 0, m.start()) + 1, m.group().replace("\n", " ")[:140], k * scan.STEP + i))
    return out


def test_every_rule_has_cases():
    assert list(CASES) == [r[0] for r in catalog.RULES]


def test_hints_stand_in_every_match():
    """Each rule's positive case, in several spellings, holds a hint; the only rule without hints is the one of numbers."""
    assert set(scan.HINTS) == {r[0] for r in catalog.RULES} - {"magic_number"}
    for name, pattern, flags, _ in catalog.RULES:
        for text in (CASES[name][0], CASES[name][0].upper(), CASES[name][0].replace("s", "\u017f").replace("k", "\u212a").replace("i", "\u0131")):
            for m in re.finditer(pattern, text, sum(FLAGS[f] for f in flags)):
                assert name != "magic_number" or re.search(scan.NUMBER.removeprefix("(?U)"), m.group())
                low = m.group().translate(str.maketrans("\u0130\u0131\u017f\u212a", "iisk")).lower() if "i" in flags else m.group()
                assert name == "magic_number" or any(h in low for h in scan.HINTS[name]), (name, m.group())


def test_matches_are_linear(spark):
    """100,000 matches in one text, some of them over line ends, and texts that hold the mark itself."""
    text = "x = 12345\nfoo 99999 " * 50_000
    df = spark.createDataFrame([(text,), ("\u0001 12345\n\u000112345\u0001\n\n\u0001",)], "text string")
    got = df.select(tx.matches(df.text, r"(?dU)(?<![\w.])(1\d{3,}|[2-9]\d{3,})(?![\w.])").alias("m")).collect()
    assert len(got[0].m) == 100_000 and [r.line for r in got[0].m[:4]] == [1, 2, 2, 3] and got[0].m[-1].line == 50_001
    assert [(r.line, r.ordinal) for r in got[1].m] == [(1, 0), (2, 1)]
    many = spark.createDataFrame([("a\n\nb" * 9,)], "text string")
    assert [r.line for r in many.select(tx.matches(many.text, "(?d)\n\n").alias("m")).first().m] == [1 + 2 * i for i in range(9)]


def test_letters_that_fold_to_ascii(spark):
    """Long s, Kelvin sign and dotless i match where case is ignored, and the literal search lets them through."""
    texts = ["to\u212aen = 'x'", "\u017fecret: 'y'", "D\u0130SABLE ver\u0131fy = False", "PA\u017f\u017fWORD='z'", "ver\u0130fy = false"]
    files = spark.createDataFrame([("", f"a{i}.py", t) for i, t in enumerate(texts)], "repo string, path string, text string")
    got = {(r.path, r.rule) for r in scan.rule_findings(files).collect()}
    plain = spark.createDataFrame([("", f"a{i}.py", t) for i, t in enumerate(texts)], "repo string, path string, text string")
    unhinted = set()
    for k, (name, pattern, flags, _) in enumerate(catalog.RULES):
        found = plain.select("path", tx.matches(plain.text, tx.pattern_flags(flags) + pattern).alias("m")).where("size(m) > 0")
        unhinted |= {(r.path, name) for r in found.collect()}
    assert got == unhinted and {("a0.py", "hardcoded_credential"), ("a1.py", "hardcoded_credential"), ("a3.py", "hardcoded_credential")} <= got


def test_rules_against_python(spark):
    both = "\n".join(x for pair in CASES.values() for x in pair)
    files = [(f"d/{n}_{i}.rb", t) for n, pair in CASES.items() for i, t in enumerate(pair)] + [("all.js", both), ("scripts/x.md", both), ("a/test_y.json", both), ("Dockerfile", both), ("é.py", "été = 12345\né1234 1234é"), ("e.py", "")]
    df = spark.createDataFrame([("", p, t) for p, t in files], "repo string, path string, text string")
    got = sorted((r.path, r.rule, r.line, r.snippet, r.seq) for r in scan.rule_findings(df).collect())
    assert got == sorted((p, *f) for p, t in files for f in expected(p, t))
    names = {(p, r) for p, r, *_ in got}
    for n in CASES:
        assert (f"d/{n}_0.rb", n) in names and (f"d/{n}_1.rb", n) not in names, n


# Line blocks, read line by line


def spaces_plainly(line: str) -> int:
    return len(line) - len(line.lstrip(" "))


def python_blocks_plainly(text: str):
    """(detector, line, rule, snippet) of long functions and docstrings in Python text.

    A function reaches from its ``def`` to whichever comes first: the next ``def``, a line that is not blank, no comment
    and indented no deeper, or the line after the last.
    """
    lines = text.splitlines()
    defs = [(i, len(m[1]), m[2]) for i, line in enumerate(lines) if (m := re.match(catalog.PY_DEF_PATTERN, line))]
    for (start, indent, name), following in zip(defs, [*[d[0] for d in defs[1:]], len(lines)], strict=False):
        body = range(start + 1, following)
        end = next((k for k in body if lines[k].strip() and spaces_plainly(lines[k]) <= indent and not lines[k].strip().startswith("#")), following)
        if end - start > catalog.LONG_FUNCTION_LINES:
            yield scan.LONG_PY, start + 1, "long_function", f"{name} exceeds {catalog.LONG_FUNCTION_LINES} lines"
        first = next((k for k in body if lines[k].strip()), None)
        opened = first is not None and spaces_plainly(lines[first]) > indent and re.match(r"\s*(\"\"\"|''')", lines[first])
        if opened and not (lines[first].count(opened[1]) >= 2 and lines[first].strip() != opened[1]):
            close = next((k for k in range(first + 1, len(lines)) if opened[1] in lines[k]), len(lines) - 1)
            if close - first + 1 > catalog.LONG_DOCSTRING_LINES:
                yield scan.DOCSTRING, start + 1, "excessive_docstring", f"{name} has a {close - first + 1}-line docstring"


def brace_blocks_plainly(text: str):
    """(detector, line, rule, snippet) of long functions in text with braces; braces in strings count, open ends do not."""
    lines = text.splitlines()
    depth = [0]
    for line in lines:
        depth.append(depth[-1] + line.count("{") - line.count("}"))
    at = 0
    while at < len(lines):
        m = re.match(catalog.JS_START_PATTERN, lines[at])
        if m and depth[at + 1] > depth[at]:
            end = next((k for k in range(at + 1, len(lines)) if depth[k + 1] <= depth[at]), None)
            if end is None:
                return
            if end - at > catalog.LONG_FUNCTION_LINES:
                yield scan.LONG_JS, at + 1, "long_function", f"{next(filter(None, m.groups()))} exceeds {catalog.LONG_FUNCTION_LINES} lines"
            at = end
        at += 1


def test_blocks_against_reading_line_by_line(spark, monkeypatch):
    """Random code of short pieces with low limits in mind: nested and open functions, quotes that stay open, odd line ends."""
    monkeypatch.setattr(catalog, "LONG_FUNCTION_LINES", 6)
    rng = random.Random(11)
    py = ["def f():", "  def g(a):", "\tasync def h(", "", "   ", "# note", "    # note", "x = 1", "    x", "        y", '    """doc', '    """', '    """one""" """', "    '''", "  ''' a '''", '"""', "\x0c", "end\x0bsame"]
    js = ["function a() {", "  foo(x) {", "const b = () => {", "if (a) {", "}", "}}", "{", "{{", "} else {", "x", "", "}}} {", "let c = async (q) => { }", "export async function d(", "'}'"]
    files = []
    for i in range(400):
        pieces, ext = (py, ".py") if i % 2 else (js, ".ts")
        lines = [x for _ in range(rng.randrange(1, 14)) for x in [rng.choice(pieces)] * rng.choice([1, 1, 2, 7])]
        files.append(("r", f"d/{i}{ext}", "".join(x + rng.choice(["\n", "\n", "\n", "\r\n", "\u2028"]) for x in lines) + rng.choice(["", "tail"])))
    files += [("q", "d/1.py", files[1][2]), ("r", "no.py", ""), ("r", "none.js", None), ("r", "x.rb", py[0] * 99)]
    got = sorted((r.repo, r.path, r.rule, r.line, r.snippet, r.seq) for r in scan.block_findings(spark.createDataFrame(files, "repo string, path string, text string")).collect())
    want = []
    for repo, path, text in files:
        read = {".py": python_blocks_plainly, ".ts": brace_blocks_plainly}.get(path[-3:], lambda _: [])
        want += [(repo, path, rule, line, snippet[:140], d * scan.STEP + k) for k, (d, line, rule, snippet) in enumerate(read(text or ""))]
    assert got == sorted(want) and len({(w[2], w[1][-3:]) for w in want}) == 3 and len(want) > 60


def test_open_quotes_and_many_lines(spark):
    """One file of 200,000 lines whose quotes stay open, and no Python worker."""
    text = ('def f():\n    """open\n' + "    x\n" * 8) * 20_000
    found = scan.block_findings(spark.createDataFrame([("", "a.py", text.replace('"""', "'''") + '"""')], "repo string, path string, text string"))
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 19_999 + 1


def test_blocks_join_nothing(spark):
    """Exploded lines look small to the planner: a join of them would be a broadcast of every line by the driver."""
    files = spark.range(10).selectExpr("'' AS repo", "concat(id, '.py') AS path", "concat('def f():\\n', repeat('  x\\n', 90)) AS text")
    found = scan.block_findings(files)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString() and found.count() == 10


def blocks(spark, name, text):
    rows = scan.block_findings(spark.createDataFrame([("", name, text)], "repo string, path string, text string")).orderBy("seq").collect()
    return [(r.line, r.rule, r.snippet) for r in rows]


@pytest.mark.parametrize(("lines", "found"), [(80, False), (81, True)])
def test_long_python_function(spark, lines, found):
    text = "def f():\n" + "    x\n" * (lines - 1) + "y = 1\n"
    assert blocks(spark, "a.py", text) == ([(1, "long_function", "f exceeds 80 lines")] if found else [])


def test_nested_and_open_functions(spark):
    text = "def f():\n" + "    x\n" * 80 + "    def g():\n" + "        y\n" * 80
    assert [x[0] for x in blocks(spark, "a.py", text)] == [1, 82]
    js = "if (a) {\n" + "x\n" * 81 + "}\nfunction g() {\n" + "y\n" * 90
    assert blocks(spark, "a.js", "  foo(a) {\n" + "x\n" * 80 + "}\n" + js) == [(1, "long_function", "foo exceeds 80 lines"), (83, "long_function", "if exceeds 80 lines")]


@pytest.mark.parametrize(("inner", "found"), [(3, False), (4, True)])
def test_docstring(spark, inner, found):
    text = 'def f():\n\n    """a\n' + "    b\n" * inner + '    """\n'
    assert [x[1:] for x in blocks(spark, "a.py", text)] == ([("excessive_docstring", f"f has a {inner + 2}-line docstring")] if found else [])


def test_counts_and_literals(spark):
    files = [("", "a.ts", "x as any;" * 5), ("", "b.ts", "\n" + "x as any;" * 6), ("", "c.rs", "Rc<RefCell<" * 2), ("", "d.rs", "\n\nRc < RefCell <" * 3), ("", "e.php", " \n<?php\n\n\n\ndeclare(strict_types = 1);"), ("", "f.php", "<?php\n\n\n\n\ndeclare(strict_types=1);"), ("", "e2.php", "<?php\x0b\x0c\u2028\u0085declare(strict_types=1);"), ("", "f2.php", "<?php\x0b\x0c\u2028\u0085\x1cdeclare(strict_types=1);"), ("", "g.md", "TODO " * 5), ("", "h.md", "\ntodo " * 6)]
    df = spark.createDataFrame(files, "repo string, path string, text string")
    got = {(r.path, r.rule, r.line, r.snippet) for r in scan.count_findings(df).collect()}
    assert got == {("b.ts", "typescript_as_density", 2, "6 TypeScript 'as' assertions"), ("d.rs", "rust_refcell_overuse", 3, "3 Rc<RefCell< occurrences"), ("f.php", "php_missing_strict_types", 1, "missing declare(strict_types=1)"), ("f2.php", "php_missing_strict_types", 1, "missing declare(strict_types=1)"), ("h.md", "high_todo_density", 2, "6 TODO/FIXME markers")}
    text = "\n" + "'abcdefghij' " * 3 + '\n" abcdefghij"\n' + '"http://abcdef" ' * 5 + '"short"' * 9 + "'mixed quotes\"" * 4
    lit = scan.literal_findings(spark.createDataFrame([("", "x.md", text)], "repo string, path string, text string")).collect()
    assert ("abcdefghij", 2) in [(r.snippet, r.line) for r in lit] and not any(r.snippet.startswith("http") for r in lit)


def test_review_as_a_whole(spark):
    files = [("r", "web/package.json", '{"dependencies": {"@a/b": "1"}, "devDependencies": null}'), ("r", "web/x.js", "import c from '@a/b/c'\nimport d from 'other/sub'\nrequire('fs'); require('./y')"), ("r", "lib/y.py", "import lib.z\nfrom os import path\nimport tornado.web, q\nimport _x"), ("r", "node_modules/z.js", "eval(1)"), ("r", ".hidden.py", "eval(1)"), ("r", "gen/w.py", "eval(1)"), ("r", "k.css", "eval(1)"), ("r", "n.py", None)]
    df = spark.createDataFrame(files, "repo string, path string, text string")
    config = review.Config.from_json('{"workspaces": {"a": {"root": "./web/"}, "b": {}, "root": {"root": "."}}, "paths": {"generated": ["gen/"]}}')
    got = [r.value for r in review.rendered(review.findings(df, config)).collect()]
    assert got == ["[unknown_dependency_import] lib/y.py:3 :: tornado", "[a][unknown_dependency_import] web/x.js:2 :: other/sub"]
    assert review.Config.from_json("{bad") == review.Config()
    assert review.report(review.findings(df.where("path = 'k.css'"))) == [review.NOTHING]


def test_mode_and_first_seen(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, "a"), (4, "b"), (5, "unknown"), (6, "unknown"), (7, "unknown"), (8, None)], "i int, v string")
    assert lookups.mode_first_seen(df, "v", ["i"]).collect()[0].asDict() == {"v": "b", "n": 2}
    assert lookups.mode_first_seen(df.where("v = 'unknown'"), "v", ["i"]).count() == 0
    assert {(r.v, r.first_i) for r in lookups.first_seen(df.where("v IS NOT NULL"), ["v"], ["i"]).collect()} == {("b", 1), ("a", 2), ("unknown", 5)}
