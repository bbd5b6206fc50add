"""Project profiles on small listings."""

import random

from pyspark.sql import functions as F

from sparkloom.operators import lookups
from sparkloom.plans import profile, review
from sparkloom.sources import tree

FILES = [
    ("r", "package.json", '{"workspaces": ["packages/*", "!x"], "scripts": {"lint": "x", "check-types": "y"}, "dependencies": {"next-auth": "1", "stripe": "2"}}'),
    ("r", "yarn.lock", ""),
    ("r", "next.config.mjs", ""),
    ("r", "packages/a/package.json", "{bad"),
    ("r", "packages/b/go.mod", "module x"),
    ("r", "pyproject.toml", '[project]\ndependencies=["fastapi>=1", "x[y]"]\n[tool.poetry.dependencies]\nPython="3"\nrich="1"\n'),
    ("r", "go.mod", "require (\n\tgithub.com/gin v1.0.0\n\tgithub.com/z v1 // indirect\n)\n"),
    ("r", "Gemfile", "gem 'rails'\n"),
    ("r", "infra/deep/m.tf", ""),
    ("r", "db/migrations/1.sql", ""),
    ("r", ".github/workflows/ci.yml", ""),
    ("r", "src/fooBar.py", "def fooBar():\n  x_y = 1\nabc = 2\n"),
    ("r", "tests/test_a.py", "x=1"),
    ("r", ".env.example", "A=1\n#c\nB = 2\nA=3\nexport K=v\n=z"),
    ("r", "views/x.html", ""),
    ("q", "svc/pom.xml", "<x/>"),
    ("q", "build/pom.xml", "<x/>"),
    ("q", "plain/x.py", ""),
]


def frame(spark):
    return spark.createDataFrame(FILES, "repo string, path string, text string")


def test_workspaces_and_commands(spark):
    files = frame(spark)
    spaces = profile.workspaces(files)
    assert {(r.repo, r.dir) for r in spaces.collect()} == {("r", "packages/a"), ("r", "packages/b"), ("q", "svc")}
    dirs = files.select("repo").distinct().select("repo", F.lit("").alias("dir")).union(spaces.select("repo", "dir"))
    got = {(r.repo, r.dir): r for r in profile.detect(files, dirs).collect()}
    root = got["r", ""]
    assert root.stack == ["javascript/typescript", "nextjs", "python", "go", "ruby", "terraform"]
    assert root.package_managers == ["yarn", "pip", "go", "bundler", "terraform"]
    assert root.commands == {"install": "yarn install", "lint": "yarn lint", "typecheck": "yarn check-types", "test": "pytest", "build": "go build ./...", "format": "terraform fmt -check -recursive"}
    assert root.critical == ["app/", "middleware.ts", "infra/", "db/migrations", "db", ".github/workflows"]
    assert root.migration_sensitive == ["db/migrations"] and root.infra_sensitive == ["*.tf"] and root.auth_sensitive == ["middleware.ts"]
    assert got["r", "packages/a"].uncertain and got["r", "packages/a"].package_managers == []
    assert got["q", "svc"].commands["install"] == "mvn -q -DskipTests compile" and got["q", ""].stack == []


def test_globs_against_a_real_tree(spark, tmp_path):
    """Every directory that pathlib takes, for plain names, stars, question marks, sets, and ** at any place."""
    rng = random.Random(4)
    dirs = set()
    for _ in range(60):
        parts = [rng.choice(["a", "b", "ab", "abc", "x.y", "pkg-1", "pkg-22", "é"]) for _ in range(rng.randrange(1, 5))]
        dirs |= {"/".join(parts[:k]) for k in range(1, len(parts) + 1)}
    for d in dirs:
        (tmp_path / d).mkdir(parents=True, exist_ok=True)
    globs = ["a", "a/b", "*", "*/b", "a*", "*b*", "pkg-?", "pkg-*", "[ab]", "[!a]*", "**", "**/b", "a/**", "a/**/b", "**/**/ab", "*/**/*", "./a/*/", "x.y", "x?y/**", "none", "a*c", "**/a/**/b/**", "é/*"]
    rows = spark.createDataFrame([("r", i, g) for i, g in enumerate(globs)], "repo string, at int, pattern string")
    tree_ = spark.createDataFrame([("r", d) for d in dirs] + [("other", "a/b/c")], "repo string, path string")
    got = {(r.pattern, r.path) for r in profile.expanded(rows, tree_).collect()}
    want = {(g, p.relative_to(tmp_path).as_posix()) for g in globs for p in tmp_path.glob(g) if p.is_dir() and p != tmp_path}
    assert got == want


def test_caps_of_a_large_repository(spark):
    """Files beyond the first 400 count neither for names nor for tests; one repository is cut before its rows meet."""
    files = spark.range(401).selectExpr("'r' AS repo", "concat('a', lpad(id, 4, '0'), IF(id < 399, '.md', '_x.test.ts')) AS path", "'' AS text")
    files = files.union(spark.range(3000).selectExpr("'s'", "concat('z', id, IF(id % 2 = 0, '-b.py', '.txt'))", "''"))
    got = {(r.repo, r.kind): r.style for r in profile.naming(files).collect()}
    assert got == {("r", "files"): "snake_case", ("r", "tests"): "*.test.ts", ("s", "files"): "kebab-case"}
    assert profile.naming(files.where("repo = 'r' AND path < 'a0399'")).count() == 0
    plan = lookups.first_paths(files, 400)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and plan.index("Final") < plan.index("Exchange") < plan.index("Partial")


def test_review_document(spark):
    schema = "severity string, title string, layer int, location string, impact string, evidence string, fix string, key long"
    rows = [("low", "B", 2, "b:1", "i", "e", "f", 1), ("critical", "A", 2, "a:1", "i\nj", "e", "f", 9), ("low", "C", 2, "c:1", "i", "e", "f", 0), ("none", "X", 2, "x:1", "", "", "", 0), ("low", "Y", 7, "y:1", "", "", "", 0)]
    checks = spark.createDataFrame([("make", 0, "ok", "fine", 1)], "command string, exit_code int, output string, interpretation string, key long")
    out = review.report_document(spark.createDataFrame(rows, schema), checks, spark.createDataFrame([("load test", 1)], "value string, key long"))
    lines = [r.value for r in out.orderBy("part", "layer", "ord", "key", "line").collect()]
    assert lines[:10] == ["## Findings by Layer", "", "### Layer 1: Requirement Fidelity", "", "- No issues found in this layer.", "", "### Layer 2: Logic and Edge Cases", "", "### [Critical] A", ""]
    assert [x for x in lines if x.startswith("### [")] == ["### [Critical] A", "### [Low] C", "### [Low] B"] and lines.count("- No issues found in this layer.") == 5
    assert lines[-8:] == ["", "- Command: `make`", "- Exit code: `0`", "- Relevant output: `ok`", "- Interpretation: `fine`", "", "- Not run / not verified:", "  - load test"]
    nothing = review.report_document(spark.createDataFrame([], schema))
    assert nothing.where("value = '- No issues found in this layer.'").count() == 6


def test_dependencies_and_categories(spark):
    deps = profile.dependencies(frame(spark))
    assert [r.name for r in deps.orderBy("first_at").collect()] == ["next-auth", "stripe", "fastapi", "x", "rich", "(", "github.com/gin", "rails"]
    got = {(r.name, r.category) for r in lookups.categories(deps, "name").collect()}
    assert {("next-auth", "framework"), ("next-auth", "auth"), ("stripe", "payments"), ("rails", "framework"), ("github.com/gin", "framework")} <= got


def test_structure(spark):
    files = frame(spark)
    paths = lookups.with_ancestors(files)
    assert {(r.repo, r.layout) for r in lookups.layouts(paths).collect()} == {("r", "mvc")}
    assert [r.path for r in lookups.folder_structure(paths).where("repo = 'r'").orderBy("ord").collect()] == [".github", ".github/workflows", "db", "db/migrations", "infra", "infra/deep", "packages", "packages/a", "packages/b", "src", "tests", "views"]
    names = {(r.repo, r.kind): r.style for r in profile.naming(files).collect()}
    assert names["r", "files"] == "camelCase" and names["r", "variables"] == "camelCase" and names["r", "tests"] == "test_*.py"
    assert [r.key for r in profile.env_keys(files).orderBy("first_at").collect()] == ["A", "B", "export K"]
    texts = spark.createDataFrame([("# T\n[![b]\nHello\n# x\nworld\n\nmore",), ("",), ("# only",), ("\n\n a \n",)], "t string")
    assert [r.p for r in texts.select(profile.first_paragraph(F.col("t")).alias("p")).collect()] == ["Hello world", "", "", "a"]


def test_tree(spark, tmp_path):
    for name, data in {"a.py": b"x\r\ny\rz", "__init__.py": b"\xff1", ".env": b"k", "bin": b"a\x00", "node_modules/x.js": b"1", "yarn.lock": b""}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    files = tree.read_tree(spark, str(tmp_path), "me")
    assert {(r.path, r.text) for r in tree.decoded(files).collect()} == {("a.py", "x\ny\nz"), ("__init__.py", "1"), (".env", "k")}
    assert tree.read_tree(spark, str(tmp_path), everything=True).count() == 6
    assert tree.base_ref(None, "", None, {"main", "master"}) == "main" and tree.base_ref("x", None, None, set()) == "x"


def test_architecture(spark):
    more = [
        ("r", "README.md", "# T\n[![b]\nHello\nworld\n\nmore"), ("r", "docker-compose.yml", "x: 1\nservices:\n  web:\n    ports:\n      - 1\n\n  db:\nvolumes:\n  data:\nservices:\n  late:\n"),
        ("r", "manage.py", ""), ("r", "tsconfig.base.json", "{}"), ("r", ".eslintrc", ""), ("s", "package.json", '{"main": "m.js", "browser": {"a": "b"}, "bin": {"x": "bin/x.js", "y": "m.js"}, "description": " D "}'),
    ]
    got = {r.repo: r for r in profile.architecture(spark.createDataFrame(FILES + more, "repo string, path string, text string")).collect()}
    r = got["r"]
    assert r.patterns == ["mvc"] and r.project_description == "Hello world" and r.env_keys == ["A", "B", "export K"] and r.docker_services == ["web", "ports", "db", "late"]
    assert r.key_libraries["framework"] == ["next-auth", "fastapi", "github.com/gin", "rails"] and r.key_libraries["http"] == []
    assert r.config_files == [".github/workflows/ci.yml", "docker-compose.yml", "next.config.mjs", "pyproject.toml", "tsconfig.base.json"] and r.entry_points == ["manage.py"]
    assert sorted(r.folder_structure)[:2] == [".github", ".github/workflows"] and r.naming["tests"] == "test_*.py" and r.naming["components"] == ""
    assert r.ai_refinement_needed == [profile.CONFIRM["always"], profile.CONFIRM["naming"]]
    s = got["s"]
    assert s.entry_points == ["m.js", "bin/x.js"] and s.project_description == "D" and s.folder_structure == {} and len(s.ai_refinement_needed) == 5


def test_run_order(spark):
    schema = "repo string, name string, root string, ord int"
    local = spark.createDataFrame([("r", "b", "./", 0), ("r", "root", None, 1), ("r", "new", " ", 2), ("q", "x", ".", 0)], schema)
    detected = spark.createDataFrame([("r", "a", "pa", 0), ("r", "root", ".", 1), ("r", "b", "pb", 2), ("q", "b", "pb", 0), ("p", "a", "pa", 0)], schema)
    got = [(r.repo, r.scope, r.root) for r in profile.run_order(local, detected).orderBy("repo", "ord").collect()]
    assert got == [("p", "a", "pa"), ("q", "b", "pb"), ("q", "root", "."), ("r", "a", "pa"), ("r", "root", "."), ("r", "b", "./"), ("r", "new", "")]
    commands = spark.createDataFrame([("a", "lint", " x "), ("a", "test", "y"), ("b", "typecheck", " ")], "scope string, key string, value string")
    assert [tuple(r) for r in profile.diff_commands(commands).collect()] == [("a", "lint", "x")]


def test_lists_and_lines(spark, tmp_path):
    (tmp_path / "a.txt").write_text("./x.py\n\n \t \ny.py\n")
    assert sorted(r.path for r in tree.read_lists(spark, str(tmp_path / "a.txt"), str(tmp_path / "none.txt"), f"file://{tmp_path}/a.txt").collect()) == ["./x.py", "./x.py", "y.py", "y.py"]
    tree.write_lines(spark.createDataFrame([("b",), ("a",)], "value string"), str(tmp_path / "out"))
    assert "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*"))) == "b\na\n"


def test_a_directory_without_text_explains_imports(spark):
    from sparkloom.plans import review

    files = spark.createDataFrame([("r", "src/a.py", "import pics.x\nimport other\nimport vendor.y"), ("r", "pics/a.png", "x"), ("r", "vendor/z.py", "x")], "repo string, path string, text string")
    assert sorted(r.snippet for r in review.findings(files).collect()) == ["other", "vendor"]
    capped = review.findings(files.union(spark.createDataFrame([("r", "a/b.py", "import src")], files.schema)), most=1)
    assert capped.count() == 0
