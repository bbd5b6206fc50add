"""Registered queries over project profiles: every supplier stands for a repository whose files templates decide.

A template stands in a repository if a remainder of the supplier's key says so; the DuckDB twins read the same texts with
JSON functions and regular expressions, and the same listing with remainders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import catalog
from ..operators import lookups
from ..sources import tree
from . import profile
from .queries import quoted, table

#: (path, text, divisor, remainder): the file is there if the key divided by the divisor leaves the remainder.
FILES = [
    ("package.json", '{"main": "lib/index.js", "bin": {"x": "bin/x.js", "y": "bin/y.js"}, "description": "a package", "scripts": {"lint": "l", "check-types": "t", "build": "b"}, "dependencies": {"next-auth": "1", "react": "2", "stripe": "3"}, "devDependencies": {"jest": "4", "react": "5"}}', 3, 0),
    ("package.json", '{"module": "m.mjs", "bin": "cli.js", "workspaces": ["packages/*", "!packages/x", " tools/** "], "scripts": {"typecheck": "t", "test": "x"}, "peerDependencies": {"vue": "3"}}', 3, 1),
    ("pnpm-lock.yaml", "", 4, 1), ("yarn.lock", "", 5, 2), ("bun.lock", "", 6, 3), ("next.config.mjs", "", 7, 0), ("tsconfig.json", "{}", 2, 0), ("turbo.json", "{}", 11, 4), ("lerna.json", '{"packages": ["apps/*"]}', 13, 5),
    ("pyproject.toml", '[project]\ndescription = " a project "\ndependencies = ["fastapi>=1", "x[y]", "numpy ~= 2"]\n[tool.poetry.dependencies]\nPython = "3"\nrich = "1"\n', 4, 0), ("requirements.txt", "a", 5, 0), ("uv.lock", "", 8, 4), ("mypy.ini", "", 6, 0),
    ("go.mod", "module x\nrequire (\n\tgithub.com/gin v1.0.0\n\tgithub.com/z v1 // indirect\n)\nrequire example.com/fiber v2.1\n", 5, 1), ("Gemfile", "source 'x'\ngem 'rails'\n  gem \"rspec\", '3'\n# gem 'no'\n", 7, 2), ("Cargo.toml", '[dependencies]\nserde = "1"\n[dev-dependencies]\nsqlite = "2"\n[workspace]\nmembers = ["crates/*"]\n', 9, 3),
    ("composer.json", '{"require": {"laravel/framework": "1"}, "require-dev": {"mockery": "2"}}', 8, 6), ("pom.xml", "<x/>", 10, 7), ("build.gradle", "", 9, 1), ("gradlew", "", 2, 1), ("App.csproj", "", 12, 6), ("Package.swift", "", 11, 2), ("pubspec.yaml", "name: x\nflutter:\n", 10, 2), ("pubspec.yaml", "name: x\n", 10, 3), ("infra/deep/m.tf", "", 6, 5),
    ("packages/a/package.json", "{bad", 2, 1), ("packages/x/readme.md", "", 4, 3), ("tools/one/two/x.py", "x_a = 1\nzB = 2\n", 3, 1), ("apps/web/src/App.tsx", "export default function App() {}\nconst inner_value = 1\n", 5, 3), ("crates/core/lib.rs", "", 9, 3), ("services/api/go.mod", "module y", 6, 2), ("build/out/pom.xml", "", 4, 2),
    ("README.md", "# Title\n![badge](x)\n\n  First line\nsecond line  \n\nthird", 4, 1), ("README.md", "# Only a title\n", 4, 2), (".env.example", "A=1\n# c\n B = 2\nA=3\nexport K=v\n=z\nplain\n", 3, 2), (".env.sample", "C=1\nA=9\n", 5, 4),
    ("docker-compose.yml", "version: '3'\nservices:\n  web:\n    ports:\n      - 1\n  db:\n    image: x\nvolumes:\n  data:\n", 4, 0), ("compose.yaml", "services:\n  cache:\n", 6, 1),
    ("src/main.ts", "const fooBar = 1; function do_it() {}\n", 3, 0), ("app/layout.tsx", "const Layout = 1\n", 7, 3), ("manage.py", "def runIt():\n    pass\nasync def go_on():\n  v = 1\n", 5, 2), ("models/user_model.py", "x = 1\n", 4, 3), ("views/x.html", "", 4, 3), ("controllers/a-b.rb", "", 4, 3), ("src/components/Button.test.tsx", "const Button = 1\n", 6, 4), ("tests/test_a.py", "T = 1\n", 5, 0),
    ("db/migrations/1.sql", "", 7, 5), ("auth/x.go", "", 8, 1), (".github/workflows/ci.yml", "", 3, 1), (".eslintrc.json", "{}", 4, 0), ("eslint.config.mjs", "", 9, 4), ("tsconfig.base.json", "{}", 8, 2), ("node_modules/z/package.json", '{"dependencies": {"zod": "1"}}', 2, 0), ("LICENSE", "", 1, 0),
]


def repo_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """repo, path, text, key: every file of every repository."""
    each = F.array(*[F.struct(F.lit(p).alias("path"), F.lit(t).alias("text"), F.lit(d).alias("d"), F.lit(r).alias("r")) for p, t, d, r in FILES])
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.explode(each).alias("f")).where("key % f.d = f.r")
    return rows.select(F.concat(F.lit("s"), "key").alias("repo"), "f.path", "f.text", "key")


_FILES_SQL = ", ".join(f"({i}, {quoted(p)}, {quoted(t)}, {d}, {r})" for i, (p, t, d, r) in enumerate(FILES))
REPO_FILES = f"SELECT 's' || s_suppkey AS repo, path, text, s_suppkey AS key FROM supplier JOIN (VALUES {_FILES_SQL}) AS t(n, path, text, d, r) ON s_suppkey % d = r"


def _joined(df: DataFrame, value: str, order: str, name: str) -> DataFrame:
    listed = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v")))), lambda x: x["v"])
    return df.groupBy("repo").agg(F.array_join(listed, "|").alias(name))


def project_dependencies(spark, sf_dir):
    """Dependencies that the manifests name, in order, and their categories."""
    found = profile.dependencies(repo_files(spark, sf_dir))
    kinds = lookups.categories(found, "name").groupBy("repo").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "category", "name"))), "|").alias("categories"))
    return _joined(found, "name", "first_at", "names").join(kinds, "repo", "left").select("repo", "names", F.coalesce("categories", F.lit("")).alias("categories"))


def project_dependencies_sql() -> str:
    """JSON by its functions; TOML and the line formats by patterns that fit the templates."""
    keys = lambda *ps: "list_concat(" * (len(ps) - 1) + f"coalesce(json_keys(text, '$.{ps[0]}'), [])" + "".join(f", coalesce(json_keys(text, '$.\"{p}\"'), []))" for p in ps[1:])
    valid = "path = 'package.json' AND json_valid(text)"
    kinds = " UNION ALL ".join(f"SELECT repo, {quoted(k)} || ':' || name AS v FROM once WHERE " + " OR ".join(f"contains(lower(name), {quoted(e)})" for e in entries) for k, entries in catalog.LIBRARIES.items())
    return rf"""WITH files AS ({REPO_FILES}), lists AS (
        SELECT repo, 0 AS source, {keys("dependencies", "devDependencies", "peerDependencies")} AS names FROM files WHERE {valid}
        UNION ALL SELECT repo, 1, list_concat(list_transform(regexp_extract_all(regexp_extract(text, '(?s)\ndependencies = \[(.*?)\]\n', 1), '"([^"]+)"', 1), lambda x: regexp_extract(x, '^[^<>=!~\s\[]*')), list_filter(regexp_extract_all(regexp_extract(text, '(?s)poetry.dependencies\]\n(.*)$', 1), '(?m)^(\w+) =', 1), lambda x: lower(x) <> 'python')) FROM files WHERE path = 'pyproject.toml'
        UNION ALL SELECT repo, 2, list_concat(regexp_extract_all(text, '(?m)^\s*require\s+([^\s]+)', 1), regexp_extract_all(text, '(?m)^\s*([^\s]+)\s+v[\w.+-]+\s*$', 1)) FROM files WHERE path = 'go.mod'
        UNION ALL SELECT repo, 3, regexp_extract_all(text, '(?m)^\s*gem\s+[''"]([^''"]+)', 1) FROM files WHERE path = 'Gemfile'
        UNION ALL SELECT repo, 4, regexp_extract_all(regexp_extract(text, '(?s)^(.*)\[workspace\]', 1), '(?m)^(\w+) = ', 1) FROM files WHERE path = 'Cargo.toml'
        UNION ALL SELECT repo, 5, {keys("require", "require-dev")} FROM files WHERE path = 'composer.json'),
        once AS (SELECT repo, name, min(source * 1000 + nth) AS first FROM (SELECT repo, source, unnest(names) AS name, unnest(range(1, len(names) + 1)) AS nth FROM lists) AS l WHERE name <> '' GROUP BY repo, name),
        kinds AS (SELECT repo, string_agg(v, '|' ORDER BY v) AS categories FROM ({kinds}) AS k GROUP BY repo)
        SELECT repo, names, coalesce(categories, '') AS categories FROM (SELECT repo, string_agg(name, '|' ORDER BY first) AS names FROM once GROUP BY repo) AS n LEFT JOIN kinds USING (repo)"""


def project_commands(spark, sf_dir):
    """Stack, managers, commands and risks of each repository's root and workspaces."""
    files = repo_files(spark, sf_dir)
    spaces = profile.workspaces(files).select("repo", "dir")
    found = profile.detect(files, files.select("repo").distinct().select("repo", F.lit("").alias("dir")).union(spaces))
    join = lambda c: F.array_join(c, "|").alias(c)
    return found.select("repo", "dir", join("stack"), join("package_managers"), *[F.col("commands")[k].alias(k) for k in catalog.COMMAND_KEYS], join("critical"), join("auth_sensitive"), join("migration_sensitive"), join("infra_sensitive"), join("uncertain"))


def _has(*paths: str) -> str:
    """Whether one of the files stands in the directory of d."""
    return "(" + " OR ".join(f"list_contains(names, {quoted(p)})" for p in paths) + ")"


def project_commands_sql() -> str:
    js, ok = _has("package.json"), f"({_has('package.json')} AND json_valid(package))"
    manager = f"CASE WHEN {_has('pnpm-lock.yaml')} THEN 'pnpm' WHEN {_has('yarn.lock')} THEN 'yarn' WHEN {_has('bun.lock', 'bun.lockb')} THEN 'bun' ELSE 'npm' END"
    runner = f"CASE {manager} WHEN 'npm' THEN 'npm run' ELSE {manager} END"
    script = lambda *ns: "CASE " + " ".join(f"WHEN {ok} AND json_extract(package, '$.scripts.\"{n}\"') IS NOT NULL THEN {runner} || ' {n}'" for n in ns) + " END"
    python = _has(*profile.PYTHON_MARKERS)
    tool = f"CASE WHEN {_has('uv.lock')} THEN 'uv' WHEN {_has('poetry.lock')} THEN 'poetry' ELSE 'pip' END"
    flutter = "(pubspec IS NOT NULL AND contains(pubspec, 'flutter:'))"
    dart = "(pubspec IS NOT NULL AND NOT contains(pubspec, 'flutter:'))"
    gradle, net, tf = _has("build.gradle", "build.gradle.kts"), "len(list_filter(names, lambda x: regexp_matches(x, '^[^/]*[.](sln|csproj)$'))) > 0", "len(list_filter(names, lambda x: ends_with(x, '.tf'))) > 0"
    next_ = f"({ok} AND {_has('next.config.js', 'next.config.mjs', 'next.config.ts')})"
    stack = [(js, "javascript/typescript"), (next_, "nextjs"), (f"{ok} AND {_has('tsconfig.json')}", "typescript"), (f"{ok} AND {_has('turbo.json')}", "turborepo"), (f"{ok} AND {_has('nx.json')}", "nx"), (f"{ok} AND {_has('lerna.json')}", "lerna"), (python, "python")]
    stack += [(_has(*m), label) for m, label, _, _ in profile.ECOSYSTEMS] + [(gradle, "java/kotlin"), (net, ".net"), (_has("Package.swift"), "swift"), (flutter, "flutter"), (dart, "dart"), (tf, "terraform")]
    managers = [(ok, manager), (python, tool)] + [(_has(*m), quoted(name)) for m, _, name, _ in profile.ECOSYSTEMS] + [(gradle, "'gradle'"), (net, "'dotnet'"), (_has("Package.swift"), "'swift'"), (flutter, "'dart'"), (dart, "'dart'"), (tf, "'terraform'")]
    listed = lambda pairs: "concat_ws('|', " + ", ".join(f"CASE WHEN {c} THEN {v} END" for c, v in pairs) + ")"
    steps = {
        "install": [(ok, f"{manager} || ' install'")], "lint": [(ok, script("lint"))], "typecheck": [(ok, script("typecheck", "check-types"))], "test": [(ok, script("test"))], "build": [(ok, script("build"))], "format": [(ok, script("format"))],
    }
    for key, values in (("install", {"uv": "uv sync", "poetry": "poetry install", "pip": None}), ("test", {"uv": "uv run pytest", "poetry": "poetry run pytest", "pip": "pytest"}), ("lint", {"uv": "uv run ruff check .", "poetry": "poetry run ruff check .", "pip": "ruff check ."}), ("format", {"uv": "uv run ruff format --check ."})):
        pip = f"CASE WHEN {_has('requirements.txt')} THEN 'python -m pip install -r requirements.txt' ELSE 'python -m pip install .' END"
        steps[key].append((python, f"CASE {tool} " + " ".join(f"WHEN '{t}' THEN {quoted(v) if v else pip}" for t, v in values.items()) + " END"))
    steps["typecheck"].append((python, f"CASE WHEN {_has('mypy.ini')} THEN 'mypy .' WHEN {_has('pyrightconfig.json')} THEN 'pyright' END"))
    for marks, _, _, commands in profile.ECOSYSTEMS:
        for key, value in commands.items():
            steps[key].append((_has(*marks), quoted(value)))
    for key in ("test", "build"):
        steps[key] += [(gradle, f"CASE WHEN {_has('gradlew')} THEN './gradlew {key}' ELSE 'gradle {key}' END"), (net, f"'dotnet {key}'"), (_has("Package.swift"), f"'swift {key}'")]
    steps["install"] += [(flutter, "'flutter pub get'"), (dart, "'dart pub get'")]
    steps["test"] += [(flutter, "'flutter test'"), (dart, "'dart test'")]
    steps["build"] += [(flutter, "'flutter build'"), (tf, "'terraform validate'")]
    steps["format"].append((tf, "'terraform fmt -check -recursive'"))
    commands = ", ".join("coalesce(" + ", ".join(f"CASE WHEN {c} THEN {v} END" for c, v in steps[k]) + f", '') AS {k}" for k in catalog.COMMAND_KEYS)
    below = lambda p: f"len(list_filter(names, lambda x: x = {quoted(p)} OR starts_with(x, {quoted(p + '/')}))) > 0"
    critical = [(next_, "'app/'"), (next_, "'middleware.ts'"), (tf, "'infra/'"), *[(below(p), quoted(p)) for p in (*catalog.MIGRATION_PATHS, *catalog.CRITICAL_PATHS)], (below(".github/workflows"), "'.github/workflows'")]
    return rf"""WITH files AS ({REPO_FILES}),
        folders AS (SELECT DISTINCT repo, array_to_string(string_split(path, '/')[1:k], '/') AS path FROM (SELECT repo, path, unnest(range(1, len(string_split(path, '/')))) AS k FROM files) AS f),
        open AS (SELECT * FROM folders WHERE NOT list_has_any(string_split(path, '/'), [{", ".join(quoted(x) for x in catalog.COMMAND_SKIPPED)}]) AND NOT regexp_matches(path, '(^|/)[.]')),
        named AS (SELECT o.repo, o.path AS dir FROM open AS o JOIN files AS f ON f.repo = o.repo WHERE (f.path = 'package.json' AND json_extract(f.text, '$.workspaces') IS NOT NULL AND regexp_matches(o.path, '^(packages/[^/]*|tools(/[^/]+)*)$'))
            OR (f.path = 'lerna.json' AND regexp_matches(o.path, '^apps/[^/]*$')) OR (f.path = 'turbo.json' AND regexp_matches(o.path, '^(apps|libs|packages)/[^/]*$')) OR (f.path = 'Cargo.toml' AND regexp_matches(o.path, '^crates/[^/]*$'))),
        marked AS (SELECT DISTINCT repo, string_split(path, '/')[1] AS dir FROM files WHERE len(string_split(path, '/')) = 2 AND (string_split(path, '/')[2] IN ({", ".join(quoted(x) for x in catalog.REPO_MARKERS)}) OR regexp_matches(path, '[.](sln|csproj)$'))),
        dirs AS (SELECT DISTINCT repo, '' AS dir FROM files UNION SELECT repo, dir FROM named UNION SELECT m.repo, m.dir FROM marked AS m JOIN open AS o ON o.repo = m.repo AND o.path = m.dir WHERE m.repo NOT IN (SELECT repo FROM named)),
        facts AS (SELECT d.repo, d.dir, list(CASE WHEN d.dir = '' THEN f.path ELSE substring(f.path, length(d.dir) + 2) END) AS names, max(f.text) FILTER (f.path = ltrim(d.dir || '/package.json', '/')) AS package, max(f.text) FILTER (f.path = ltrim(d.dir || '/pubspec.yaml', '/')) AS pubspec
            FROM dirs AS d JOIN files AS f ON f.repo = d.repo AND (d.dir = '' OR starts_with(f.path, d.dir || '/')) GROUP BY d.repo, d.dir)
        SELECT repo, dir, {listed([(c, quoted(v)) for c, v in stack])} AS stack, array_to_string(list_distinct_in_order, '|') AS package_managers, {commands}, {listed(critical)} AS critical, {listed([(next_, "'middleware.ts'")])} AS auth_sensitive,
            {listed([(below(p), quoted(p)) for p in catalog.MIGRATION_PATHS])} AS migration_sensitive, {listed([(tf, "'*.tf'")])} AS infra_sensitive, {listed([(f"{js} AND NOT {ok}", "'Could not parse package.json'")])} AS uncertain
        FROM (SELECT *, list_filter([{", ".join(f"CASE WHEN {c} THEN {v} END" for c, v in managers)}], lambda x: x IS NOT NULL) AS list_distinct_in_order FROM facts) AS x"""


def project_architecture(spark, sf_dir):
    """The architecture report: layouts, naming, entry points, environment, services, description, and what is left to confirm."""
    found = profile.architecture(repo_files(spark, sf_dir))
    join = lambda c: F.array_join(c, "|").alias(c)
    names = F.concat_ws("|", *[F.col("naming")[k] for k in ("files", "variables", "components", "tests")]).alias("naming")
    folders = F.array_join(F.transform(F.map_entries("folder_structure"), lambda e: F.concat_ws("=", e["key"], e["value"])), "|").alias("folders")
    return found.select("repo", join("patterns"), names, folders, join("config_files"), join("entry_points"), "project_description", join("env_keys"), join("docker_services"), join("ai_refinement_needed"))


def _style(x: str) -> str:
    return f"CASE WHEN {x} IS NULL OR {x} = '' THEN 'unknown' WHEN contains({x}, '-') THEN 'kebab-case' WHEN contains({x}, '_') THEN 'snake_case' WHEN regexp_full_match({x}, '[A-Z][A-Za-z0-9]+') THEN 'PascalCase' WHEN regexp_full_match({x}, '[a-z][A-Za-z0-9]*') THEN 'camelCase' ELSE 'unknown' END"


def project_architecture_sql() -> str:
    skipped = f"list_has_any(string_split(path, '/'), [{', '.join(quoted(x) for x in catalog.IGNORED_PARTS)}]) OR len(list_filter(string_split(path, '/'), lambda p: starts_with(p, '.') AND p <> '.github')) > 0"
    ext, name = "regexp_extract(path, '[.][^.]+$')", "string_split(path, '/')[-1]"
    stripped = "CASE " + " ".join(f"WHEN ends_with({name}, {quoted(x)}) THEN left({name}, length({name}) - {len(x)})" for x in catalog.STRIPPED_SUFFIXES) + f" ELSE regexp_replace({name}, '[.][^.]+$', '') END"
    layouts = "CASE path " + " ".join(f"WHEN {quoted(p)} THEN {[list(catalog.LAYOUTS).index(k) for k, ps in catalog.LAYOUTS.items() if p in ps]}" for p in dict.fromkeys(p for ps in catalog.LAYOUTS.values() for p in ps)) + " END"
    labels = "CASE " + " ".join(f"WHEN {name} = {quoted(k)} THEN {quoted(v)}" for k, v in catalog.DIRECTORY_LABELS.items()) + " " + " ".join(f"WHEN string_split(path, '/')[1] = {quoted(k)} THEN {quoted(v)}" for k, v in catalog.DIRECTORY_LABELS.items()) + f" ELSE {quoted(catalog.OTHER_DIRECTORY)} END"
    globs = "|".join(g.replace(".", "[.]").replace("*", "[^/]*") for g in catalog.CONFIG_GLOBS)
    entry = f"[{', '.join(quoted(p) for p in catalog.ENTRY_POINTS)}]"
    env, compose = (f"[{', '.join(quoted(p) for p in ps)}]" for ps in (catalog.ENV_FILES, catalog.COMPOSE_FILES))
    tests = f"CASE WHEN contains({name}, '.test.') THEN '*.test' || {ext} WHEN contains({name}, '.spec.') THEN '*.spec' || {ext} WHEN ends_with({name}, '_test.go') THEN '*_test.go' WHEN starts_with({name}, 'test_') THEN 'test_*' || {ext} WHEN ends_with({name}, '_spec.rb') THEN '*_spec.rb' END"
    mode = lambda kind, rows: f"SELECT repo, '{kind}' AS kind, style, count(*) AS n, min(a * 1000 + b) AS first FROM ({rows}) AS r WHERE style IS NOT NULL AND style <> 'unknown' GROUP BY repo, style"
    each = lambda names: f"SELECT repo, a, unnest(x) AS v, unnest(range(1, len(x) + 1)) AS b FROM (SELECT repo, nth AS a, {names} AS x FROM source) AS e"
    variables = rf"SELECT repo, a, b, {_style('v')} AS style FROM (" + each(
        r"""CASE WHEN path LIKE '%.py' THEN list_transform(regexp_extract_all(text, '(?m)^\s*(?:def|async\s+def)\s+[A-Za-z_][A-Za-z0-9_]*|^\s*[A-Za-z_][A-Za-z0-9_]*\s*='), lambda m: regexp_extract(m, '([A-Za-z_][A-Za-z0-9_]*)\s*=?$', 1))
        WHEN regexp_matches(path, '[.][jt]sx?$') THEN regexp_extract_all(text, '\b(?:const|let|var|function|class)\s+([A-Za-z_$][A-Za-z0-9_$]*)', 1) ELSE [] END"""
    ) + ") AS v1"
    components = "SELECT repo, a, b, 'PascalCase' AS style FROM (" + each(r"CASE WHEN regexp_matches(path, '[.][jt]sx$') THEN regexp_extract_all(text, '(?:export\s+default\s+function|export\s+function|const)\s+([A-Z][A-Za-z0-9]*)', 1) ELSE [] END") + ") AS c1"
    modes = " UNION ALL ".join([mode("files", f"SELECT repo, nth AS a, 0 AS b, {_style(stripped)} AS style FROM source"), mode("variables", variables), mode("components", components), mode("tests", f"SELECT repo, nth AS a, 0 AS b, {tests} AS style FROM source")])
    once = lambda rows, value, out: f"SELECT repo, string_agg({value}, '|' ORDER BY first) AS {out} FROM (SELECT repo, {value}, min(o) AS first FROM ({rows}) AS r GROUP BY repo, {value}) AS g GROUP BY repo"
    env_rows = rf"SELECT repo, f * 1000 + pos AS o, trim(string_split(line, '=')[1]) AS k FROM (SELECT repo, list_position({env}, path) AS f, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS pos FROM (SELECT *, string_split(text, chr(10)) AS l FROM files WHERE list_contains({env}, path)) AS s) AS t WHERE NOT starts_with(trim(line), '#') AND contains(line, '=') AND trim(string_split(line, '=')[1]) <> ''"
    # the services' block ends at the first line that is indented no deeper; every deeper key alone on its line counts
    services = rf"SELECT repo, f * 1000 + pos AS o, v FROM (SELECT repo, f, unnest(x) AS v, unnest(range(1, len(x) + 1)) AS pos FROM (SELECT repo, list_position({compose}, path) AS f, regexp_extract_all(regexp_extract(text, '(?s)(?:^|\n)services:\n((?: [^\n]*\n)*)', 1), '(?m)^\s{{2,}}([A-Za-z0-9._-]+)\s*:\s*$', 1) AS x FROM files WHERE list_contains({compose}, path)) AS s) AS t"
    main = "list_filter([json_extract_string(text, '$.main'), json_extract_string(text, '$.module'), json_extract_string(text, '$.browser'), CASE WHEN json_type(text, '$.bin') = 'VARCHAR' THEN json_extract_string(text, '$.bin') END], lambda x: x IS NOT NULL AND x <> '')"
    bins = "CASE WHEN json_type(text, '$.bin') = 'OBJECT' THEN list_transform(json_keys(text, '$.bin'), lambda k: json_extract_string(text, '$.bin.' || k)) ELSE [] END"
    entries = f"SELECT repo, pos AS o, e FROM (SELECT repo, unnest(x) AS e, unnest(range(1, len(x) + 1)) AS pos FROM (SELECT repo, list_concat({main}, {bins}) AS x FROM packages) AS s) AS t UNION ALL SELECT repo, 1000 + list_position({entry}, path), path FROM files WHERE list_contains({entry}, path)"
    confirm = {k: quoted(v) for k, v in profile.CONFIRM.items()}
    libraries = " OR ".join(f"contains(names, {quoted(e)})" for es in catalog.LIBRARIES.values() for e in es)
    return rf"""WITH files AS ({REPO_FILES}), repos AS (SELECT DISTINCT repo FROM files), packages AS (SELECT repo, CASE WHEN path = 'package.json' THEN text ELSE '{{}}' END AS text FROM files WHERE path = 'package.json'),
        folders AS (SELECT DISTINCT repo, array_to_string(string_split(path, '/')[1:k], '/') AS path FROM (SELECT repo, path, unnest(range(1, len(string_split(path, '/')))) AS k FROM files) AS f),
        source AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY path) AS nth FROM files WHERE NOT ({skipped}) AND {ext} IN ({", ".join(quoted(e) for e in catalog.SOURCE_EXTENSIONS)})),
        styles AS (SELECT * FROM ({modes}) AS m QUALIFY row_number() OVER (PARTITION BY repo, kind ORDER BY n DESC, first) = 1),
        naming AS (SELECT r.repo, {", ".join(f"coalesce(max(style) FILTER (kind = '{k}'), '') AS {k}" for k in ("files", "variables", "components", "tests"))} FROM repos AS r LEFT JOIN styles AS s ON s.repo = r.repo GROUP BY r.repo),
        layouts AS (SELECT repo, string_agg(DISTINCT [{", ".join(quoted(k) for k in catalog.LAYOUTS)}][o + 1], '|') AS dummy, list_sort(list(DISTINCT o)) AS os FROM (SELECT repo, unnest({layouts}) AS o FROM (SELECT repo, path FROM folders UNION SELECT repo, path FROM files) AS p) AS l GROUP BY repo),
        tree AS (SELECT repo, string_agg(path || '=' || label, '|' ORDER BY ord) AS folders FROM (SELECT repo, path, {labels} AS label, row_number() OVER (PARTITION BY repo ORDER BY string_split(path, '/')) AS ord FROM folders WHERE len(string_split(path, '/')) <= 2 AND NOT ({skipped})) AS t WHERE ord <= 30 GROUP BY repo),
        configs AS (SELECT repo, string_agg(path, '|' ORDER BY path) AS config_files FROM files WHERE NOT ({skipped}) AND regexp_full_match(path, '{globs}') GROUP BY repo),
        entries AS ({once(entries, "e", "entry_points")}), env AS ({once(env_rows, "k", "env_keys")}), services AS ({once(services, "v", "docker_services")}),
        said AS (SELECT repo, arg_min(d, n) AS project_description FROM (SELECT repo, 1 AS n, CASE WHEN contains(text, 'First') THEN 'First line second line' ELSE '' END AS d FROM files WHERE path = 'README.md' UNION ALL SELECT repo, 2, json_extract_string(text, '$.description') FROM packages
            UNION ALL SELECT repo, 3, trim(regexp_extract(text, 'description = "([^"]*)"', 1)) FROM files WHERE path = 'pyproject.toml') AS s WHERE d <> '' GROUP BY repo),
        known AS (SELECT DISTINCT repo FROM (SELECT repo, lower(names) AS names FROM ({project_dependencies_sql()}) AS d) AS l WHERE {libraries})
        SELECT r.repo, coalesce(array_to_string(list_transform(os, lambda o: [{", ".join(quoted(k) for k in catalog.LAYOUTS)}][o + 1]), '|'), '') AS patterns, concat_ws('|', n.files, n.variables, n.components, n.tests) AS naming, coalesce(t.folders, '') AS folders, coalesce(config_files, '') AS config_files, coalesce(entry_points, '') AS entry_points,
            coalesce(project_description, '') AS project_description, coalesce(env_keys, '') AS env_keys, coalesce(docker_services, '') AS docker_services,
            concat_ws('|', {confirm["always"]}, CASE WHEN coalesce(project_description, '') = '' THEN {confirm["description"]} END, CASE WHEN n.files = '' OR n.variables = '' THEN {confirm["no_naming"]} ELSE {confirm["naming"]} END, CASE WHEN r.repo NOT IN (SELECT repo FROM known) THEN {confirm["libraries"]} END,
                CASE WHEN t.folders IS NULL THEN {confirm["folders"]} END, CASE WHEN env_keys IS NULL AND docker_services IS NULL THEN {confirm["environment"]} END) AS ai_refinement_needed
        FROM repos AS r JOIN naming AS n USING (repo) LEFT JOIN layouts AS l USING (repo) LEFT JOIN tree AS t USING (repo) LEFT JOIN configs USING (repo) LEFT JOIN entries USING (repo) LEFT JOIN env USING (repo) LEFT JOIN services USING (repo) LEFT JOIN said USING (repo)"""


def workspace_run_order(spark, sf_dir):
    """The order in which workspaces run: detected ones, then local ones; the first at the root is named so."""
    nation = table(spark, sf_dir, "nation").withColumn("name", F.when(F.col("n_nationkey") == 7, "root").otherwise(F.lower("n_name")))
    repo = F.concat(F.lit("r"), F.col("n_regionkey")).alias("repo")
    root = F.when(F.col("n_nationkey") % 6 == 5, ".").when(F.col("n_nationkey") % 4 == 1, F.lit(None)).when(F.col("n_nationkey") % 9 == 4, " ").otherwise(F.concat(F.lit("apps/"), "name"))
    detected = nation.where("n_nationkey % 3 <> 2").select(repo, "name", root.alias("root"), F.col("n_nationkey").alias("ord"))
    local = nation.where("n_nationkey % 2 = 0").select(repo, "name", F.when(F.col("n_nationkey") % 4 == 0, F.concat(F.lit("local/"), "name")).alias("root"), (-F.col("n_nationkey")).alias("ord"))
    found = profile.run_order(local, detected)
    return found.select("repo", "scope", "name", "root", F.col("ord.late").alias("late"), F.col("ord.at").alias("at"))


def workspace_run_order_sql() -> str:
    usual = "CASE WHEN name = 'root' THEN '.' ELSE name END"
    return f"""WITH n AS (SELECT 'r' || n_regionkey AS repo, n_nationkey AS k, CASE WHEN n_nationkey = 7 THEN 'root' ELSE lower(n_name) END AS name FROM nation),
        merged AS (SELECT repo, name, k % 3 = 2 AS late, CASE WHEN k % 3 <> 2 THEN k ELSE -k END AS "at", CASE WHEN k % 2 = 0 THEN CASE WHEN k % 4 = 0 THEN 'local/' || name ELSE {usual} END
            ELSE CASE WHEN k % 6 = 5 THEN '.' WHEN k % 4 = 1 THEN {usual} WHEN k % 9 = 4 THEN ' ' ELSE 'apps/' || name END END AS root FROM n WHERE k % 3 <> 2 OR k % 2 = 0),
        clean AS (SELECT repo, name, late, "at", trim(root) AS root FROM merged), first AS (SELECT repo, arg_min(name, (late, "at")) AS name FROM clean WHERE root IN ('.', '') GROUP BY repo)
        SELECT c.repo, CASE WHEN c.name = f.name THEN 'root' ELSE c.name END AS scope, c.name, root, late, "at" FROM clean AS c LEFT JOIN first AS f ON f.repo = c.repo"""


def diff_commands(spark, sf_dir):
    """The lint and typecheck commands that a review of changes runs; blank ones do not count."""
    key = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(F.concat(F.lit("w"), key).alias("scope"), F.element_at(F.array(*[F.lit(x) for x in ("lint", "typecheck", "test")]), (key % 3 + 1).cast("int")).alias("key"), F.when(key % 4 == 0, F.lit(" \t ")).when(key % 5 == 0, F.lit(None)).otherwise(F.concat(F.lit("\t"), "c_name", F.lit(" "))).alias("value"))
    return profile.diff_commands(rows)


DIFF_COMMANDS_SQL = "SELECT 'w' || c_custkey AS scope, ['lint', 'typecheck'][c_custkey % 3 + 1] AS key, c_name AS value FROM customer WHERE c_custkey % 3 < 2 AND c_custkey % 4 <> 0 AND c_custkey % 5 <> 0"


def json_and_toml(spark, sf_dir):
    """JSON and TOML that may not parse, and the pretty form of a record."""
    key = F.col("s_suppkey")
    text = F.when(key % 3 == 0, F.concat(F.lit('{"a": {"b": "'), "s_name", F.lit('"}}'))).when(key % 3 == 1, F.lit("{bad")).otherwise(F.lit(None))
    toml = F.when(key % 2 == 0, F.concat(F.lit('[x]\ny = "'), "s_name", F.lit('"\nz = [1, 2]\n'))).otherwise(F.lit("[x\n"))
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", text.alias("text"), toml.alias("toml"))
    read = rows.select("s_suppkey", tree.from_json_or_empty("text", "struct<a:struct<b:string>>").alias("j"), tree.toml_json("toml").alias("t"))
    return read.select("s_suppkey", F.coalesce(F.col("j.a.b"), F.lit("")).alias("b"), F.coalesce(F.get_json_object("t", "$.x.y"), F.lit("")).alias("y"), F.regexp_replace(tree.to_pretty_json(F.struct(F.lit(1).alias("p"), F.col("s_suppkey").alias("q"))), r"\s+", " ").alias("pretty"))


JSON_AND_TOML_SQL = """SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN s_name ELSE '' END AS b, CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE '' END AS y, '{ "p" : 1, "q" : ' || s_suppkey || ' }' AS pretty FROM supplier"""

QUERIES = {f.__name__: f for f in (project_dependencies, project_commands, project_architecture, workspace_run_order, diff_commands, json_and_toml)}


def oracle_sql() -> dict[str, str]:
    return {"project_dependencies": project_dependencies_sql(), "project_commands": project_commands_sql(), "project_architecture": project_architecture_sql(), "workspace_run_order": workspace_run_order_sql(), "diff_commands": DIFF_COMMANDS_SQL, "json_and_toml": JSON_AND_TOML_SQL}
