"""Project profiles of repositories: commands and stacks per directory, workspaces, and the architecture report.

Input files: repo, path, text (null for binaries). All repositories of the input are profiled in one plan; a directory's
markers are found by one equi-join of marker paths with the listing.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import catalog
from ..functions import text as tx
from ..operators import lookups
from ..sources import tree
from ..sources.shared import written

# Fixed values. Ecosystems in order: marker files, stack label, manager, and commands; then what depends on further files.
ECOSYSTEMS = [
    (["go.mod"], "go", "go", {"test": "go test ./...", "build": "go build ./...", "lint": "go vet ./..."}),
    (["Cargo.toml"], "rust", "cargo", {"test": "cargo test", "build": "cargo build", "lint": "cargo clippy -- -D warnings", "format": "cargo fmt -- --check"}),
    (["Gemfile"], "ruby", "bundler", {"install": "bundle install", "test": "bundle exec rspec", "lint": "bundle exec rubocop"}),
    (["composer.json"], "php", "composer", {"install": "composer install", "test": "composer test", "lint": "composer lint"}),
    (["pom.xml"], "java", "maven", {"install": "mvn -q -DskipTests compile", "test": "mvn test", "build": "mvn package"}),
]
PYTHON_MARKERS = ["pyproject.toml", "requirements.txt", "setup.py", "setup.cfg", "Pipfile", "poetry.lock", "uv.lock"]
PYTHON_TOOLS = {
    "uv": {"install": "uv sync", "test": "uv run pytest", "lint": "uv run ruff check .", "format": "uv run ruff format --check ."},
    "poetry": {"install": "poetry install", "test": "poetry run pytest", "lint": "poetry run ruff check ."},
    "pip": {"install": "python -m pip install .", "test": "pytest", "lint": "ruff check ."},
}
REQUIREMENTS_INSTALL = "python -m pip install -r requirements.txt"
JS_RUNNERS = {"pnpm": "pnpm", "yarn": "yarn", "bun": "bun", "npm": "npm run"}
JS_SCRIPTS = {"lint": ["lint"], "typecheck": ["typecheck", "check-types"], "test": ["test"], "build": ["build"], "format": ["format"]}
JS_EXTRAS = [(["next.config.js", "next.config.mjs", "next.config.ts"], "nextjs"), (["tsconfig.json"], "typescript"), (["turbo.json"], "turborepo"), (["nx.json"], "nx"), (["lerna.json"], "lerna")]
FLUTTER = {"install": "flutter pub get", "test": "flutter test", "build": "flutter build"}
DART = {"install": "dart pub get", "test": "dart test"}
DOTNET = {"build": "dotnet build", "test": "dotnet test"}
SWIFT = {"build": "swift build", "test": "swift test"}
TERRAFORM = {"format": "terraform fmt -check -recursive", "build": "terraform validate"}
LISTED = 400  #: files of a repository that the naming report looks at
WORKSPACE_ROOTS = ["apps/*", "libs/*", "packages/*"]

MARKERS = sorted({*PYTHON_MARKERS, *[m for ms, *_ in ECOSYSTEMS for m in ms], *[m for ms, _ in JS_EXTRAS for m in ms], "package.json", "pnpm-lock.yaml", "yarn.lock", "bun.lockb", "bun.lock", "mypy.ini", "pyrightconfig.json", "build.gradle", "build.gradle.kts", "gradlew", "Package.swift", "pubspec.yaml", ".github/workflows", *catalog.MIGRATION_PATHS, *catalog.CRITICAL_PATHS})


def _join(dir_: Column, name: Column) -> Column:
    return F.when(dir_ == "", name).otherwise(F.concat(dir_, F.lit("/"), name))


def _texts(files: DataFrame, name: str, to: str) -> DataFrame:
    at = F.regexp_extract("path", "(?s)^(?:(.*)/)?[^/]*$", 1)
    return files.where(tx.file_name("path") == name).select("repo", at.alias("dir"), F.coalesce("text", F.lit("")).alias(to))


def directory_facts(files: DataFrame, dirs: DataFrame) -> DataFrame:
    """repo, dir, found (marker paths below it), package, pubspec. dirs: repo, dir ('' is the root)."""
    paths = lookups.with_ancestors(files).select("repo", "path")
    wanted = dirs.select("repo", "dir", F.explode(F.array(*[F.lit(m) for m in MARKERS])).alias("marker")).withColumn("path", _join(F.col("dir"), F.col("marker")))
    found = wanted.join(paths, ["repo", "path"], "left_semi").select("repo", "dir", "marker")
    parent, name = F.regexp_extract("path", "(?s)^(?:(.*)/)?[^/]*$", 1), tx.file_name("path")
    dotnet = files.where(name.rlike(r"(?s)^.*\.(sln|csproj)$")).select("repo", parent.alias("dir"), F.lit("*.sln").alias("marker"))
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    terraform = files.where(name.rlike(r"(?s)^.*\.tf$")).select("repo", F.explode(above).alias("dir"), F.lit("*.tf").alias("marker"))
    marked = found.union(dotnet).union(terraform).groupBy("repo", "dir").agg(F.collect_set("marker").alias("found"))
    out = dirs.join(marked, ["repo", "dir"], "left").join(_texts(files, "package.json", "package"), ["repo", "dir"], "left").join(_texts(files, "pubspec.yaml", "pubspec"), ["repo", "dir"], "left")
    return out.withColumn("found", F.coalesce("found", F.expr("CAST(array() AS array<string>)")))


def detect(files: DataFrame, dirs: DataFrame) -> DataFrame:
    """One row per directory: repo, dir, stack, package_managers, commands (map), generated, ignore, critical, six risk lists, notes, uncertain."""
    facts = directory_facts(files, dirs)
    has = lambda *names: F.arrays_overlap("found", F.array(*[F.lit(n) for n in names]))
    package = F.from_json("package", "struct<scripts:map<string,string>>")
    readable = has("package.json") & F.from_json("package", "map<string,string>").isNotNull()
    scripts = F.coalesce(package["scripts"], F.expr("CAST(map() AS map<string,string>)"))
    manager = F.when(has("pnpm-lock.yaml"), "pnpm").when(has("yarn.lock"), "yarn").when(has("bun.lockb", "bun.lock"), "bun").otherwise("npm")
    runner = F.element_at(F.create_map(*[F.lit(x) for kv in JS_RUNNERS.items() for x in kv]), manager)
    python = has(*PYTHON_MARKERS)
    tool = F.when(has("uv.lock"), "uv").when(has("poetry.lock"), "poetry").otherwise("pip")
    gradle = has("build.gradle", "build.gradle.kts")
    flutter = has("pubspec.yaml") & F.contains("pubspec", F.lit("flutter:"))
    steps: list[tuple[Column, Column | str, Column | str | None, dict]] = [(has("package.json"), "javascript/typescript", None, {})]
    js = {"install": F.concat(manager, F.lit(" install"))}
    for key, names in JS_SCRIPTS.items():
        js[key] = F.coalesce(*[F.when(F.map_contains_key(scripts, n), F.concat(runner, F.lit(f" {n}"))) for n in names])
    steps.append((readable, None, manager, js))
    steps += [(readable & has(*ms), label, None, {}) for ms, label in JS_EXTRAS]
    commands = {k: F.coalesce(*[F.when(tool == t, c[k]) for t, c in PYTHON_TOOLS.items() if k in c]) for k in ("install", "test", "lint", "format")}
    commands["install"] = F.when((tool == "pip") & has("requirements.txt"), REQUIREMENTS_INSTALL).otherwise(commands["install"])
    commands["typecheck"] = F.when(has("mypy.ini"), "mypy .").when(has("pyrightconfig.json"), "pyright")
    steps.append((python, "python", tool, commands))
    steps += [(has(*ms), label, m, c) for ms, label, m, c in ECOSYSTEMS]
    wrapper = F.when(has("gradlew"), "./gradlew").otherwise("gradle")
    steps.append((gradle, "java/kotlin", "gradle", {"test": F.concat(wrapper, F.lit(" test")), "build": F.concat(wrapper, F.lit(" build"))}))
    steps += [(has("*.sln"), ".net", "dotnet", DOTNET), (has("Package.swift"), "swift", "swift", SWIFT), (flutter, "flutter", "dart", FLUTTER), (has("pubspec.yaml") & ~flutter, "dart", "dart", DART), (has("*.tf"), "terraform", "terraform", TERRAFORM)]

    def col(x) -> Column:
        return x if isinstance(x, Column) else F.lit(x).cast("string")

    def gather(pairs: list[tuple[Column, Column | str]]) -> Column:
        return F.array_distinct(F.array_compact(F.array(*[F.when(c, col(v)) for c, v in pairs])))

    first = {k: F.coalesce(*[F.when(c, col(cmd[k])) for c, _, _, cmd in steps if k in cmd], F.lit("")) for k in catalog.COMMAND_KEYS}
    nextjs = readable & has(*JS_EXTRAS[0][0])
    critical = [(nextjs, "app/"), (nextjs, "middleware.ts"), (has("*.tf"), "infra/"), *[(has(p), p) for p in catalog.MIGRATION_PATHS], *[(has(p), p) for p in catalog.CRITICAL_PATHS], (has(".github/workflows"), ".github/workflows")]
    none = F.expr("CAST(array() AS array<string>)")
    return facts.select(
        "repo", "dir", gather([(c, s) for c, s, _, _ in steps if s is not None]).alias("stack"), gather([(c, m) for c, _, m, _ in steps if m is not None]).alias("package_managers"),
        F.create_map(*[x for k in catalog.COMMAND_KEYS for x in (F.lit(k), first[k])]).alias("commands"), none.alias("generated"), none.alias("ignore"), gather(critical).alias("critical"),
        gather([(nextjs, "middleware.ts")]).alias("auth_sensitive"), none.alias("payment_sensitive"), gather([(has(p), p) for p in catalog.MIGRATION_PATHS]).alias("migration_sensitive"),
        gather([(has("*.tf"), "*.tf")]).alias("infra_sensitive"), none.alias("pii_sensitive"), none.alias("destructive_sensitive"), none.alias("notes"),
        gather([(has("package.json") & ~readable, "Could not parse package.json")]).alias("uncertain"),
    )


def _fits(name: Column, segment: Column) -> Column:
    """Whether a name fits one segment of a glob. One star is a beginning and an end; only a segment with more than that, or with
    other marks, becomes a pattern of its own."""
    before, after = F.substring_index(segment, "*", 1), F.substring_index(segment, "*", -1)
    simple = F.startswith(name, before) & F.endswith(name, after) & (F.length(name) >= F.length(before) + F.length(after))
    pattern = F.regexp_replace(segment, r"([.+()^$|{}\\])", r"\\$1")
    pattern = F.replace(F.regexp_replace(F.regexp_replace(pattern, r"\*+", "[^/]*"), r"\?", "[^/]"), F.lit("[!"), F.lit("[^"))
    hard = F.contains(segment, F.lit("?")) | F.contains(segment, F.lit("[")) | (F.length(F.regexp_replace(segment, "[^*]", "")) > 1)
    return F.when(hard, F.rlike(name, F.concat(F.lit("(?s)^(?:"), pattern, F.lit(")$")))).otherwise(simple)


def expanded(patterns: DataFrame, dirs: DataFrame) -> DataFrame:
    """The rows of patterns (repo, pattern and more) with each directory (path) of dirs (repo, path, with all their parents) that
    the pattern takes. ``*`` stays within a name; ``**`` takes any number of directories, none included; the root is never taken.

    A pattern walks the tree a level a round, as a state: its segments, how many are done, and the directory reached. A plain
    segment is an equi-join with the one child of that name, a wildcard one with the children, and ``**`` is a state that
    stays while it descends. So a pattern only meets directories that its beginning has reached.
    """
    child = dirs.select("repo", "path", F.regexp_extract("path", "(?s)^(?:(.*)/)?[^/]*$", 1).alias("dir"), tx.file_name("path").alias("name"))
    segments = F.filter(F.split("pattern", "/"), lambda x: (x != "") & (x != "."))
    columns = patterns.columns
    rows = patterns.withColumn("segments", segments).withColumn("dir", F.lit("")).withColumn("done", F.lit(0))
    # a ** may also take nothing: states behind each of the ** that come next
    rest = F.slice("segments", F.col("done") + 1, F.greatest(F.size("segments") - F.col("done"), F.lit(0)))
    run = F.array_position(F.transform(rest, lambda x: x != "**"), True)
    free = F.when(run > 0, run - 1).otherwise(F.size(rest)).cast("int")
    taken = None
    while True:
        states = rows.withColumn("done", F.explode(F.sequence(F.col("done"), F.col("done") + free))).distinct()
        states = written(states.withColumn("next", F.try_element_at("segments", F.col("done") + 1)))
        found = states.where("next IS NULL AND dir <> ''").select(*columns, F.col("dir").alias("path"))
        taken = found if taken is None else taken.union(found)
        live = states.where("next IS NOT NULL")
        if live.isEmpty():
            return taken.distinct()
        wild = F.col("next").rlike(r"[*?\[]")
        to = F.when(F.col("dir") == "", F.col("next")).otherwise(F.concat("dir", F.lit("/"), "next"))
        plain = live.where(~wild).withColumn("path", to).join(child.select("repo", "path"), ["repo", "path"])
        below = live.where(wild).join(child, ["repo", "dir"]).where((F.col("next") == "**") | _fits(F.col("name"), F.col("next")))
        step = F.when(F.col("next") == "**", F.col("done")).otherwise(F.col("done") + 1)
        keep = [*columns, "segments", F.col("path").alias("dir"), step.alias("done")]
        rows = plain.select(*keep).union(below.select(*keep))


def workspaces(files: DataFrame) -> DataFrame:
    """repo, dir, ord of each workspace: what the repository's workspace files name, else its marked child directories."""
    skipped = F.exists(F.split("path", "/"), lambda p: p.isin(catalog.COMMAND_SKIPPED) | F.startswith(p, F.lit(".")))
    dirs = lookups.with_ancestors(files).where("is_dir").where(~skipped).select("repo", "path")
    root = files.where(~F.contains("path", F.lit("/"))).select("repo", F.col("path").alias("name"), "text")
    strings = "array<string>"

    def listed(name: str, patterns: Column, source: int) -> DataFrame:
        return root.where(F.col("name") == name).select("repo", F.lit(source).alias("source"), F.posexplode(patterns).alias("at", "pattern"))

    npm = F.coalesce(F.from_json("text", f"struct<workspaces:{strings}>")["workspaces"], F.from_json("text", f"struct<workspaces:struct<packages:{strings}>>")["workspaces"]["packages"])
    pnpm = F.transform(F.regexp_extract_all("text", F.lit(tx.pattern_flags("m") + catalog.PNPM_ITEM_PATTERN), F.lit(1)), tx.strip)
    fixed = F.array(*[F.lit(p) for p in WORKSPACE_ROOTS])
    named = listed("package.json", npm, 0).union(listed("pnpm-workspace.yaml", pnpm, 1)).union(listed("lerna.json", F.from_json("text", f"struct<packages:{strings}>")["packages"], 3)).union(listed("nx.json", fixed, 4)).union(listed("turbo.json", fixed, 5))
    cargo = root.where("name = 'Cargo.toml'").withColumn("text", tree.toml_json("text")).select("repo", F.lit(2).alias("source"), F.posexplode(F.from_json("text", f"struct<workspace:struct<members:{strings}>>")["workspace"]["members"]).alias("at", "pattern"))
    named = named.union(cargo).where("pattern IS NOT NULL").withColumn("pattern", tx.strip("pattern")).where("pattern <> '' AND NOT startswith(pattern, '!')")
    explicit = expanded(named, dirs).groupBy("repo", "path").agg(F.min(F.struct("source", "at")).alias("first"))
    explicit = explicit.select("repo", F.col("path").alias("dir"), F.struct(F.col("first.source"), F.col("first.at"), F.col("path")).alias("ord"))
    child = F.regexp_extract("path", "(?s)^([^/]+)/[^/]+$", 1)
    marked = files.where(tx.file_name("path").isin(catalog.REPO_MARKERS) | tx.file_name("path").rlike(r"(?s)\.(sln|csproj)$")).select("repo", child.alias("path")).where("path <> ''").distinct()
    fallback = marked.join(dirs, ["repo", "path"], "left_semi").join(explicit.select("repo").distinct(), "repo", "left_anti")
    return explicit.union(fallback.select("repo", "path", F.struct(F.lit(9).alias("source"), F.lit(0).alias("at"), "path")))


def dependencies(files: DataFrame) -> DataFrame:
    """repo, name, first_at: the dependencies that the root's manifests name, once each, ordered as the manifests are."""
    root = files.where(~F.contains("path", F.lit("/"))).select("repo", F.col("path").alias("file"), F.coalesce("text", F.lit("")).alias("text"))

    def of(file: str, names: Column, source: int) -> DataFrame:
        return root.where(F.col("file") == file).select("repo", F.lit(source).alias("source"), F.posexplode(names).alias("at", "name"))

    def keys(data: Column, *fields: str) -> Column:
        return F.flatten(F.array_compact(F.array(*[F.map_keys(data[f]) for f in fields])))

    anything = "map<string,string>"
    npm = F.from_json("text", f"struct<dependencies:{anything},devDependencies:{anything},peerDependencies:{anything}>")
    toml = root.where("file IN ('pyproject.toml', 'Cargo.toml')").withColumn("text", tree.toml_json("text"))
    py = F.from_json("text", f"struct<project:struct<dependencies:array<string>>,tool:struct<poetry:struct<dependencies:{anything}>>>")
    poetry = F.filter(F.map_keys(py["tool"]["poetry"]["dependencies"]), lambda x: F.lower(x) != "python")
    names = F.flatten(F.array_compact(F.array(F.transform(py["project"]["dependencies"], tx.requirement_name), poetry)))
    cargo = keys(F.from_json("text", f"struct<dependencies:{anything},`dev-dependencies`:{anything},`build-dependencies`:{anything}>"), "dependencies", "dev-dependencies", "build-dependencies")
    composer = keys(F.from_json("text", f"struct<require:{anything},`require-dev`:{anything}>"), "require", "require-dev")
    go = F.concat(F.regexp_extract_all("text", F.lit(tx.pattern_flags("m") + catalog.GO_REQUIRE_PATTERN), F.lit(1)), F.regexp_extract_all("text", F.lit(tx.pattern_flags("m") + catalog.GO_VERSION_PATTERN), F.lit(1)))
    ruby = F.regexp_extract_all("text", F.lit(tx.pattern_flags("m") + catalog.GEM_PATTERN), F.lit(1))
    parts = [of("package.json", keys(npm, "dependencies", "devDependencies", "peerDependencies"), 0), of("go.mod", go, 2), of("Gemfile", ruby, 3), of("composer.json", composer, 5)]
    for file, found, source in (("pyproject.toml", names, 1), ("Cargo.toml", cargo, 4)):
        parts.append(toml.where(F.col("file") == file).select("repo", F.lit(source).alias("source"), F.posexplode(found).alias("at", "name")))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.where("name <> ''").groupBy("repo", "name").agg(F.min(F.struct("source", "at")).alias("first_at"))


def naming(files: DataFrame, most: int = 80, listed: int = LISTED) -> DataFrame:
    """repo, kind (files, variables, components, tests), style: the most frequent one, of equal ones the first seen.

    Only the first so many listed files of a repository count, source files or not, and of their source files the first most
    give names."""
    open_files = files.where(~tx.is_hidden_or_skipped("path"))
    # the order is found among paths alone; texts join only for the few that are read
    first = lookups.first_paths(open_files.select("repo", "path"), listed)
    ranked = lookups.first_paths(first.where(F.lower(tx.suffix("path")).isin(catalog.SOURCE_EXTENSIONS)).select("repo", "path"), listed)
    few = open_files.join(ranked.where(F.col("nth") <= most), ["repo", "path"])
    py, js, part = (tx.pattern_flags(f) + p for f, p in (("m", catalog.PY_NAME_PATTERN), ("", catalog.JS_NAME_PATTERN), ("", catalog.COMPONENT_PATTERN)))
    ext = tx.suffix("path")

    def found(where: Column, names: Column) -> DataFrame:
        return few.where(where).select("repo", F.col("nth").alias("a"), F.posexplode(names).alias("b", "name"))

    pynames = F.transform(F.arrays_zip(F.regexp_extract_all("text", F.lit(py), F.lit(1)).alias("x"), F.regexp_extract_all("text", F.lit(py), F.lit(2)).alias("y")), lambda z: F.coalesce(F.nullif(z["x"], F.lit("")), z["y"]))
    variables = found(ext == ".py", pynames).union(found(ext.isin(".js", ".jsx", ".ts", ".tsx"), F.regexp_extract_all("text", F.lit(js), F.lit(1))))
    rows = few.select("repo", F.lit("files").alias("kind"), "nth", F.lit(0).alias("at"), tx.name_style(tx.stripped_name("path")).alias("style"))
    rows = rows.union(variables.select("repo", F.lit("variables"), "a", "b", tx.name_style("name")))
    rows = rows.union(found(ext.isin(".jsx", ".tsx"), F.regexp_extract_all("text", F.lit(part), F.lit(1))).select("repo", F.lit("components"), "a", "b", F.lit("PascalCase")))
    rows = rows.union(ranked.select("repo", F.lit("tests"), "nth", F.lit(0), tx.test_pattern("path")))
    return lookups.mode_first_seen(rows, "style", ["nth", "at"], ["repo", "kind"]).select("repo", "kind", "style")


def env_keys(files: DataFrame) -> DataFrame:
    """repo, key, first_at of the keys in the environment templates, once each."""
    order = F.array_position(F.array(*[F.lit(f) for f in catalog.ENV_FILES]), F.col("path"))
    lines = files.where(F.col("path").isin(catalog.ENV_FILES)).select("repo", order.alias("file"), F.posexplode(F.split("text", r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\u0085  ]")).alias("at", "line"))
    key = tx.strip(F.substring_index("line", "=", 1))
    rows = lines.withColumn("line", tx.strip("line")).where("NOT startswith(line, '#') AND contains(line, '=')").withColumn("key", key).where("key <> ''")
    return rows.groupBy("repo", "key").agg(F.min(F.struct("file", "at")).alias("first_at"))


def first_paragraph(text: Column) -> Column:
    """The first run of lines that are neither blank, heading nor image, joined by spaces; headings do not end it."""
    lines = F.transform(F.split(text, tx.LINE_ENDS), tx.strip)
    kept = F.filter(lines, lambda x: ~(F.startswith(x, F.lit("#")) | F.startswith(x, F.lit("![")) | F.startswith(x, F.lit("[!["))))
    joined = F.array_join(F.transform(kept, lambda x: F.when(x == "", F.lit("\u0001")).otherwise(x)), " ")
    return F.trim(F.coalesce(F.try_element_at(F.filter(F.transform(F.split(joined, "\u0001"), lambda x: F.trim(x)), lambda x: x != ""), F.lit(1)), F.lit("")))


def service_names(text: str) -> list[str]:
    """Names in the services blocks of a compose file: any key alone on its line that is indented deeper than the header."""
    lines = text.splitlines()
    heads = [i for i, x in enumerate(lines) if re.match(r"^\s*services\s*:\s*$", x)]
    out = []
    for head, following in zip(heads, [*heads[1:], len(lines)], strict=False):
        base = _indent(lines[head])
        for line in itertools.takewhile(lambda x: not x.strip() or _indent(x) > base, lines[head + 1 : following]):  # noqa: B023
            out += re.findall(r"^\s{2,}([A-Za-z0-9._-]+)\s*:\s*$", line)
    return out


def _indent(line: str) -> int:
    return len(line) - len(line.lstrip(" "))


def compose_services(files: DataFrame) -> DataFrame:
    """repo, service, first_at of the services in the compose files at the root, once each."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(r, p, i, n) for r, p, t in zip(*[b.column(c).to_pylist() for c in ("repo", "path", "text")], strict=True) for i, n in enumerate(service_names(t or ""))]
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.string(), pa.string(), pa.int32(), pa.string()], strict=True)], ["repo", "path", "at", "service"])

    order = F.array_position(F.array(*[F.lit(f) for f in catalog.COMPOSE_FILES]), F.col("path"))
    rows = files.where(F.col("path").isin(catalog.COMPOSE_FILES)).select("repo", "path", "text").mapInArrow(found, "repo string, path string, at int, service string")
    return rows.groupBy("repo", "service").agg(F.min(F.struct(order.alias("file"), F.col("at"))).alias("first_at"))


def entry_points(files: DataFrame) -> DataFrame:
    """repo, entry, first_at: what package.json names as main, module, browser and bin, then conventional files."""
    package = files.where("path = 'package.json'").select("repo", F.from_json("text", "struct<main:string,module:string,browser:string,bin:string>").alias("j"), F.from_json("text", "struct<bin:map<string,string>>").alias("b"))
    strings = F.array("j.main", "j.module", "j.browser", F.when(F.col("b.bin").isNull(), F.col("j.bin")))
    plain = F.filter(F.array_compact(strings), lambda x: (x != "") & ~x.rlike(r"^[\[{]"))
    named = package.select("repo", F.lit(0).alias("source"), F.posexplode(F.concat(plain, F.coalesce(F.map_values("b.bin"), F.expr("CAST(array() AS array<string>)")))).alias("at", "entry"))
    at = F.array_position(F.array(*[F.lit(p) for p in catalog.ENTRY_POINTS]), F.col("path")).cast("int")
    usual = files.where(F.col("path").isin(catalog.ENTRY_POINTS)).select("repo", F.lit(1).alias("source"), at.alias("at"), F.col("path").alias("entry"))
    return named.union(usual).groupBy("repo", "entry").agg(F.min(F.struct("source", "at")).alias("first_at"))


def config_files(files: DataFrame) -> DataFrame:
    """repo, path of the configuration files; those whose own name begins with a dot are skipped like all hidden paths."""
    return tree.glob_files(files.where(~tx.is_hidden_or_skipped("path")), catalog.CONFIG_GLOBS)


def descriptions(files: DataFrame) -> DataFrame:
    """repo, description: the readme's first paragraph, else the package's, else the project's own."""
    toml = files.where("path = 'pyproject.toml'").withColumn("text", tree.toml_json("text")).select("repo", F.lit(3).alias("source"), F.from_json("text", "struct<project:struct<description:string>>")["project"]["description"].alias("d"))
    readme = files.where("path = 'README.md'").select("repo", F.lit(1).alias("source"), first_paragraph(F.col("text")).alias("d"))
    package = files.where("path = 'package.json'").select("repo", F.lit(2).alias("source"), F.from_json("text", "struct<description:string>")["description"].alias("d"))
    rows = readme.union(package).union(toml).withColumn("d", tx.strip("d")).where("d <> ''")
    return rows.groupBy("repo").agg(F.min_by("d", "source").alias("description"))


# Fixed values. What is left to confirm by hand.
CONFIRM = {
    "always": "Confirm architecture pattern classification",
    "description": "Add a concise project description from the codebase context",
    "no_naming": "Identify naming conventions not captured by heuristics",
    "naming": "Identify domain-specific conventions not captured by heuristics",
    "libraries": "Verify key libraries and runtime integrations",
    "folders": "Label important folders that heuristics could not classify",
    "environment": "Confirm required environment setup and local services",
}


def architecture(files: DataFrame) -> DataFrame:
    """One row per repository: patterns, key_libraries, naming, folder_structure, config_files, entry_points,
    project_description, env_keys, docker_services, ai_refinement_needed."""
    paths = lookups.with_ancestors(files)

    def ordered(df: DataFrame, value: str, order: str, name: str) -> DataFrame:
        listed = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v")))), lambda x: x["v"])
        return df.groupBy("repo").agg(listed.alias(name))

    layout_order = F.array_position(F.array(*[F.lit(k) for k in catalog.LAYOUTS]), F.col("layout"))
    libraries = lookups.categories(dependencies(files), "name").groupBy("repo", "category").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col("first_at").alias("o"), F.col("name").alias("v")))), lambda x: x["v"]).alias("names"))
    folders = lookups.folder_structure(paths)
    out = files.select("repo").distinct()
    for part in (
        ordered(lookups.layouts(paths).withColumn("o", layout_order), "layout", "o", "patterns"),
        libraries.groupBy("repo").agg(F.map_from_entries(F.collect_list(F.struct("category", "names"))).alias("libraries")),
        naming(files).groupBy("repo").agg(F.map_from_entries(F.collect_list(F.struct("kind", "style"))).alias("styles")),
        folders.groupBy("repo").agg(F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("ord", "path", "label"))), lambda x: F.struct(x["path"], x["label"]))).alias("folders")),
        config_files(files).groupBy("repo").agg(F.sort_array(F.collect_list("path")).alias("configs")),
        ordered(entry_points(files), "entry", "first_at", "entries"),
        descriptions(files),
        ordered(env_keys(files), "key", "first_at", "keys"),
        ordered(compose_services(files), "service", "first_at", "services"),
    ):
        out = out.join(part, "repo", "left")
    none = F.expr("CAST(array() AS array<string>)")
    or_none = lambda c: F.coalesce(F.col(c), none)
    style = lambda k: F.coalesce(F.try_element_at("styles", F.lit(k)), F.lit(""))
    empty = lambda c: F.size(F.coalesce(F.col(c), none)) == 0
    todo = F.array_compact(
        F.array(
            F.lit(CONFIRM["always"]),
            F.when(F.coalesce("description", F.lit("")) == "", CONFIRM["description"]),
            F.when((style("files") == "") | (style("variables") == ""), CONFIRM["no_naming"]).otherwise(CONFIRM["naming"]),
            F.when(F.col("libraries").isNull(), CONFIRM["libraries"]),
            F.when(F.col("folders").isNull(), CONFIRM["folders"]),
            F.when(empty("keys") & empty("services"), CONFIRM["environment"]),
        )
    )
    return out.select(
        "repo", or_none("patterns").alias("patterns"), F.create_map(*[x for k in catalog.LIBRARIES for x in (F.lit(k), F.coalesce(F.try_element_at("libraries", F.lit(k)), none))]).alias("key_libraries"),
        F.create_map(*[x for k in ("files", "variables", "components", "tests") for x in (F.lit(k), style(k))]).alias("naming"), F.coalesce("folders", F.expr("CAST(map() AS map<string,string>)")).alias("folder_structure"),
        or_none("configs").alias("config_files"), or_none("entries").alias("entry_points"), F.coalesce("description", F.lit("")).alias("project_description"), or_none("keys").alias("env_keys"), or_none("services").alias("docker_services"), todo.alias("ai_refinement_needed"),
    )


# Which commands would run where


def run_order(local: DataFrame, detected: DataFrame) -> DataFrame:
    """repo, scope, name, root, ord of the workspaces in running order. Both frames: repo, name, root, ord.

    Detected names come first, then those that are local only; a local workspace's root holds. The first workspace at its
    repository's root has scope 'root'.
    """
    x, y = detected.select("repo", "name", F.col("root").alias("d_root"), F.col("ord").alias("d_ord")), local.select("repo", "name", F.col("root").alias("l_root"), F.col("ord").alias("l_ord"), F.lit(True).alias("own"))
    both = x.join(y, ["repo", "name"], "full_outer")
    usual = F.when(F.col("name") == "root", ".").otherwise(F.col("name"))
    root = tx.strip(F.coalesce(F.nullif(F.when(F.col("own"), F.coalesce("l_root", usual)).otherwise(F.coalesce("d_root", usual)), F.lit("")), "name", F.lit(".")))
    rows = both.select("repo", "name", root.alias("root"), F.struct(F.col("d_ord").isNull().alias("late"), F.coalesce("d_ord", "l_ord").alias("at")).alias("ord"))
    first = rows.where("root IN ('.', '')").groupBy("repo").agg(F.min("ord").alias("first"))
    return rows.join(first, "repo", "left").select("repo", F.when(F.col("ord") == F.col("first"), "root").otherwise(F.col("name")).alias("scope"), "name", "root", "ord")


def diff_commands(commands: DataFrame) -> DataFrame:
    """scope, key, value of what a diff review runs: configured lint and typecheck commands; nothing is inherited."""
    return commands.where("key IN ('lint', 'typecheck')").withColumn("value", tx.strip(F.coalesce("value", F.lit("")))).where("value <> ''").select("scope", "key", "value")
