"""The scan of a corpus as a whole: filters, all detectors, workspaces, order and rendering."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import catalog
from ..functions import text as tx
from ..operators import lookups, scan

FALLBACK_FILES = 500
NOTHING = "No heuristic gotchas detected."


@dataclass(frozen=True)
class Config:
    """What the scan takes from a local configuration: workspaces (name, root) in order, and prefixes that it leaves out."""

    workspaces: tuple[tuple[str, str], ...] = ()
    prefixes: tuple[str, ...] = field(default=())

    @classmethod
    def from_json(cls, text: str | None) -> Config:
        """Text that does not parse is an empty configuration."""
        try:
            data = json.loads(text or "{}")
        except ValueError:
            data = {}
        spaces = tuple((n, (w or {}).get("root") or n) for n, w in (data.get("workspaces") or {}).items())
        paths = data.get("paths") or {}
        return cls(spaces, tuple([*(paths.get("ignore") or []), *(paths.get("generated") or [])]))


@dataclass(frozen=True)
class Settings:
    """What the scan takes from the configuration of each repository: workspaces (repo, name, root, ord), prefixes (repo, prefix)."""

    workspaces: DataFrame
    prefixes: DataFrame

    @classmethod
    def from_json(cls, configs: DataFrame) -> Settings:
        """configs: repo, text (JSON), one a repository. Text that does not parse is an empty configuration."""
        schema = "struct<workspaces:map<string,struct<root:string>>,paths:struct<ignore:array<string>,generated:array<string>>>"
        parsed = configs.select("repo", F.from_json("text", schema).alias("c"))
        spaces = parsed.select("repo", F.posexplode(F.map_entries("c.workspaces")).alias("ord", "w"))
        root = F.coalesce(F.nullif("w.value.root", F.lit("")), "w.key")
        none = F.expr("CAST(array() AS array<string>)")
        prefixes = F.concat(F.coalesce("c.paths.ignore", none), F.coalesce("c.paths.generated", none))
        return cls(spaces.select("repo", F.col("w.key").alias("name"), root.alias("root"), "ord"), parsed.select("repo", F.explode(prefixes).alias("prefix")))


def scanned(files: DataFrame, config: Config | Settings = Config(), most: int | None = None) -> DataFrame:  # noqa: B008
    """repo, path (normalised), text of the files that the scan takes. most: the first so many paths in order count, before
    their kind is asked; with Settings, of each repository."""
    # a path that loses more than a leading ./ names no file any more, so dotfiles at the root are never read
    named = files.where(tx.normalize_path("path") == F.regexp_replace("path", r"^(\./)+", ""))
    rows = _kept(named.select("repo", tx.normalize_path("path").alias("path"), "text"), config)
    if most is not None:
        rows = rows.orderBy("path").limit(most) if isinstance(config, Config) else lookups.first_paths(rows, most).drop("nth")
    return rows.where(tx.is_text("path") & (F.coalesce(F.length("text"), F.lit(0)) > 0))


def _kept(files: DataFrame, config: Config | Settings) -> DataFrame:
    """files (normalised paths) without what the scan or the configuration leaves out."""
    if isinstance(config, Config):
        return files.where(~tx.is_ignored("path", list(config.prefixes)))
    return lookups.outside_prefixes(files.where(~tx.is_ignored("path")), config.prefixes)


def findings(files: DataFrame, config: Config | Settings = Config(), most: int | None = None) -> DataFrame:  # noqa: B008
    """workspace, rule, line, path, snippet, seq and repo of all detectors, unordered."""
    taken = scanned(files, config, most)
    deps = lookups.package_dependencies(_kept(files.withColumn("path", tx.normalize_path("path")), config))
    parts = [scan.rule_findings(taken), scan.count_findings(taken), scan.block_findings(taken), lookups.unknown_python_imports(taken, lookups.top_directories(files)), lookups.unknown_js_imports(taken, deps), scan.literal_findings(taken)]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    out = out.withColumn("workspace", lookups.longest_prefix(F.col("path"), config.workspaces)) if isinstance(config, Config) else lookups.labelled(out, config.workspaces)
    return out.select("workspace", "rule", "line", "path", "snippet", "seq", "repo")


def ordered(found: DataFrame) -> DataFrame:
    return found.orderBy("path", "line", "rule", "workspace", "seq")


def rendered(found: DataFrame) -> DataFrame:
    """value: one line per finding, ordered."""
    place = F.concat(F.lit("["), F.col("rule"), F.lit("] "), F.col("path"), F.lit(":"), F.col("line"), F.lit(" :: "), F.col("snippet"))
    return ordered(found).select(F.concat(F.when(F.col("workspace") != "", F.concat(F.lit("["), "workspace", F.lit("]"))).otherwise(F.lit("")), place).alias("value"))


def finding_records(found: DataFrame) -> DataFrame:
    """found and value: a record (severity, title, layer, location, impact, evidence, fix) in the report's shape. Layers are numbers."""
    names = F.array(*[F.lit(k) for k in catalog.LAYER_TITLES])
    line = lambda k, v: F.concat(F.lit(f"- {k}: "), v)
    layer = F.concat(F.lit("Layer "), "layer", F.lit(": "), F.element_at(names, F.col("layer").cast("int")))
    head = F.concat(F.lit("### ["), F.initcap("severity"), F.lit("] "), "title")
    place = F.concat(F.lit("`"), "location", F.lit("`"))
    return found.withColumn("value", F.concat_ws("\n", head, F.lit(""), line("Layer", layer), line("Location", place), line("Impact", F.col("impact")), line("Evidence", F.col("evidence")), line("Fix", F.col("fix"))))


def verification_records(checks: DataFrame) -> DataFrame:
    """checks and value: a record (command, exit_code, output, interpretation) in the report's shape."""
    line = lambda k, c: F.concat(F.lit(f"- {k}: `"), F.col(c).cast("string"), F.lit("`"))
    return checks.withColumn("value", F.concat_ws("\n", line("Command", "command"), line("Exit code", "exit_code"), line("Relevant output", "output"), line("Interpretation", "interpretation")))


def report_document(found: DataFrame, checks: DataFrame | None = None, skipped: DataFrame | None = None) -> DataFrame:
    """part, layer, ord, key, line, value: the lines of the whole review document; sorted by all but value they are in order.

    found: what finding_records takes, and key (a number that orders findings of equal layer and severity). checks: what
    verification_records takes, and key. skipped: value (what was not run), and key. Each layer has its heading, and says so
    if it has no findings. Findings are joined to headings by small fixed tables only, so they stay where they are until the
    order is asked for. A severity or layer outside the fixed ones is no part of the document.
    """
    spark = found.sparkSession
    columns = ["part", "layer", "ord", "key", "line", "value"]

    def fixed(rows: list[tuple]) -> DataFrame:
        return spark.createDataFrame(rows, "part int, layer int, ord int, key long, line int, value string")

    def lines(df: DataFrame, part: int, layer: Column, order: Column) -> DataFrame:
        each = df.select(F.lit(part).alias("part"), layer.cast("int").alias("layer"), order.cast("int").alias("ord"), F.col("key").cast("long").alias("key"), F.posexplode(F.split(F.concat("value", F.lit("\n")), "\n")).alias("line", "value"))
        return each.select(*columns)

    titles = list(enumerate(catalog.LAYER_TITLES, 1))
    severity = F.array_position(F.array(*[F.lit(s) for s in catalog.SEVERITIES]), F.col("severity"))
    known = found.where(F.col("severity").isin(catalog.SEVERITIES) & F.col("layer").between(1, len(titles)))
    heads = fixed([(1, 0, 0, 0, 0, "## Findings by Layer"), (1, 0, 0, 0, 1, ""), *[(1, n, 0, 0, i, x) for n, t in titles for i, x in enumerate((f"### Layer {n}: {t}", ""))]])
    empty = fixed([(1, n, 1, 0, i, x) for n, _ in titles for i, x in enumerate(("- No issues found in this layer.", ""))])
    out = heads.union(lines(finding_records(known), 1, F.col("layer"), severity)).union(empty.join(known.select(F.col("layer").cast("int").alias("layer")).distinct(), "layer", "left_anti").select(*columns))
    out = out.union(fixed([(2, 0, 0, 0, 0, "## Verification"), (2, 0, 0, 0, 1, "")]))
    if checks is not None:
        out = out.union(lines(verification_records(checks), 2, F.lit(0), F.lit(1)))
    out = out.union(fixed([(3, 0, 0, 0, 0, "- Not run / not verified:")]))
    if skipped is not None:
        out = out.union(skipped.select(F.lit(3), F.lit(0), F.lit(1), F.col("key").cast("long"), F.lit(0), F.concat(F.lit("  - "), "value")).toDF(*columns))
    return out


def report(found: DataFrame) -> list[str]:
    """The rendered findings on the driver, or the one message where there are none."""
    return [r.value for r in rendered(found).collect()] or [NOTHING]
