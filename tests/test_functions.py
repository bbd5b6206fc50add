"""Path and name functions against values derived by hand and Python's own."""

import fnmatch
from pathlib import PurePosixPath

from pyspark.sql import functions as F

from sparkloom.functions import text as tx


def values(spark, fn, inputs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r.y for r in df.select("i", fn(F.col("x")).alias("y")).orderBy("i").collect()]


def test_paths(spark):
    paths = ["a/b.py", ".env", ".github/w.yml", "../x", "./a", "a//b", "x.", "a.b.c", "dir/.x.y", "noext", "Dockerfile", "a/./b"]
    assert values(spark, tx.normalize_path, paths) == [PurePosixPath(p).as_posix().lstrip("./") for p in paths]
    assert values(spark, tx.suffix, paths) == [PurePosixPath(p).suffix if not p.endswith(".") else "" for p in paths]
    plain = [p for p in paths if not p.endswith(".")]
    assert values(spark, tx.stem, plain) == [PurePosixPath(p).stem for p in plain]


def test_names(spark):
    names = ["", None, "a-b", "a_b", "a-b_c", "Abc", "abc", "A", "9x", "aB1"]
    assert values(spark, tx.name_style, names) == ["unknown", "unknown", "kebab-case", "snake_case", "kebab-case", "PascalCase", "camelCase", "unknown", "unknown", "camelCase"]
    assert values(spark, tx.stripped_name, ["x.test.jsx", "x.test.tsx", "y.d.ts", "z.spec.js", "w.py"]) == ["x.test", "x", "y", "z", "w"]
    assert values(spark, tx.test_pattern, ["a.test.js", "b.spec.ts", "c_test.go", "test_d.py", "e_spec.rb", "f.py"]) == ["*.test.js", "*.spec.ts", "*_test.go", "test_*.py", "*_spec.rb", None]
    assert values(spark, tx.package_name, ["@a/b/c", "@a", "x/y", "x"]) == ["@a/b", "@a", "x", "x"]
    assert values(spark, tx.directory_label, ["src/auth", "src/zzz", "zzz"]) == ["authentication and authorization", "application source code", "application code"]
    assert values(spark, tx.language, ["a.TSX", "b.h", "c.md"]) == ["typescript", "cpp", None]


def test_globs(spark):
    globs = ["*.json", "**/scripts/**", "*test*", "tsconfig.*.json", "a?c", "[ab].py", "[!a].py", "x.y"]
    paths = ["a.json", "d/a.json", "scripts/x.py", "d/scripts/x.py", "atestb/c", "tsconfig.a.json", "abc", "a.py", "c.py", "xzy", "x.y", "d/\nabc"]
    for g in globs:
        assert values(spark, lambda c, g=g: tx.matches_any(c, [g]), paths) == [fnmatch.fnmatchcase(p, g) or fnmatch.fnmatchcase(p.split("/")[-1], g) for p in paths], g
