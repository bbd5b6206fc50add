"""Trees, decoding and ordered lines as tables."""

import random

import pyarrow as pa
import pytest

from sparkloom.sources import tree


def test_listing_in_rounds(spark, tmp_path):
    rng = random.Random(1)
    made = {"top.py": b"a"}
    for i in range(300):
        made["/".join(rng.choice(["a", "b", ".c", "_d", "e f", "é"]) for _ in range(rng.randrange(1, 7))) + f"/f{i}.txt"] = rng.randbytes(i)
    made |= {"a/node_modules/x.js": b"1", "yarn.lock": b"", "b/vendor": b"file", "__init__.py": b"", ".env": b"k"}
    for name, data in made.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    (tmp_path / "loop").symlink_to(tmp_path)
    (tmp_path / "link.txt").symlink_to(tmp_path / "top.py")
    made["link.txt"] = b"a"
    every = {(r.path, r.size, bytes(r.content)) for r in tree.read_tree(spark, str(tmp_path), everything=True).collect()}
    assert every == {(p, len(d), d) for p, d in made.items()}
    kept = {r.path for r in tree.listing(spark, f"file://{tmp_path}").collect()}
    assert kept == set(made) - {"a/node_modules/x.js", "yarn.lock", "b/vendor"}
    assert tree.listing(spark, str(tmp_path / "none")).collect() == []


def test_files_are_read_only_if_asked_for(spark, tmp_path):
    """Neither a column that is not used nor a row that a filter drops costs a read."""
    for i in range(20):
        (tmp_path / f"{i}.txt").write_text(f"text {i}")
    files = tree.read_tree(spark, str(tmp_path), "r")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "EvalPython" not in plan(files.select("repo", "path")) and "EvalPython" in plan(files)
    some = plan(files.where("path LIKE '1%'"))
    assert some.index("EvalPython") < some.index("StartsWith") if "StartsWith" in some else "Filter" in some.split("EvalPython")[1]
    (tmp_path / "3.txt").unlink()
    assert {r.path: r.content for r in files.where("path IN ('3.txt', '4.txt')").collect()} == {"3.txt": None, "4.txt": b"text 4"}


def test_decoding_of_whole_batches():
    rng = random.Random(2)
    pieces = [b"\xe2\x82\xac", b"\xff", b"\r\n", b"\r", b"\n", b"a", "é".encode(), b"\xc3", b"\xf0\x9f\x98", b"\xed\xa0\x80", b"\xef\xbb\xbf"]
    for _ in range(300):
        files = [b"".join(rng.choice([*pieces, rng.randbytes(2).replace(b"\0", b"")]) for _ in range(rng.randrange(12))) for _ in range(rng.randrange(9))]
        got = tree.decode_all(pa.array(files, pa.binary())).to_pylist()
        assert got == [f.decode("utf-8", "ignore").replace("\r\n", "\n").replace("\r", "\n") for f in files]


@pytest.mark.parametrize("n", [0, 1, 5000])
def test_ordered_parts_and_their_manifest(spark, tmp_path, n):
    rows = [(f"{i:06d} line",) for i in range(n)]
    random.Random(3).shuffle(rows)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ordered = spark.createDataFrame(rows, "value string").repartition(7).orderBy("value")
        manifest = tree.write_lines(ordered, str(tmp_path / "out")).orderBy("part").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = sorted((tmp_path / "out").glob("part-*"))
    assert "".join(p.read_text() for p in parts) == "".join(f"{v}\n" for (v,) in sorted(rows))
    at = 1
    for row in manifest:
        lines = (tmp_path / "out" / row.part).read_text().splitlines()
        assert row.first == at and row.n == len(lines)
        at += row.n
    assert at == n + 1 and (n < 5000 or len(manifest) > 1)
