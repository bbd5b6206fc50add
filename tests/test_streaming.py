"""Findings over a stream equal findings over the same files in one batch."""

from sparkloom.operators import scan
from sparkloom.plans import review
from sparkloom.streaming import findings


def test_stream_equals_batch(spark, tmp_path):
    schema = "repo string, path string, text string"
    rows = [("r", f"a{i}.py", "x = 12345\n# TODO" if i % 2 else "eval(1)") for i in range(6)] + [("r", "b.bin", "eval(1)")]
    spark.createDataFrame(rows, schema).repartition(3).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).json(str(tmp_path / "in"))
    findings.start(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    want = scan.rule_findings(review.scanned(spark.createDataFrame(rows, schema)))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 9
