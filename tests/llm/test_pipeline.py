"""The pipeline on the smallest tables: each stage against its operator's plain counterpart, and odd rows."""

import os

import pytest

import corpus_pipeline
from sparkloom.llm import decontam, pii
from sparkloom.llm.textcore import Block, materialize

from .test_operators import DOC, components_plainly

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_stages(spark):
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before = {r.doc_id: r for r in docs.collect()}
    for name, stage in stages.items():
        out = materialize(stage(spark, docs, SF))
        after = {r.doc_id: r for r in out.collect()}
        if name != "best-fit packing":
            assert out.columns == columns
        if name == "quality classifier":
            assert set(after) < set(before) and len(after) > len(before) / 2
            assert all(after[i] == before[i] for i in after)
        elif name == "MinHash near-dedup":
            parts = components_plainly([(i, r.text) for i, r in before.items()])
            assert set(after) == {i for i, (_, part) in parts.items() if i == part}
        elif name == "benchmark decontamination":
            ids = list(before)
            hit = {ids[m[0]] for m in decontam.Index(items).matches(Block.of([before[i].text for i in ids]), exhaustive=True)}
            assert set(after) == set(before) - hit
            assert not any(t in r.text for r in after.values() for _, t in items)
        elif name == "PII":
            assert set(after) == set(before)
            assert not any(pii.patterns(r.text) for r in after.values())
            assert all(r.n_chars == len(r.text) for r in after.values())
        else:
            total = {}
            for r in out.collect():
                total[r.doc_id] = total.get(r.doc_id, 0) + r.length
            assert total == {i: len(r.text.encode()) + 1 for i, r in before.items()}
        docs, before = out, after


def test_stages_on_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (3, "a b c d e f", "en", "s", 11), (3, "a b c d e f", "en", "s", 11), (None, "x", None, None, None)], DOC)
    for empty in (False, True):
        rows = docs.limit(0) if empty else docs
        for _, stage in corpus_pipeline.STAGES:
            rows = materialize(stage(spark, rows, SF))
        assert rows.count() == 0 if empty else rows.count() > 0


def test_rows_are_dropped_one_by_one(spark):
    """Null and repeated doc_ids: each row stands for itself."""
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    copy, other = " ".join(f"copied{i}" for i in range(60)), " ".join(f"other{i}" for i in range(60))
    row = lambda i, t: (i, t, "en", "s", len(t))
    docs = spark.createDataFrame([row(None, copy), row(None, other + " end"), row(1, copy), row(2, copy), row(2, other), row(4, "same words in every row"), row(4, "same words in every row"), row(None, ""), row(None, "  ")], DOC)
    got = sorted((r.doc_id or 0, r.text) for r in corpus_pipeline.near_dedup(spark, docs, SF).collect())
    assert got == sorted([(0, ""), (0, "  "), (1, copy), (2, other), (4, "same words in every row")])
    docs = spark.createDataFrame([row(None, other), row(None, f"{copy} {item} {other}"), row(3, item), row(3, copy)], DOC)
    got = sorted((r.doc_id or 0, r.text) for r in corpus_pipeline.decontaminate(spark, docs, SF).collect())
    assert got == [(0, other), (3, copy)]
