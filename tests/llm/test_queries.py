"""The registered queries on the smallest tables: one row per input row where the contract says so, and its columns."""

import hashlib
import math
import os
import re
import zlib

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from sparkloom.llm import compression, queries

from .test_operators import components_plainly, odd_rows, patterns_plainly, rule_plainly, split_plainly, statistics_plainly

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
COLUMNS = {
    "op2_urls": {"page_id", "host", "path", "rule", "verdict"},
    "op3_quality": {"doc_id", "held_out", "score", "predicted"},
    "op4_toxicity": {"doc_id", "held_out", "score", "predicted"},
    "op6_suffix": {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"},
    "op7_pii": {"doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"},
    "op9_minhash": {"doc_id", "n_shingles", "component_id", "kept"},
    "op10_language": {"doc_id", "held_out", "lang_pred", "score"},
    "op13_media": {"doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"},
}


def test_registered():
    assert [n for n in entry.queries() if re.match(r"op\d+_", n)] == list(queries.QUERIES) and "pipeline" in entry.queries()
    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES} == set(range(1, 14))


@pytest.mark.parametrize("name", list(COLUMNS))
def test_contract(spark, name):
    got = queries.QUERIES[name](spark, SF)
    assert COLUMNS[name] <= set(got.columns)
    rows = got.collect()
    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall())
    pages = dict(duckdb.sql(f"SELECT page_id, url FROM '{SF}/pages.parquet'").fetchall())
    assert sorted(r[0] for r in rows) == sorted(pages if name == "op2_urls" else texts)
    for r in rows:
        if name == "op2_urls":
            assert (r.host, r.path) == split_plainly(pages[r.page_id]) and r.rule == rule_plainly(r.host, r.path)[1] and r.verdict in ("allow", "block")
        if "held_out" in got.columns:
            modulus, held = (5, 0) if name == "op3_quality" else (4, 2)
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == held) and 0 <= r.score <= 1
        if "predicted" in got.columns:
            assert r.predicted == int(r.score >= 0.3)
        if name == "op13_media":
            data = texts[r.doc_id].encode()
            data += b"\xff" * (-len(data) % 576 or 576 * (not data))
            assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(texts[r.doc_id].encode()), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]))
        if name == "op7_pii":
            base = patterns_plainly(texts[r.doc_id])
            assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in base) for k in ("email", "ip", "card", "phone")]
            assert {",".join(map(str, s)).replace(",", ":") for s in base} <= set(r.spans.split(","))
    if name == "op9_minhash":
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == components_plainly(list(texts.items()))


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_against_duckdb(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    want = con.sql(queries.ORACLE_SQL[name]).select(*[f'"{c}"' for c in got.columns]).fetchall()
    rows = list(map(tuple, got.collect()))
    assert sorted(rows, key=str) == sorted(want, key=str) and len(rows) > 20
    assert name != "op8_lines" or any(r[3] > 0 for r in rows)


@pytest.mark.parametrize("name,label,modulus,held", [("op3_quality", "quality", 5, 0), ("op4_toxicity", "toxic", 4, 2)])
def test_classifiers_against_brute_force(spark, name, label, modulus, held):
    """The rows to learn from, the statistics and the scores, read one by one."""
    rows = duckdb.sql(f"SELECT doc_id, text, {label} FROM '{SF}/documents.parquet' LEFT JOIN '{SF}/labels.parquet' USING (doc_id)").fetchall()
    recipe = queries.QUALITY if label == "quality" else queries.TOXICITY
    learnt = sorted((t.encode(), k) for i, t, k in rows if k in (0, 1) and zlib.crc32(str(i).encode()) % modulus != held)
    model = compression.fit([t for t, _ in learnt], [k for _, k in learnt], recipe)
    got = {r.doc_id: r.score for r in queries.QUERIES[name](spark, SF).collect()}
    for i, text, _ in sorted(rows)[:60]:
        x = statistics_plainly(recipe, model.negative, model.positive, text.encode())
        if label == "quality":
            want = float(np.interp(x[0], model.knots, model.values))
        else:
            want = 1 / (1 + math.exp(-float(np.append(((x - model.knots[0]) / model.knots[1]).clip(-8, 8), 1) @ model.values)))
        assert got[i] == pytest.approx(want if text.strip() else model.prior, abs=1e-9)


def test_decontamination_and_packing(spark):
    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall())
    items = dict(duckdb.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall())
    got = {(r.doc_id, r.item_id) for r in queries.op5_decontamination(spark, SF).collect()}
    assert {(i, k) for i, t in texts.items() for k, x in items.items() if x in t} <= got
    total = {}
    for r in queries.op1_packing(spark, SF).collect():
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
    assert total == {i: len(t.encode()) + 1 for i, t in texts.items()}


def odd_tables(spark, folder, empty):
    """Tables with nulls in every column, empty and very long texts, ties, repeated rows, and extra columns with clashing names."""
    rows = [*odd_rows(spark).collect(), *odd_rows(spark).collect()]
    docs = spark.createDataFrame(rows, odd_rows(spark).schema)
    labels = spark.createDataFrame([(i % 9, i % 2 if i % 5 else None, i % 3 if i % 7 else None, "x") for i in range(40)] + [(None, 1, 1, None)], "doc_id long, quality int, toxic int, QUALITY string")
    pages = spark.createDataFrame([(None, None, None, "x"), (1, "", "", None), (1, "x://a.b/c/1", "<p>", "x"), (1, "x://a.b/c/1", "<p>", "x"), (2, "http://" + "a/" * 5000, None, "x")], "page_id long, url string, html string, URL string")
    benchmark = spark.createDataFrame([(1, "a b c d e f", "x"), (1, "a b c d e f", "x"), (None, "one", None), (2, None, None), (3, "", "x")], "item_id long, text string, TEXT string")
    turns = [(None, None, None, None, "x"), (0, None, None, None, "x"), (0, 1, "u", "a " * 50_000, "x"), (0, 1, "u", "a " * 50_000, "x"), (3, 1, "u", "", None), (3, 2, "", "b", "x"), (4, 2, "", "b", "x")]
    conversations = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, TEXT string")
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        for name, df in (("documents", docs), ("labels", labels), ("pages", pages), ("benchmark", benchmark), ("conversations", conversations)):
            (df.limit(0) if empty else df).write.parquet(f"{folder}/{name}.parquet")
    finally:
        spark.conf.unset("spark.sql.caseSensitive")
    return {"documents": 0 if empty else len(rows), "pages": 0 if empty else 5}


@pytest.mark.parametrize("empty", [False, True])
def test_every_query_on_odd_tables(spark, tmp_path, empty):
    n = odd_tables(spark, tmp_path, empty)
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        for name, query in [*queries.QUERIES.items(), ("pipeline", entry.queries()["pipeline"])]:
            got = query(spark, str(tmp_path)).collect()
            if name not in ("op1_packing", "op5_decontamination", "op11_trie", "pipeline"):
                assert len(got) == n["pages" if name == "op2_urls" else "documents"], name
            assert empty == (not got), name
    finally:
        spark.conf.unset("spark.sql.caseSensitive")


def test_scratch_needs_a_shared_folder(spark):
    from types import SimpleNamespace

    from sparkloom.llm import textcore

    no = SimpleNamespace(get=lambda k, d=None: None if "checkpoint" in k else "/w")
    made = lambda master: SimpleNamespace(conf=no, sparkContext=SimpleNamespace(getConf=lambda: no, master=master))
    assert textcore.scratch(made("local[4]")).startswith("/w/_scratch/")
    for master in ("yarn", "k8s://x", "local-cluster[3,2,1000]", "spark://h:7077"):
        with pytest.raises(RuntimeError):
            textcore.scratch(made(master))
    t = textcore.materialize(spark.range(3))
    assert t.count() == 3 and os.path.isdir(t.scratch_path.removeprefix("file://"))
    textcore.release(t)
    assert not os.path.isdir(t.scratch_path.removeprefix("file://"))
