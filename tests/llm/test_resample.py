"""Importance resampling against plain counting, with blocks and parts so small that texts and strings meet across them."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from sparkloom.llm import resample

from .test_operators import empty, odd_rows

SCHEMA = "doc_id long, text string"


def features_plainly(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return words, [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def resampled_plainly(docs, target):
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s = collections.Counter(bucket(f) for _, t in docs for f in features_plainly(t)[1])
    t = collections.Counter(bucket(f) for x in target for f in features_plainly(x)[1])
    S, T = sum(s.values()), sum(t.values())
    out, order = [], []
    for i, text in docs:
        words, found = features_plainly(text)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000)))) for b in map(bucket, found))
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(found), weight, score, None])
        if len(words) >= 20:
            order.append((-score, i is None, i or 0, len(out) - 1))
    for rank, (*_, k) in enumerate(sorted(order)[: 5 * len(order) // 100]):
        out[k][4] = rank + 1
    return sorted(map(tuple, out), key=str)


def got(df):
    assert [f.dataType.simpleString() for f in df.schema] == ["bigint"] * 5
    return sorted(map(tuple, df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


def some_texts(rng, n):
    vocabulary = ["the", "The", "of", "É", "é", "naïve", "x1", "42", "汉字", "ß", *[f"w{i}" for i in range(30)]]
    return [(i, "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "-", "\n", "_"]) for _ in range(rng.randrange(60)))) for i in range(n)]


def test_crc_of_each_span():
    rng = random.Random(3)
    parts = [rng.randbytes(rng.choice([0, 1, 5, 63, 64, 65, 300])) for _ in range(500)]
    ends = np.cumsum([len(p) for p in parts])
    got = resample.crc32_each(np.frombuffer(b"".join(parts), np.uint8), ends - [len(p) for p in parts], ends)
    assert got.tolist() == [zlib.crc32(p) for p in parts]


@pytest.mark.parametrize("words,docs,part", [(1 << 20, 20_000, 2_000_000), (16, 20_000, 300), (300, 7, 50)])
def test_against_plain_counting(spark, monkeypatch, words, docs, part):
    for name, value in (("WORDS", words), ("DOCS", docs), ("PART_FEATURES", part)):
        monkeypatch.setattr(resample, name, value)
    rng = random.Random(words)
    texts = some_texts(rng, 200)
    target = [t for _, t in some_texts(rng, 20)] + ["a hot target"] * 3
    frame = spark.createDataFrame(texts, SCHEMA).repartition(5)
    rows = got(resample.resample(frame, spark.createDataFrame([(t,) for t in target], "text string")))
    assert rows == resampled_plainly(texts, target) and sum(r[4] is not None for r in rows) > 3


def test_odd_rows(spark):
    """Null, empty and very long texts, ties and repeated rows, null and repeated doc_ids, clashing columns, empty tables."""
    docs = odd_rows(spark)
    target = spark.createDataFrame([(1, "a b c d e f", "x"), (None, None, None), (2, "", "x"), (2, "汉字 ü", "x")], "item_id long, text string, TEXT string")
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        plain = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        assert got(resample.resample(docs, target)) == resampled_plainly(plain, ["a b c d e f", "", "", "汉字 ü"])
        assert got(resample.resample(docs, target.limit(0))) == resampled_plainly(plain, [])
    finally:
        spark.conf.unset("spark.sql.caseSensitive")
    assert got(resample.resample(empty(spark), target)) == []


def test_ties_go_to_the_smaller_doc_id(spark):
    words = " ".join(["w"] * 20)
    rows = [(i % 50, words) for i in range(400)]
    assert got(resample.resample(spark.createDataFrame(rows, SCHEMA).repartition(6), spark.createDataFrame([("w",)], "text string"))) == resampled_plainly(rows, ["w"])
