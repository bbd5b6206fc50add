"""Media columns: round trips, the tar files themselves, and what each row has against plain Python."""

import hashlib
import io
import random
import tarfile
import zlib

import pytest

from sparkloom.llm import media

from .test_operators import empty, odd_rows


def padded_plainly(text):
    data = (text or "").encode()
    while not data or len(data) % 576:
        data += b"\xff"
    return data


def test_images_round_trip():
    rng = random.Random(1)
    for n in (0, 1, 575, 576, 577, 5760, 20_000_000):
        samples = media.payload(rng.randbytes(n))
        image = media.encode(samples)
        assert len(samples) % 576 == 0 and len(samples) - n <= 576 and media.decode(image) == samples
        assert media.header(image[: media.HEADER_BYTES]) == (576, len(samples) // 576, 8, 0)
    with pytest.raises(ValueError):
        media.decode(image[:100] + bytes([image[100] ^ 1]) + image[101:])
    with pytest.raises(ValueError):
        media.header(image[1:34])


def test_feature_tells_texts_apart():
    same, other = media.payload(b"abc " * 500), media.payload(b"zzyx " * 500)
    assert media.feature(same) == media.feature(bytes(same)) != media.feature(other)
    x = list(media.payload(b"hello " * 999))
    cuts = [i * len(x) // 65 for i in range(66)]
    means = [sum(x[a:b]) * 1000 // (b - a) for a, b in zip(cuts, cuts[1:], strict=False)]
    bits = sum((means[i + 1] > means[i]) << (63 - i) for i in range(64))
    assert media.feature(bytes(x)) == f"{bits:016x}:{sum(x) * 1000 // len(x)}:{len(set(x))}"


def test_rows_and_shards(spark, tmp_path):
    docs = odd_rows(spark).repartition(3)
    rows = media.media_columns(docs, str(tmp_path / "m"), limit=4000).collect()
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    want = sorted(((i, len((t or "").encode()), hashlib.sha256(padded_plainly(t)).hexdigest(), zlib.crc32(padded_plainly(t)[-32:]), len(padded_plainly(t))) for i, t in texts), key=key)
    assert sorted(((r.doc_id, r.n_bytes, r.payload_sha256, r.tail_crc32, r.width * r.height) for r in rows), key=key) == want
    names = {}
    for shard in (tmp_path / "m").iterdir():
        with tarfile.open(shard) as tar:
            for entry in tar:
                names[entry.name] = tar.extractfile(entry).read()
    assert len(list((tmp_path / "m").iterdir())) > 1 and set(names) == {f"{r.digest}.png" for r in rows}
    for r in rows:
        image = names[f"{r.digest}.png"]
        assert hashlib.sha256(image).hexdigest() == r.digest == r.media_sha256 and len(image) == r.length
        with open(r.shard, "rb") as f:
            f.seek(r.offset)
            assert f.read(r.length) == image
        assert (r.bit_depth, r.colour_type, r.width) == (8, 0, 576) and r.feature == media.feature(media.decode(image))
    by_text = {}
    for r in rows:
        assert by_text.setdefault(r.payload_sha256, (r.media_sha256, r.feature, r.shard, r.offset)) == (r.media_sha256, r.feature, r.shard, r.offset)
    assert media.media_columns(empty(spark)).collect() == []


def test_only_the_range_is_read(spark, tmp_path):
    """Headers come from their own bytes: a shard whose images are blank behind them still has its metadata columns."""
    stored = media.store(spark.createDataFrame([(i, "text " * i) for i in range(400)], "doc_id long, text string").coalesce(1), str(tmp_path / "m"))
    places = media.places(stored)
    [shard] = (tmp_path / "m").iterdir()
    kept = bytearray(shard.stat().st_size)
    data = shard.read_bytes()
    for r in places.collect():
        kept[r.offset : r.offset + media.HEADER_BYTES] = data[r.offset : r.offset + media.HEADER_BYTES]
    shard.write_bytes(kept)
    heights = {r.height for r in media.headers(places).collect()}
    assert heights == {max(1, -(-5 * i // 576)) for i in range(400)}
    with pytest.raises(Exception, match="damaged|PNG|zlib|Error"):
        media.contents(media.headers(places)).collect()


def test_copies_are_stored_once_a_task(spark, tmp_path):
    docs = spark.range(5000).selectExpr("id AS doc_id", "'the same text' AS text").repartition(4)
    rows = media.media_columns(docs, str(tmp_path / "m"))
    assert rows.count() == 5000 and rows.select("shard", "offset").distinct().count() == 1
    assert sum(len(tarfile.open(fileobj=io.BytesIO(p.read_bytes())).getmembers()) for p in (tmp_path / "m").iterdir()) == 4
