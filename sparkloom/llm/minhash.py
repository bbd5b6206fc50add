"""MinHash near-dedup: one-permutation hashing with optimal densification, banded buckets and star-shaped edges.

A document's set holds the distinct runs of five words (A-Z lower-cased).  One hash per member is dealt by its top
bits into BINS bins, of which each keeps the least; an empty bin copies a full one that a fixed hash sequence
picks.  BANDS bands of equal width give the buckets.  At similarity 0.75 a band of four agrees with probability
0.32, so 32 bands miss a pair with probability 5e-6.

Documents with one set collapse first.  In each bucket every member is paired with the bucket's least member (a
star), and pairs are confirmed on the full sets.  A bucket whose members are then still in different components
gets a second star around another centre.  Where components still meet in a bucket after that, the pairs across them
are held against each other block by block, and only those come out that may be similar enough by a bitmap of each set: a
bit that one set has and the other lacks is a member that the other lacks, so no similar pair is left out.  They are
confirmed on the full sets like the others.  So no link between components is lost, and a group of near copies never
becomes all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import connected_components
from .textcore import Block, blocks, materialize, mix, pick, release, windows

WORDS, BINS, BANDS, PERCENT = 5, 128, 32, 75
BITMAP = 32  #: 64-bit numbers of a set's bitmap
BLOCK = 1000  #: members of a bucket that are held against as many others in one task
_TRIES = 1024


def _donors() -> np.ndarray:
    """For each bin, the sequence of bins that it tries while it is empty."""
    x = np.arange(BINS, dtype=np.uint64)[:, None] * np.uint64(_TRIES) + np.arange(_TRIES, dtype=np.uint64)[None]
    return (mix(x + np.uint64(77)) % np.uint64(BINS)).astype(np.int64)


def shingle_sets(block: Block, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts one after another, and the bounds of each text's part.

    A text with fewer words is one shingle; a text without words has none.
    """
    starts, ends, ptr = block.words()
    h = block.hashes(starts, ends, lower=True)
    found, first = windows(h, ptr, words)
    text = np.searchsorted(ptr, first, side="right") - 1
    counts = np.diff(ptr)
    short = np.flatnonzero((counts > 0) & (counts < words))
    whole = []
    for i in short:
        x = np.array([counts[i]], np.uint64)
        for y in range(ptr[i], ptr[i + 1]):
            x = mix(x + h[y : y + 1])
        whole.append(x[0])
    if whole:
        text = np.concatenate([text, short])
        found = np.concatenate([found, np.array(whole, np.uint64)])
        order = np.argsort(text, kind="stable")
        text, found = text[order], found[order]
    bounds = np.searchsorted(text, np.arange(len(block) + 1))
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        found[a:b].sort()
    fresh = np.ones(len(found), bool)
    fresh[1:] = (found[1:] != found[:-1]) | (text[1:] != text[:-1])
    return found[fresh], np.searchsorted(text[fresh], np.arange(len(block) + 1))


def signatures(members: np.ndarray, bounds: np.ndarray, donors: np.ndarray) -> np.ndarray:
    """Densified one-permutation signatures, one row per set; sets without members get zeros."""
    n = len(bounds) - 1
    owner = np.repeat(np.arange(n), np.diff(bounds))
    bin_of = (members >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)
    cell = owner * BINS + bin_of
    first = np.ones(len(cell), bool)
    first[1:] = cell[1:] != cell[:-1]
    flat, full = np.zeros(n * BINS, np.uint64), np.zeros(n * BINS, bool)
    flat[cell[first]], full[cell[first]] = members[first], True
    sig, full = flat.reshape(n, BINS), full.reshape(n, BINS)
    rows = np.flatnonzero((np.diff(bounds) > 0) & ~full.all(1))
    missing = np.argwhere(~full[rows])
    at, slot = rows[missing[:, 0]], missing[:, 1]
    for t in range(_TRIES):
        if not len(at):
            break
        donor = donors[slot, t]
        hit = full[at, donor]
        sig[at[hit], slot[hit]] = flat[at[hit] * BINS + donor[hit]] if t == 0 else sig[at[hit], donor[hit]]
        at, slot = at[~hit], slot[~hit]
    for i, j in zip(at, slot, strict=True):  # after so many tries: the next full bin
        full_bins = np.flatnonzero(full[i])
        sig[i, j] = sig[i, full_bins[np.searchsorted(full_bins, j) % len(full_bins)]]
    return sig


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One bucket key per band of equal width."""
    width = BINS // BANDS
    keys = np.zeros((len(sig), BANDS), np.uint64) + np.arange(BANDS, dtype=np.uint64)
    for i in range(width):
        keys = mix(keys + sig[:, i::width])
    return keys


def bitmaps(members: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each set a bitmap to which each member gives one bit."""
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    bit = (mix(members) % np.uint64(64 * BITMAP)).astype(np.int64)
    out = np.zeros((len(bounds) - 1, BITMAP), np.uint64)
    np.bitwise_or.at(out, (owner, bit >> 6), np.uint64(1) << (bit & 63).astype(np.uint64))
    return out


def similar_bitmaps(n: np.ndarray, part: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the pairs in different components that their bitmaps let be similar enough.

    With m of x's n members missing in y, at most n - m are shared, so the similarity p/100 needs
    100 (n - m) >= p (size of y + m).
    """
    names, inverse, counts = np.unique(part, return_inverse=True, return_counts=True)
    few = np.flatnonzero(inverse != counts.argmax())
    left, right = [], []
    for x in np.array_split(few, max(1, len(few) * len(n) // 100_000)):
        more = np.zeros((len(x), len(n)), np.int64)
        less = np.zeros_like(more)
        for k in range(bits.shape[1]):
            own, other = bits[x, k][:, None], bits[None, :, k]
            more += np.bitwise_count(own & ~other)
            less += np.bitwise_count(other & ~own)
        nx, ny = n[x][:, None], n[None]
        ok = (inverse[x][:, None] != inverse[None]) & (100 * (nx - more) >= PERCENT * (ny + more)) & (100 * (ny - less) >= PERCENT * (nx + less))
        i, j = np.nonzero(ok)
        left.append(x[i])
        right.append(j)
    return np.concatenate(left), np.concatenate(right)


def _block_pairs(rows: pa.Table) -> pa.Table:
    """applyInArrow: similar_bitmaps of one block of a bucket."""
    ids = rows.column("id").to_numpy()
    bits = np.asarray(rows.column("bitmap").combine_chunks().flatten()).astype(np.int64).view(np.uint64).reshape(len(ids), BITMAP)
    i, j = similar_bitmaps(rows.column("n").to_numpy(), rows.column("part").to_numpy(), bits)
    pairs = np.unique(np.stack([np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])], 1), axis=0) if len(i) else np.zeros((0, 2), np.int64)
    return pa.table({"a": pa.array(pairs[:, 0], pa.int64()), "b": pa.array(pairs[:, 1], pa.int64())})


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    donors = _donors()
    for part, block in blocks(batches, "text"):
        members, bounds = shingle_sets(block)
        sig = signatures(members, bounds, donors)
        keys, bits = band_keys(sig).view(np.int64), bitmaps(members, bounds).view(np.int64)
        sums = np.zeros((2, len(members) + 1), np.uint64)
        np.cumsum(members, out=sums[0, 1:])
        np.cumsum(mix(members ^ np.uint64(0xA5A5A5A5)), out=sums[1, 1:])
        s = (sums[:, bounds[1:]] - sums[:, bounds[:-1]]).view(np.int64)
        lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(block) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel())) for x in (keys, bits)]
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id"), pa.array(np.diff(bounds).astype(np.int64)), pa.array(s[0]), pa.array(s[1]), *lists],
            ["doc_id", "n_shingles", "set_a", "set_b", "bands", "bitmap"],
        )


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keeps the pairs (a, b) whose texts' sets are similar enough."""
    for batch in batches:
        for part, other in blocks(iter([batch]), "text_b"):
            for sub, block in blocks(iter([part]), "text_a"):
                x, at = shingle_sets(block)
                y, by = shingle_sets(Block.from_arrow(sub.column("text_b")) if sub.num_rows < part.num_rows else other)
                keep = np.zeros(sub.num_rows, bool)
                for i in range(sub.num_rows):
                    p, q = x[at[i] : at[i + 1]], y[by[i] : by[i + 1]]
                    if len(p) and len(q):
                        both = len(np.intersect1d(p, q, assume_unique=True))
                        keep[i] = 100 * both >= PERCENT * (len(p) + len(q) - both)
                yield sub.select(["a", "b"]).filter(pa.array(keep))


def _confirm(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Joins both texts to candidate pairs and keeps those that the full sets confirm, as a table.

    The pairs of a star's centre share a key; both joins are of plain shuffles whose other side has few rows a key, so that
    adaptive execution splits such keys.
    """
    pairs = materialize(pairs)
    ids = materialize(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    texts = materialize(docs.join(ids, "doc_id", "left_semi"))
    both = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b").join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    kept = materialize(both.select("a", "b", "text_a", "text_b").mapInArrow(_confirmed, "a long, b long"))
    release(pairs, ids, texts)
    return kept


def _stars(rows: DataFrame, centre) -> DataFrame:
    """Pairs of every bucket member with the bucket's centre, if they are in different components and near in size.

    rows: key, id, n, part (component); centre: the order that picks it.
    """
    hubs = materialize(rows.groupBy("key").agg(F.min_by(F.struct("id", "n", "part"), centre).alias("hub"), F.count("*").alias("members")).where("members > 1").select("key", "hub"))
    pairs = rows.join(hubs, "key").where(f"part <> hub.part AND 100 * least(n, hub.n) >= {PERCENT} * greatest(n, hub.n)")
    return pairs.select(F.least("id", "hub.id").alias("a"), F.greatest("id", "hub.id").alias("b")).distinct()


def _second_stars(mixed: DataFrame) -> DataFrame:
    """Stars around another member than the first centre, the least id; with it a bucket of three is compared in full."""
    return _stars(mixed, F.struct(F.col("id") == F.col("least"), F.xxhash64("id", "key")))


def _mixed(rows: DataFrame, labels: DataFrame, least_size: int) -> DataFrame:
    """Members, with their component and the bucket's least id, of the buckets that still span several components."""
    named = materialize(rows.join(labels.withColumnRenamed("node", "id"), "id", "left").select("key", "id", "n", F.coalesce("label", "id").alias("part")))
    open_keys = materialize(named.groupBy("key").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), F.min("id").alias("least"), F.count("*").alias("size")).where(F.expr(f"lo <> hi AND size >= {least_size}")).select("key", "size", "least"))
    out = materialize(named.join(open_keys, "key"))
    release(named, open_keys)
    return out


def _across(mixed: DataFrame, signed: DataFrame) -> DataFrame:
    """Pairs of members of one bucket and different components that their bitmaps let be similar enough.

    A bucket is cut into parts of about BLOCK members by a hash, and each two parts meet in a block of their own, so
    that no task holds a whole bucket.
    """
    ids = materialize(mixed.select("id").distinct())
    bits = signed.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "bitmap").join(ids, "id", "left_semi").groupBy("id", "n").agg(F.any_value("bitmap").alias("bitmap"))
    full = mixed.join(materialize(bits), ["id", "n"])
    cuts = F.ceil(F.col("size") / BLOCK).cast("int")
    full = full.withColumn("own", F.pmod(F.xxhash64("id"), cuts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), cuts - 1)))
    blocks_ = full.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "id", "n", "part", "bitmap")
    return blocks_.groupBy("key", "i", "j").applyInArrow(_block_pairs, "a long, b long").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id long, text string; others are ignored).

    A null or blank text has no shingles and no links. A row without doc_id has no links, no component and is kept.
    Rows that repeat a doc_id report the same component if their texts have the same set.
    """
    docs = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_shingles", T.LongType()), T.StructField("set_a", T.LongType()), T.StructField("set_b", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("bitmap", T.ArrayType(T.LongType()))])
    signed = materialize(docs.mapInArrow(_signed, schema))
    same = ["n_shingles", "set_a", "set_b"]
    sets = materialize(signed.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy(*same).agg(F.min("doc_id").alias("id"), F.any_value("bands").alias("bands"), F.count("*").alias("copies")))
    rows = sets.select(F.explode("bands").alias("key"), "id", F.col("n_shingles").alias("n"))
    shared = rows.groupBy("key").agg(F.count("*").alias("size")).where("size > 1").select("key")
    rows = materialize(rows.join(materialize(shared), "key"))
    docs = docs.where("doc_id IS NOT NULL")
    links = _confirm(_stars(rows.withColumn("part", F.col("id")), F.col("id")), docs)
    labels = connected_components(links)
    mixed = _mixed(rows, labels, 3)
    if mixed.limit(1).count():
        links = links.union(_confirm(_second_stars(mixed), docs))
        labels = connected_components(links)
        mixed = _mixed(mixed.drop("part", "size"), labels, 4)
        if mixed.limit(1).count():
            links = links.union(_confirm(_across(mixed, signed), docs))
            labels = connected_components(links)
    named = sets.select(*same, "id", "copies").join(labels.withColumnRenamed("node", "id"), "id", "left")
    groups = materialize(named.where("copies > 1 OR label <> id").select(*same, F.coalesce("label", "id").alias("part")))
    out = signed.select("doc_id", *same).join(groups, same, "left")
    part = F.when(F.col("doc_id").isNotNull(), F.coalesce("part", "doc_id"))
    return out.select("doc_id", "n_shingles", part.alias("component_id"), F.coalesce(F.col("doc_id") == part, F.lit(True)).alias("kept"))
