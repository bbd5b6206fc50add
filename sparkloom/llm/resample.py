"""Importance resampling towards a target distribution, over a dictionary of all distinct n-grams.

Words are runs of ASCII letters and digits and of non-ASCII characters, with A-Z in lower case; features are all runs of one
to ORDERS consecutive words.  Four steps:

1. Texts become blocks of up to WORDS words, each with a sorted vocabulary of its own and word numbers; a longer text is cut
   into pieces that overlap by ORDERS - 1 words, so that each feature lies in exactly one piece.
2. Each block counts its distinct features and sends them, in sorted order, to the parts of one global dictionary.  Parts are
   ranges of that order, whose borders come from a sample (BORDER_STEP); they decide where a feature is counted and nothing
   else.  A part merges its features over all blocks, hashes each distinct string once, adds the counts to the string's
   bucket, and answers each block with the buckets of the features that it sent, in their order.
3. The bucket sums over all parts give the gains, one for each of BUCKETS buckets; that is the one table that all tasks get.
4. Each block joins the answers back to its documents' features and sums the gains.

A feature is sent as the words in which it differs from the one before it, so a block's share of a part is about one word a
feature.  A word or n-gram that stands in every text reaches a part once for each block, so no key is hot.  The number of
parts follows the number of words.  Ranks are found by a sort over all tasks with one offset a partition; no window holds all
rows.  Memory: about ten times the longest text in step 1, and below 500 MB in the other steps.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textcore import blocks, materialize, pick, release

BUCKETS = 10_000
ORDERS = 3
WORDS = 1 << 20  #: words of a block
DOCS = 20_000  #: texts of a block
PART_FEATURES = 2_000_000  #: features (with repeats) that a part of the dictionary gets, about
SEED = 42
LEAST_WORDS, PERCENT = 20, 5
LEVEL = 3
SLICE = 250_000  #: features that become strings at a time, about
BORDER_STEP = 20  #: features that are looked at for each border
VECTOR_CHARS = 64  #: features up to this length are hashed side by side

OUTSIDE = np.ones(256, bool)
OUTSIDE[48:58] = OUTSIDE[65:91] = OUTSIDE[97:123] = OUTSIDE[128:] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_SHIFT, _MASK = 21, (1 << 21) - 1

DOC = "struct<row:bigint,doc_id:{kind},words:bigint,size:int,own:int>"
BLOCK = "block long, side int, docs array<" + DOC + ">, vocabulary binary, words binary"
PART = "part int, block long, side int, tails binary, shared binary, counts binary"
ANSWER = "block long, part int, buckets binary, bucket int, s long, t long"


def _crc_table() -> np.ndarray:
    """The table of the reflected polynomial 0xEDB88320, by its rule."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


_CRC = _crc_table()


def crc32_each(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The crc32 of each span of data, as uint32."""
    lengths = ends - starts
    order = np.argsort(-np.minimum(lengths, VECTOR_CHARS + 1), kind="stable")
    at, left = starts[order], lengths[order]
    state = np.full(len(at), 0xFFFFFFFF, np.uint32)
    long = int(np.count_nonzero(left > VECTOR_CHARS))
    state[:long] = [zlib.crc32(data[a : a + n].tobytes()) ^ 0xFFFFFFFF for a, n in zip(at[:long], left[:long], strict=True)]
    counts = np.bincount(left[long:], minlength=VECTOR_CHARS + 1)
    live = len(at) - np.cumsum(counts)  # spans that are longer than k
    for k in range(VECTOR_CHARS):
        if live[k] <= long:
            break
        some = state[long : live[k]]
        state[long : live[k]] = _CRC[(some ^ data[at[long : live[k]] + k]) & 255] ^ (some >> np.uint32(8))
    out = np.empty(len(at), np.uint32)
    out[order] = state ^ np.uint32(0xFFFFFFFF)
    return out


def pack(data: bytes | memoryview) -> bytes:
    return zstandard.compress(bytes(data), LEVEL)


def unpack(data: bytes) -> bytes:
    return zstandard.decompress(data)


# Blocks


def _cut(n: int) -> Iterator[tuple[int, int, int]]:
    """Pieces of a text of n words: first word, end, and how many of its words begin features."""
    step = WORDS - ORDERS + 1
    for a in range(0, max(n, 1), step):
        b = min(n, a + WORDS)
        yield a, b, min(step, n - a) if b < n else b - a
        if b == n:
            return


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, object, int, int, np.ndarray, np.ndarray]]:
    """Row number, doc_id, words of the whole text (0 but for its first piece), words that begin features, the piece's bytes in
    lower case and without what separates words, and the words' lengths."""
    row = TaskContext.get().partitionId() << 33
    for part, block in blocks(batches, "text"):
        ids = part.column("doc_id").to_pylist()
        starts, ends, ptr = block.words(OUTSIDE)
        lengths = ends - starts
        kept = LOWER[block.data[~OUTSIDE[block.data]]]
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        for i, doc_id in enumerate(ids):
            n = int(ptr[i + 1] - ptr[i])
            for a, b, own in _cut(n):
                lo, hi = ptr[i] + a, ptr[i] + b
                yield row, doc_id, n if not a else 0, own, kept[offsets[lo] : offsets[hi]], lengths[lo:hi]
            row += 1


def _blocked(texts: DataFrame, side: int) -> DataFrame:
    """Blocks of texts (doc_id, text)."""
    kind = texts.schema["doc_id"].dataType.simpleString()
    schema = BLOCK.format(kind=kind)
    doc_type = pa.struct([("row", pa.int64()), ("doc_id", pa.int64()), ("words", pa.int64()), ("size", pa.int32()), ("own", pa.int32())])

    def block(number: int, held: list) -> pa.RecordBatch:
        data = np.concatenate([h[4] for h in held])
        offsets = np.concatenate([[0], np.cumsum(np.concatenate([h[5] for h in held]))]).astype(np.int64)
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        order = pc.sort_indices(words.dictionary).to_numpy()
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        numbers = rank[words.indices.to_numpy()] if len(words) else np.zeros(0, np.int32)
        docs = [{"row": r, "doc_id": d, "words": n, "size": len(lengths), "own": own} for r, d, n, own, _, lengths in held]
        columns = [pa.array([number], pa.int64()), pa.array([side], pa.int32()), pa.array([docs], pa.list_(doc_type)), pa.array([pack(b"\n".join(words.dictionary.take(pa.array(order)).to_pylist()))], pa.binary()), pa.array([pack(numbers.tobytes())], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["block", "side", "docs", "vocabulary", "words"])

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held, n = [], 0
        for piece in _pieces(batches):
            if held and (n + len(piece[5]) > WORDS or len(held) >= DOCS):
                yield block(number, held)
                held, n, number = [], 0, number + 1
            held.append(piece)
            n += len(piece[5])
        if held:
            yield block(number, held)

    return texts.mapInArrow(gathered, schema)


def word_numbers(keys: np.ndarray) -> list[np.ndarray]:
    """The word numbers of keys, -1 where they have fewer words."""
    return [keys >> (2 * _SHIFT), ((keys >> _SHIFT) & _MASK) - 1, (keys & _MASK) - 1]


class Features:
    """The distinct features of a block in the order of their strings: keys (three word numbers each), counts, and for each
    occurrence its key and its piece. What separates words in a string is less than all that words have, so the order of the
    word numbers is that of the strings."""

    def __init__(self, docs: list, words: bytes, places: bool):
        sizes, own = (np.array([d[k] for d in docs], np.int64) for k in ("size", "own"))
        w = np.frombuffer(unpack(words), np.int32).astype(np.int64)
        piece = np.repeat(np.arange(len(sizes)), sizes)
        at = np.arange(len(w)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        begins, left = at < own[piece], sizes[piece] - at
        keys, owners = [], []
        for order in range(1, ORDERS + 1):
            p = np.flatnonzero(begins & (left >= order))
            key = w[p] << (2 * _SHIFT)
            for k in range(1, order):
                key |= (w[p + k] + 1) << ((ORDERS - 1 - k) * _SHIFT)
            keys.append(key)
            if places:
                owners.append(piece[p])
        keys = np.concatenate(keys)
        if places:
            self.owners = np.concatenate(owners)
            self.keys, self.which = np.unique(keys, return_inverse=True)
        else:
            keys.sort()
            first = np.flatnonzero(np.diff(keys, prepend=-1))
            self.keys, self.counts = keys[first], np.diff(np.append(first, len(keys)))

    def begins(self, vocabulary: pa.Array, borders: list[bytes]) -> np.ndarray:
        """Where each part begins among the keys, and the end. borders: the first string of each part but the first, sorted."""

        def string(i: int) -> bytes:
            return b" ".join(vocabulary[int(n)].as_py() for n in word_numbers(keys[i]) if n >= 0)

        keys, out = self.keys, [0]
        for b in borders:
            out.append(bisect.bisect_left(range(len(keys)), b, out[-1], key=string))
        return np.array([*out, len(keys)])


def _strings(data: np.ndarray) -> pa.Array:
    """The strings that data joins, each ended by a line end."""
    ends = np.flatnonzero(data == 10)
    offsets = np.concatenate([[0], ends - np.arange(len(ends))]).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(data[data != 10])])


def _vocabulary(packed: bytes) -> pa.Array:
    """The words of a block, which it joins by line ends; a block without words has none."""
    joined = unpack(packed)
    return _strings(np.frombuffer(joined + b"\n", np.uint8)) if joined else pa.array([], pa.large_binary())


def _joined(words: pa.Array, numbers: list[np.ndarray]) -> pa.Array:
    """The words with the numbers, joined by spaces; a number of -1 is no word."""
    return pc.binary_join_element_wise(*[words.take(pa.array(x, mask=x < 0)) for x in numbers], pa.scalar(b" ", pa.large_binary()), null_handling="skip")


def _borders(table: DataFrame, n: int, words: int) -> list[bytes]:
    """n - 1 strings that cut the order of all features into n parts of about the same number of features: from the sequences of
    ORDERS words at evenly spaced places, BORDER_STEP to a border."""
    if n < 2:
        return []
    step = max(1, words // (n * BORDER_STEP))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                known, w = _vocabulary(batch.column("vocabulary")[i].as_py()), np.frombuffer(unpack(batch.column("words")[i].as_py()), np.int32)
                at = np.arange(step // 2, max(0, len(w) - ORDERS + 1), step)
                found = _joined(known, [w[at + k] for k in range(ORDERS)]) if len(at) else pa.array([], pa.large_binary())
                yield pa.RecordBatch.from_arrays([found.cast(pa.binary())], ["feature"])

    seen = materialize(table.select("vocabulary", "words").mapInArrow(look, "feature binary"), tidy=True)
    ordered = seen.orderBy("feature").withColumn("at", F.monotonically_increasing_id())
    some = ordered.where(F.col("at").bitwiseAND((1 << 33) - 1) % BORDER_STEP == BORDER_STEP // 2).collect()  # about n rows
    return sorted({bytes(r.feature) for r in some})


def _sent(table: DataFrame, borders: list[bytes]) -> DataFrame:
    """Each block's distinct features with their counts, for each part of the dictionary. shared: how many of the first words a
    feature has from the one before; tails: its other words, with spaces between and a line end."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block, side, docs, vocabulary, words = (batch.column(c)[i].as_py() for c in ("block", "side", "docs", "vocabulary", "words"))
                found, known = Features(docs, words, False), _vocabulary(vocabulary)
                if not len(found.keys):
                    continue
                begins, keys, counts = found.begins(known, borders), found.keys, found.counts.astype(np.int32)
                parts = np.flatnonzero(np.diff(begins))
                # some parts at a time, since strings take more than keys
                for group in np.split(parts, np.flatnonzero(np.diff(begins[parts] // SLICE)) + 1):
                    low, high = begins[group[0]], begins[group[-1] + 1]
                    numbers = word_numbers(keys[low:high])
                    same = [np.diff(x, prepend=-2) == 0 for x in numbers[:-1]]
                    shared = np.zeros(high - low, np.uint8)
                    for k in range(1, ORDERS):
                        shared += np.logical_and.reduce([*same[:k], numbers[k] >= 0])
                    shared[begins[group] - low] = 0
                    tails = _joined(known, [np.where(shared > k, -1, x) for k, x in enumerate(numbers)])
                    tails = pc.binary_join_element_wise(tails, pa.scalar(b"", pa.large_binary()), pa.scalar(b"\n", pa.large_binary()))
                    ends, data = np.frombuffer(tails.buffers()[1], np.int64), memoryview(tails.buffers()[2])
                    cuts = [(int(begins[p] - low), int(begins[p + 1] - low)) for p in group]
                    columns = [group, [block] * len(group), [side] * len(group), [pack(data[ends[a] : ends[b]]) for a, b in cuts], [pack(shared[a:b].tobytes()) for a, b in cuts], [pack(counts[low + a : low + b].tobytes()) for a, b in cuts]]
                    types = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [c.split()[0] for c in PART.split(", ")])
                del found, keys, counts
                pa.default_memory_pool().release_unused()

    return table.select("block", "side", F.transform("docs", lambda d: F.struct(d["size"].alias("size"), d["own"].alias("own"))).alias("docs"), "vocabulary", "words").mapInArrow(send, PART)


def _whole(tails: np.ndarray, shared: np.ndarray) -> tuple[pa.Array, list[np.ndarray]]:
    """The words of features and, for each feature, the numbers of its words (-1 where it has fewer)."""
    spaces = np.flatnonzero((tails == 10) | (tails == 32))
    line = tails[spaces] == 10
    words = _strings(np.where(tails == 32, np.uint8(10), tails)).dictionary_encode()
    number = words.indices.to_numpy()
    ends = np.flatnonzero(line) + 1
    begin = np.concatenate([[0], ends[:-1]]).astype(np.int32)
    n_tail = (ends - begin).astype(np.int32)
    numbers = []
    for k in range(ORDERS):
        given = (shared <= k) & (shared + n_tail > k)
        at = np.where(given, begin + k - shared, -1)
        own = np.where(given, number[at], -1)
        # a word that the tail leaves out is that of the last feature that gives it
        source = np.maximum.accumulate(np.where(given, np.arange(len(shared), dtype=np.int32), 0))
        numbers.append(np.where(shared > k, own[source], own))
    return words.dictionary, numbers


def _answered(sent: DataFrame) -> DataFrame:
    """The dictionary, part by part: each distinct string is hashed once. Rows of two kinds: the buckets of what a block sent, in
    its order, and (block null) the counts of a bucket, s in texts of side 0 and t in those of side 1."""
    names, types = [c.split()[0] for c in ANSWER.split(", ")], [pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.int64(), pa.int64()]

    def merged(rows: list[tuple], sums: np.ndarray) -> Iterator[pa.RecordBatch]:
        words, numbers = _whole(np.frombuffer(b"".join(unpack(r[3]) for r in rows), np.uint8), np.frombuffer(b"".join(unpack(r[4]) for r in rows), np.uint8).astype(np.int32))
        base = len(words) + 1
        pair = numbers[0].astype(np.int64) * base + numbers[1] + 1
        if base >= 1 << _SHIFT:  # three numbers do not fit into one
            pair = np.unique(pair, return_inverse=True)[1]
        _, first, which = np.unique(pair * base + numbers[2] + 1, return_index=True, return_inverse=True)
        strings = _joined(words, [x[first] for x in numbers])
        at = np.frombuffer(strings.buffers()[1], np.int64)[: len(strings) + 1]
        bucket = (crc32_each(np.frombuffer(strings.buffers()[2], np.uint8), at[:-1], at[1:]) % BUCKETS).astype(np.uint16)
        mine = bucket[which]
        del numbers, pair, first, which, strings
        done, out = 0, []
        for part, block, side, _, _, counts in rows:
            n = np.frombuffer(unpack(counts), np.int32)
            own = mine[done : done + len(n)]
            sums[side] += np.bincount(own, n, BUCKETS).astype(np.int64)
            done += len(n)
            if not side:
                out.append((block, part, own.tobytes(), None, None, None))
        for k in range(0, len(out), 64):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[k : k + 64], strict=True), types, strict=True)], names)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, held = np.zeros((2, BUCKETS), np.int64), []
        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in ("part", "block", "side", "tails", "shared", "counts")], strict=True):
                if held and held[0][0] != row[0]:
                    yield from merged(held, sums)
                    held = []
                    pa.default_memory_pool().release_unused()
                held.append(row)
        if held:
            yield from merged(held, sums)
        some = np.flatnonzero(sums.any(axis=0))
        if len(some):
            null = lambda t: pa.nulls(len(some), t)
            yield pa.RecordBatch.from_arrays([null(pa.int64()), null(pa.int32()), null(pa.binary()), pa.array(some, pa.int32()), pa.array(sums[0][some]), pa.array(sums[1][some])], names)

    return sent.repartition("part").sortWithinPartitions("part").mapInArrow(answer, ANSWER)


def gains(sums: DataFrame) -> np.ndarray:
    """The gain of each bucket, from its counts (bucket, s, t): floor(1000 ln((t + 1)(S + BUCKETS) / ((s + 1)(T + BUCKETS))))."""
    total = sums.agg(F.coalesce(F.sum("s"), F.lit(0)), F.coalesce(F.sum("t"), F.lit(0))).first()
    up, down = F.lit(float(total[0] + BUCKETS)), F.lit(float(total[1] + BUCKETS))
    gain = F.floor(1000 * F.log((F.col("t") + 1).cast("double") * up / ((F.col("s") + 1).cast("double") * down)))
    out = np.zeros(BUCKETS, np.int64)
    for r in sums.select("bucket", gain.alias("gain")).collect():  # BUCKETS rows at most
        out[r.bucket] = r.gain
    return out


def weights(docs: DataFrame, target: DataFrame) -> DataFrame:
    """row (a number of its own for each row of docs), doc_id, n_words, weight: the sum of the gains of its features, repeats counted.

    docs: doc_id (a number), text. target: text. Null texts have no words; a text without words has weight 0. Written down.
    """
    texts = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    wanted = pick(target, "text").select(F.lit(None).cast("long").alias("doc_id"), "text")
    table = materialize(_blocked(texts, 0).union(_blocked(wanted, 1)), tidy=True)
    words = table.agg(F.sum(F.expr("aggregate(docs, 0L, (n, d) -> n + d.size)"))).first()[0] or 0
    borders = _borders(table, max(1, -(-ORDERS * words // PART_FEATURES)), words)
    answers = materialize(_answered(_sent(table, borders)), tidy=True)
    gain = gains(materialize(answers.where("block IS NULL").groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")), tidy=True))

    def priced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            packed = [pack(gain[np.frombuffer(x, np.uint16)].astype(np.int32).tobytes()) for x in b.column("buckets").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("block"), b.column("part"), pa.array(packed, pa.binary())], ["block", "part", "gains"])

    def weigh(block: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
        docs_ = block["docs"][0]
        found = Features(docs_, block["words"][0], True)
        each = np.frombuffer(b"".join(map(unpack, given.sort_values("part")["gains"])), np.int32)
        weight = np.bincount(found.owners, each[found.which], len(docs_)).astype(np.int64)
        return pd.DataFrame({"row": [d["row"] for d in docs_], "doc_id": pd.array([d["doc_id"] for d in docs_], "Int64"), "n_words": [d["words"] for d in docs_], "weight": weight})

    own = table.where("side = 0").select("block", "docs", "words").groupBy("block")
    given = answers.where("block IS NOT NULL").select("block", "part", "buckets").mapInArrow(priced, "block long, part int, gains binary").groupBy("block")
    pieces = own.cogroup(given).applyInPandas(weigh, "row long, doc_id long, n_words long, weight long")
    out = materialize(pieces.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.sum("n_words").alias("n_words"), F.sum("weight").alias("weight")), tidy=True)
    release(table, answers)
    return out


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank (all long) of every row of docs; rank is null but for the percent of the rows with
    least words or more that have the highest scores, of equal ones those of the smaller doc_id.

    score adds Gumbel noise, from a hash of seed and doc_id, to weight. Null doc_ids hash as empty and come last among equal
    scores; rows that repeat are all ranked. Empty docs give no rows; without a target all its counts are 0.
    """
    found = weights(docs, target)
    noise = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    score = F.col("weight") + F.floor(-1000 * F.log(-F.log((noise + 0.5) / 4294967296.0)))
    n = F.col("n_words")
    features = sum((F.greatest(n - k, F.lit(0).cast("long")) for k in range(1, ORDERS)), n)
    scored = found.select("row", "doc_id", features.cast("long").alias("n_features"), "weight", score.cast("long").alias("score"), (n >= least).alias("open"))
    # one sort over all tasks; a row's number gives its partition and its place there
    placed = materialize(scored.orderBy(F.desc("open"), F.desc("score"), F.asc_nulls_last("doc_id"), "row").withColumn("at", F.monotonically_increasing_id()))
    counts = placed.groupBy(F.shiftright("at", 33).alias("part")).agg(F.count("*").alias("n"), F.count(F.when(F.col("open"), 1)).alias("open")).orderBy("part").collect()  # one row a partition
    before = np.concatenate([[0], np.cumsum([c.n for c in counts])])
    drawn = percent * sum(c.open for c in counts) // 100
    offsets = F.broadcast(docs.sparkSession.createDataFrame([(c.part, int(b)) for c, b in zip(counts, before, strict=False)], "part long, before long"))  # as many rows as counts
    rank = F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1) + 1
    return placed.withColumn("part", F.shiftright("at", 33)).join(offsets, "part").select("doc_id", "n_features", "weight", "score", F.when(F.col("open") & (rank <= drawn), rank).alias("rank"))
