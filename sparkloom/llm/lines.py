"""Substring dedup by hashed units: lines, paragraphs and runs of clauses are normalised, digests grouped globally, the earliest stays.

A text's words (runs without the blanks ``\\x20 \\x09-\\x0D``) form clauses: a clause ends after a word that ends with one
of ``. ! ? , ; :``, and at the end of a line or text.  Lines without a blank line between them form a paragraph.  Three
kinds of units are hashed:

* LEAST_WORDS words from the beginning of each clause; they may cross clauses and line breaks, so a passage is found
  inside longer lines, over several lines and however it is wrapped;
* each line of LEAST_WORDS words or LEAST_CHARS code points (blanks between its words included), so that an equal line
  goes whole;
* each paragraph of as many words or code points, so that an equal paragraph of short lines goes whole.

A unit is normalised by lower-casing A-Z and by taking each run of blanks as one space.  Of all units with one digest
(96 bits over the words) the one with the least place (doc_id, code point where it begins) stays.  The others go: what is
removed of a text is the union of their spans, each up to the next word, with the places in the original text kept.  What
is left of a longer passage is at most the clause that its beginning cuts, and at its end less than one clause.  Shorter
repeats stay, as do repeats inside a longer line without blanks: a short line that is equal in many documents is as a rule
a greeting, a heading or a common phrase, and taking it out would spoil the clean text around it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textcore import Block, blocks, materialize, mix, pick, powers, release

LEAST_WORDS = 25
LEAST_CHARS = 250
BLOCK_BYTES = 400_000  #: bytes of text that one numpy pass works on
ENDS = np.zeros(256, bool)
ENDS[list(b".!?,;:")] = True


def units(block: Block, words: int = LEAST_WORDS, chars: int = LEAST_CHARS) -> tuple[np.ndarray, ...]:
    """Text, first and end code point in it, and two hashes of each unit of a block of texts."""
    starts, ends, ptr = block.words()
    n = len(starts)
    if not n:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    text = np.repeat(np.arange(len(block)), np.diff(ptr))
    breaks = np.concatenate([[0], np.cumsum(block.data == 10)])
    points = block.code_points()
    line_ends = np.zeros(n, bool)
    line_ends[ptr[1:][np.diff(ptr) > 0] - 1] = True
    paragraph_ends = line_ends.copy()
    newlines = breaks[starts[1:]] - breaks[ends[:-1]]
    line_ends[:-1] |= newlines > 0
    paragraph_ends[:-1] |= newlines > 1
    begin, finish = points[starts], points[ends]

    first = np.concatenate([[0], np.flatnonzero(ENDS[block.data[ends - 1]] | line_ends)[:-1] + 1])
    first = first[first + words <= ptr[text[first] + 1]]
    end = first + words - 1

    pairs = [first * n + end]
    for whole in (line_ends, paragraph_ends):
        b = np.flatnonzero(whole)
        a = np.concatenate([[0], b[:-1] + 1])
        much = (b - a + 1 >= words) | (finish[b] - begin[a] >= chars)
        pairs.append(a[much] * n + b[much])
    pairs = np.unique(np.concatenate(pairs))
    first, end = pairs // n, pairs % n

    h = block.hashes(starts, ends, True)
    power, inverse = powers(n + 1)
    digests = []
    for salt in (0x1D8AF066F5C6A1B3, 0x7A3C96D1E24B58F7):
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(mix(h ^ np.uint64(salt)) * power[:n], out=sums[1:])
        digests.append(mix((sums[end + 1] - sums[first]) * inverse[first] + (end - first).astype(np.uint64)))
    zero, size = points[block.bounds[:-1]], points[block.bounds[1:]]
    after = np.where(end + 1 < ptr[text[end] + 1], begin[np.minimum(end + 1, n - 1)], size[text[end]])
    return text[first], begin[first] - zero[text[first]], after - zero[text[first]], *digests


def union(spans: pa.ListArray) -> pa.ListArray:
    """The union of each list of spans, ascending; those that touch become one. One sort, however many there are."""
    flat, far = spans.flatten(), 1 << 32  # places of different lists are this far apart
    row = np.repeat(np.arange(len(spans)), pc.list_value_length(spans).to_numpy(zero_copy_only=False).astype(np.int64))
    start, end = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) + row * far for k in (0, 1))
    order = np.lexsort((end, start))
    row, start, reach = row[order], start[order], np.maximum.accumulate(end[order])
    first = np.flatnonzero(np.concatenate([[True], start[1:] > reach[:-1]])[: len(start)])
    last = np.concatenate([first[1:], [len(start)]])[: len(first)] - 1
    both = [pa.array((x - row[first] * far).astype(np.int32)) for x in (start[first], reach[last])]
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row[first], np.arange(len(spans) + 1)).astype(np.int32)), pa.StructArray.from_arrays(both, ["start", "end"]))


def without(text: str, spans: list[dict]) -> str:
    """text without ascending spans that do not overlap."""
    starts, ends = [s["start"] for s in spans], [s["end"] for s in spans]
    return "".join(text[a:b] for a, b in zip([0, *ends], [*starts, len(text)], strict=True))


def _rows(docs: DataFrame) -> DataFrame:
    return pick(docs, "doc_id", "text").withColumn("h", F.xxhash64("text"))


def repeated_units(docs: DataFrame, words: int = LEAST_WORDS, chars: int = LEAST_CHARS) -> DataFrame:
    """One row per unit that an earlier place already has: doc_id, h (of the text), start, end, first_doc_id, first_start.

    Places without doc_id come last. Rows that repeat both doc_id and text are one place and give equal rows; of texts
    that share a doc_id, the one with the lesser hash is earlier. Null and empty texts have no units.
    """
    return _repeats(docs, words, chars)[0]


def _repeats(docs: DataFrame, words: int, chars: int) -> tuple[DataFrame, list[DataFrame]]:
    """repeated_units, and the tables that it reads."""
    source = _rows(docs).where("text IS NOT NULL")
    kind = source.schema["doc_id"].dataType.simpleString()

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, block in blocks(batches, "text", BLOCK_BYTES):
            text, start, end, d1, d2 = units(block, words, chars)
            owner = pa.array(text)
            columns = [part.column("doc_id").take(owner), part.column("h").take(owner), *[pa.array(x.astype(np.int32)) for x in (start, end)], pa.array(d1.view(np.int64)), pa.array((d2 >> np.uint64(32)).astype(np.uint32).view(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "h", "start", "end", "d1", "d2"])

    def first_halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, block in blocks(batches, "text", BLOCK_BYTES):
            yield pa.RecordBatch.from_arrays([pa.array(units(block, words, chars)[3].view(np.int64))], ["d1"])

    # read twice rather than written down: the same text gives the same units
    found = source.mapInArrow(digested, f"doc_id {kind}, h long, start int, end int, d1 long, d2 int")
    # the places of units that occur once, most of all, move only once and never into the search for the first place
    # half a digest does to find them, since whole digests decide what is equal
    several = materialize(source.select("text").mapInArrow(first_halves, "d1 long").groupBy("d1").agg(F.count("*").alias("n")).where("n > 1").select("d1"), tidy=True)
    shared = materialize(found.join(several, "d1"), tidy=True)
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h", "start")
    # written down, so that the join below is of plain shuffles, whose hot keys are split
    firsts = materialize(shared.groupBy("d1", "d2").agg(F.min(place).alias("first")), tidy=True)
    later = shared.join(firsts, ["d1", "d2"]).where(place != F.col("first"))
    return later.select("doc_id", "h", "start", "end", F.col("first.doc_id").alias("first_doc_id"), F.col("first.start").alias("first_start")), [several, shared, firsts]


def dedup_lines(docs: DataFrame, words: int = LEAST_WORDS, chars: int = LEAST_CHARS) -> DataFrame:
    """doc_id, text without repeated units, and removed (merged spans of the original text, in code points) for every row of docs.

    A null text stays null, with nothing removed. Of equal texts under different doc_ids the earliest stays whole, the
    others keep only what is in no unit. Everything else is kept byte by byte.
    """
    rows, kind = _rows(docs), "array<struct<start:int,end:int>>"
    repeats, tables = _repeats(docs, words, chars)
    found = repeats.groupBy("doc_id", "h").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    found = found.select(F.col("doc_id").alias("d"), F.col("h").alias("k"), "spans")

    def unions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("d"), batch.column("k"), union(batch.column("spans"))], ["d", "k", "spans"])

    spans = materialize(found.mapInArrow(unions, f"d {found.schema['d'].dataType.simpleString()}, k long, spans {kind}"), tidy=True)
    release(*tables)
    # a merge at all sizes: a broadcast where spans are few only makes disk and memory jump where they are not
    joined = rows.join(spans.hint("merge"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("k")), "left")
    joined = joined.select("doc_id", "text", F.coalesce("spans", F.lit([]).cast(kind)).alias("removed"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _ in blocks(batches, "text"):
            given = zip(part.column("text").to_pylist(), part.column("removed").to_pylist(), strict=True)
            texts = [without(t, gone) if gone else t for t, gone in given]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(texts, pa.string()), part.column("removed")], ["doc_id", "text", "removed"])

    return joined.mapInArrow(cut, f"doc_id {joined.schema['doc_id'].dataType.simpleString()}, text string, removed {kind}")
