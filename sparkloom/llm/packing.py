"""Best-fit packing of documents into sequences of several permitted lengths, chosen jointly.

Lengths count UTF-8 bytes (a byte-level vocabulary) plus one end mark per document.  A document longer than the largest
capacity gives full pieces and a rest.  Pieces go, longest first, into the open bin that they fill best.  If none can
hold a piece, a bin of some size opens.  The cost of a sequence grows faster than its length, since every position
attends to the others, so short sequences are cheaper to fill and long ones easier: for each size that holds the piece,
the lengths still to place are put into the room that would be left, largest first, and the size with the least cost per
filled unit opens, each counted at the cheapest size that would hold its filling.  In the end every bin shrinks to the
cheapest size that holds its contents.

Rows are dealt into shards of about SHARD pieces, which pack on their own: a shard is large enough that its few open bins
at the end cost next to nothing, and the number of shards follows the input.  The deal goes by a hash of doc_id, text and the
number of the copy among equal rows, so it depends on the table's rows alone, not on how they are partitioned, and rows
that repeat, or that lack a doc_id, spread like all others.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textcore import materialize, pick

ATTENTION = 16_384  #: length at which attention costs as much as everything else of a sequence
STEP = 256  #: the fixed share of a step, in positions
#: Permitted lengths and the cost of one sequence of that length.
SIZES = {n: n + n * n / ATTENTION + STEP for n in (2048, 4096, 8192)}
END_MARK = 1
SHARD = 20_000
COPIES = 10_000  #: equal rows that are numbered together


def cheapest(length: int, sizes: Mapping[int, float]) -> int:
    """The size of least cost that holds length; of equal costs the smallest."""
    return min((s for s in sizes if s >= length), key=lambda s: (sizes[s], s))


def filling(room: int, present: int, counts: Mapping[int, int]) -> int:
    """How much of room the lengths that are left fill, largest first. present has bit n set if counts[n] > 0."""
    used = 0
    while below := present & ((2 << room - used) - 1):
        n = below.bit_length() - 1
        used += n * min(counts[n], (room - used) // n)
        present = below & ~(1 << n)
    return used


def opening(length: int, present: int, counts: Mapping[int, int], sizes: Mapping[int, float]) -> int:
    """The size to open for a piece: least cost per filled unit; of equal ones the smallest."""

    def rate(size: int) -> float:
        full = length + filling(size - length, present, counts)
        return sizes[cheapest(full, sizes)] / full

    return min((s for s in sizes if s >= length), key=lambda s: (rate(s), s))


def best_fit(lengths: list[int], sizes: Mapping[int, float]) -> tuple[list[int], list[int], list[int]]:
    """For lengths in descending order: the bin and the offset of each, and the final size of each bin.

    Of bins with equal room, the one that was filled last is taken.
    """
    room: dict[int, list[int]] = {}
    filled = 0  # bit r is set if some bin has room r
    used: list[int] = []
    bins, offsets = [], []
    counts = Counter(lengths)
    present = sum(1 << n for n in counts)
    for n in lengths:
        counts[n] -= 1
        if not counts[n]:
            present &= ~(1 << n)
        above = filled >> n
        if above:
            r = n + (above & -above).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                filled &= ~(1 << r)
        else:
            b, r = len(used), opening(n, present, counts, sizes)
            used.append(0)
        bins.append(b)
        offsets.append(used[b])
        used[b] += n
        if r > n:
            room.setdefault(r - n, []).append(b)
            filled |= 1 << (r - n)
    return bins, offsets, [cheapest(u, sizes) for u in used]


def pack(docs: DataFrame, sizes: Mapping[int, float] = SIZES, shard: int = SHARD) -> DataFrame:
    """One row per piece of each row of docs: where it lies in the document and in its bin.

    Columns: doc_id, piece (number in the document), start and length (in the document's bytes, the end mark counted with
    its last piece), shard and bin (together the bin's key), position (offset in the bin), capacity, used.
    A null text counts as empty: its one piece is the end mark. A null doc_id packs like any other; repeated rows all do.
    Of equal lengths, the lesser doc_id goes first. An empty table gives no rows.
    """
    largest = max(sizes)
    text = F.coalesce("text", F.lit(""))
    each = pick(docs, "doc_id", "text").select("doc_id", (F.octet_length(text) + END_MARK).cast("long").alias("total"), F.unhex(F.sha2(text, 256)).alias("digest"))
    # equal rows are numbered by their count, some thousands at a time, so that no group of them is one task's
    groups = each.groupBy("doc_id", "total", "digest").agg(F.count("*").alias("n"))
    parts = groups.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {COPIES}")))).repartition("doc_id", "digest", "part")
    copies = F.explode(F.sequence(F.col("part") * COPIES, F.least(F.col("n"), (F.col("part") + 1) * COPIES) - 1))
    rows = materialize(parts.withColumn("copy", copies).select("doc_id", "total", F.xxhash64("doc_id", "digest", "copy").alias("h")))
    kind = rows.schema["doc_id"].dataType.simpleString()
    pieces = rows.agg(F.sum(F.ceil(F.col("total") / largest))).first()[0] or 0
    shards = max(1, -(-int(pieces) // shard))
    cut = rows.select("doc_id", "total", F.pmod("h", F.lit(shards)).alias("shard"), F.explode(F.sequence(F.lit(0), (F.ceil(F.col("total") / largest) - 1).cast("int"))).alias("piece"))
    cut = cut.select("doc_id", "shard", "piece", (F.col("piece") * F.lit(largest).cast("long")).alias("start"), F.least(F.lit(largest).cast("long"), F.col("total") - F.col("piece") * F.lit(largest).cast("long")).alias("length"))
    costs = dict(sizes)

    def one_shard(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        bins, offsets, final = best_fit([int(n) for n in part["length"]], costs)
        part["bin"], part["position"] = bins, offsets
        part["capacity"] = [final[b] for b in bins]
        part["used"] = part.groupby("bin")["length"].transform("sum")
        return part[["doc_id", "piece", "start", "length", "shard", "bin", "position", "capacity", "used"]]

    return cut.repartition(min(shards, 4096), "shard").groupBy("shard").applyInPandas(one_shard, f"doc_id {kind}, piece int, start long, length long, shard long, bin int, position long, capacity int, used long")
