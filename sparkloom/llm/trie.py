"""The trie of all prefixes of conversations, by most-significant-digit radix partitioning over dictionary-encoded turns.

Every distinct (role, text) gets a number whose order is that of (role, text); a conversation becomes a sequence of such
numbers behind a number for the root.  Equal sequences are merged first, with their count, so copies weigh nothing below.
Then rounds of radix partitioning: of each bucket with more than LOCAL sequences (or LOCAL_TURNS turns) the turns that all
its sequences share are skipped at once and become nodes, and the next turn deals the bucket into smaller ones.  Buckets
within the limits leave the rounds, and multikey quicksort finishes them, many to a task; its recursion emits the nodes.
A node is named by its least member and its depth.  A bucket carries the names of the nodes above it, so that leaves and
saved bytes of all buckets are added up there in one grouping.

Rounds end, since each splits every bucket that is left.  A conversation is one row with 16 bytes a turn; nothing else is
gathered whole: the joins with a bucket's few facts are plain joins, which adaptive execution splits, and the members that
end at one node are joined in pieces of a sorted order and hashed as a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textcore import materialize, pick, release

LOCAL = 4096  #: sequences that one multikey quicksort takes
LOCAL_TURNS = 1_000_000  #: turns that it takes; also what a task holds at a time, about
PIECE = 4096  #: numbers that are joined to one text before they are hashed
SLICE = 500  #: sequences that become Python numbers at a time
ROOT = -1  #: the root's number in every sequence
NO_MEMBERS = hashlib.sha256(b"").hexdigest()

TURNS = "array<struct<id:bigint,bytes:bigint>>"
PATH = "array<struct<low:bigint,top:int>>"
NODE = f"low long, top int, parent long, n_convs long, n_children long, n_leaves long, below long, ends string, tails array<long>, path {PATH}"


def encoded(conversations: DataFrame) -> DataFrame:
    """conv_id, turns (id, bytes of the text) of each conversation, in order of turn, null first; of equal turns in order of
    role and text, so that repeated rows are repeated turns. Null role or text counts as empty. Rows without conv_id belong to
    no conversation."""
    text = F.coalesce("text", F.lit(""))
    role = F.coalesce("role", F.lit(""))
    key = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = pick(conversations, "conv_id", "turn", "role", "text").where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"), key.alias("key"))
    # numbers follow the partitions of a sorted table, so their order is that of the rows
    distinct = rows.select("role", "text", "key").distinct().orderBy("role", "text")
    dictionary = materialize(distinct.select("key", F.octet_length("text").cast("long").alias("bytes"), F.monotonically_increasing_id().alias("id")))
    coded = rows.select("conv_id", "turn", "key").join(dictionary, "key").select("conv_id", "turn", "id", "bytes")
    listed = F.sort_array(F.collect_list(F.struct("turn", "id", "bytes")))
    return materialize(coded.groupBy("conv_id").agg(F.transform(listed, lambda t: F.struct(t["id"], t["bytes"])).alias("turns")))


def _endings(members: DataFrame) -> DataFrame:
    """key, ends: SHA-256 of the decimal conv_ids of each key, ascending and joined by commas.

    Members are sorted over all tasks by key and number, joined in pieces of at most PIECE, and the pieces of a key are then
    hashed one after the other: the one part that a key's members share, since a hash reads them in order."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, numbers = batch.column("key").to_pylist(), batch.column("conv_id").to_pylist()
            at, rows = 0, []
            while at < len(keys):
                end = at + 1
                while end < len(keys) and end - at < PIECE and keys[end] == keys[at]:
                    end += 1
                rows.append((keys[at], numbers[at], ",".join(map(str, numbers[at:end]))))
                at = end
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.binary(), pa.int64(), pa.string()), strict=True)], ["key", "first", "piece"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = state = None
        for batch in batches:
            done = []
            for k, piece in zip(batch.column("key").to_pylist(), batch.column("piece").to_pylist(), strict=True):
                if k == key:
                    state.update(b"," + piece.encode())
                    continue
                if state is not None:
                    done.append((key, state.hexdigest()))
                key, state = k, hashlib.sha256(piece.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.string())], ["key", "ends"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()], pa.string())], ["key", "ends"])

    joined = members.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(pieces, "key binary, first long, piece string")
    return joined.repartition("key").sortWithinPartitions("key", "first").mapInArrow(hashed, "key binary, ends string")


def _merged(convs: DataFrame) -> DataFrame:
    """conv (the least member), n, ends, ids, bytes of each distinct sequence, the root's number first. Written down."""
    turns = F.concat(F.array(F.struct(F.lit(ROOT).cast("long").alias("id"), F.lit(0).cast("long").alias("bytes"))), F.col("turns"))
    rows = convs.select("conv_id", F.transform(turns, lambda t: t["id"]).alias("ids"), F.transform(turns, lambda t: t["bytes"]).alias("bytes"))
    rows = materialize(rows.withColumn("key", F.unhex(F.sha2(F.array_join(F.transform("ids", lambda x: x.cast("string")), ","), 256))))
    groups = materialize(rows.groupBy("key").agg(F.count("*").alias("n"), F.min("conv_id").alias("conv")))
    shared = materialize(rows.select("key", "conv_id").join(groups.where("n > 1").select("key"), "key", "left_semi"))
    one = groups.join(rows.select(F.col("conv_id").alias("conv"), "ids", "bytes"), "conv").join(_endings(shared), "key", "left")
    alone = F.sha2(F.col("conv").cast("string").cast("binary"), 256)
    out = materialize(one.select("conv", "n", F.coalesce("ends", alone).alias("ends"), "ids", "bytes"))
    release(rows, groups, shared)
    return out


def branches(sequences: Sequence[Sequence[int]], top: int) -> list[tuple[int, int, int, list[int], int | None]]:
    """Multikey quicksort of distinct sequences that share the turns before top and the one at top.

    The nodes, each after its parent: parent (index, -1 for none), top and end of the run of turns that it stands for (turns
    that all its members share and nothing ends between), members, and the member that ends there, if any.
    """
    nodes: list[tuple[int, int, int, list[int], int | None]] = []
    todo = [(list(range(len(sequences))), top, -1)]
    while todo:
        rows, at, parent = todo.pop()
        pivot = sequences[rows[len(rows) // 2]][at]
        less, same, more = [], [], []
        for r in rows:
            digit = sequences[r][at]
            (same if digit == pivot else less if digit < pivot else more).append(r)
        todo += [(part, at, parent) for part in (more, less) if part]
        first, end, least = sequences[same[0]], at + 1, min(len(sequences[r]) for r in same)
        if len(same) == 1:
            end = least
        while end < least and all(sequences[r][end] == first[end] for r in same):
            end += 1
        over = next((r for r in same if len(sequences[r]) == end), None)
        nodes.append((parent, at, end, same, over))
        rest = [r for r in same if r != over]
        if rest:
            todo.append((rest, end, len(nodes) - 1))
    return nodes


def finished(low: int, top: int, parent: int | None, path: list, rows: list[tuple]) -> Iterator[tuple]:
    """The rows of NODE for one bucket. rows: conv, n, ends, ids, bytes. Only the bucket's own node carries the path."""
    nodes = branches([r[3] for r in rows], top)
    lows = [min(rows[m][0] for m in members) for _, _, _, members, _ in nodes]
    children, leaves, below = [0] * len(nodes), [0] * len(nodes), [0] * len(nodes)
    for i in range(len(nodes) - 1, -1, -1):
        up, at, end, members, over = nodes[i]
        n, sizes = sum(rows[m][1] for m in members), rows[members[0]][4][at:end]
        tails = list(sizes)
        for k in range(len(tails) - 2, -1, -1):
            tails[k] += tails[k + 1]
        leaves[i] = leaves[i] or 1
        if up >= 0:
            children[up] += 1
            leaves[up] += leaves[i]
            below[up] += below[i] + (n - 1) * tails[0]
        yield lows[i], at, lows[up] if up >= 0 else parent, n, children[i], leaves[i], below[i], NO_MEMBERS if over is None else rows[over][2], tails, path if up < 0 else None


def _sorted_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Buckets, whose rows follow each other, one after the other."""
    path_type = pa.list_(pa.struct([("low", pa.int64()), ("top", pa.int32())]))
    types = [pa.int64(), pa.int32(), *[pa.int64()] * 5, pa.string(), pa.list_(pa.int64()), path_type]
    names = [c.split()[0] for c in NODE.split(", ")]
    bucket, held, done = None, [], []

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    for batch in (b.slice(i, SLICE) for b in batches for i in range(0, b.num_rows, SLICE)):
        for row in zip(*[batch.column(c).to_pylist() for c in ("low", "top", "parent", "path", "conv", "n", "ends", "ids", "bytes")], strict=True):
            if bucket is not None and row[:2] != bucket[:2]:
                done += finished(*bucket, held)
                held = []
                if len(done) >= 2000:
                    yield table(done)
                    done = []
            bucket = row[:4]
            held.append(row[4:])
    if bucket is not None:
        done += finished(*bucket, held)
        yield table(done)


def _round(live: DataFrame, local: int, turns: int) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """One round over live (low, top, parent, path of the bucket; conv, n, ends, ids, bytes of its sequences): the rows of the
    buckets' own nodes, the rows of buckets that are small enough now, and those of the others (None if there are none)."""
    bucket = ["low", "top"]
    # the least member guides: with it, each sequence shares so many turns; what all share with it, all share
    guide = live.where("conv = low").select(*bucket, F.col("ids").alias("guide"), F.col("bytes").alias("sizes"))
    equal = F.zip_with("ids", "guide", lambda a, b: a.eqNullSafe(b))
    agree = F.coalesce(F.nullif(F.array_position(equal, False), F.lit(0).cast("long")) - 1, F.size("ids").cast("long"))
    shared = live.select(*bucket, "ids").join(guide.select(*bucket, "guide"), bucket).groupBy(*bucket).agg(F.min(agree).cast("int").alias("at"))
    shared = materialize(shared)
    dealt = live.join(shared, bucket).withColumn("digit", F.try_element_at("ids", F.col("at") + 1))
    kids = materialize(
        dealt.groupBy(*bucket, "digit").agg(F.min("conv").alias("kid"), F.count("*").alias("n_seqs"), F.sum(F.size("ids").cast("long")).alias("n_turns"), F.sum("n").alias("n_convs"), F.max(F.when(F.col("digit").isNull(), F.col("ends"))).alias("ends"))
    )
    own = kids.groupBy(*bucket).agg(F.sum("n_convs").alias("n_convs"), F.count("digit").alias("n_children"), F.coalesce(F.max("ends"), F.lit(NO_MEMBERS)).alias("ends"))
    facts = live.where("conv = low").select(*bucket, "parent", "path", F.col("bytes").alias("sizes")).join(shared, bucket).join(own, bucket)
    upper = materialize(facts.select(*bucket, "parent", "path", "n_convs", "n_children", "ends", F.slice("sizes", F.col("top") + 1, F.col("at") - F.col("top")).alias("sizes")))
    large = (F.col("n_seqs") > 1) & ((F.col("n_seqs") > local) | (F.col("n_turns") > turns))
    split = dealt.where("digit IS NOT NULL").join(kids.where("digit IS NOT NULL").select(*bucket, "digit", "kid", large.alias("large")), [*bucket, "digit"])
    path = F.concat("path", F.array(F.struct("low", "top")))
    split = materialize(split.select(F.col("kid").alias("low"), F.col("at").alias("top"), F.col("low").alias("parent"), path.alias("path"), "conv", "n", "ends", "ids", "bytes", "large"))
    more = not split.where("large").isEmpty()
    return upper, split.where("NOT large").drop("large"), split.where("large").drop("large") if more else None


def nodes(convs: DataFrame, local: int = LOCAL, turns: int = LOCAL_TURNS) -> DataFrame:
    """One row per node of the trie of convs (conv_id, unique and not null; turns as encoded gives them, in any number).

    conv_id (the least member), depth, parent_conv_id (null at the root), n_convs, n_children, n_leaves, saved_tokens (over the
    subtree, (n_convs - 1) times the bytes of a node's last text), ends_sha256 (of the members that end there). All numbers are
    long. Without conversations there is no root and no row.
    """
    seqs = _merged(convs)
    all_seqs, all_turns, low = seqs.agg(F.count("*"), F.sum(F.size("ids")), F.min("conv")).first()
    live = seqs.select(F.lit(low).cast("long").alias("low"), F.lit(0).alias("top"), F.lit(None).cast("long").alias("parent"), F.expr(f"CAST(array() AS {PATH})").alias("path"), "conv", "n", "ends", "ids", "bytes")
    uppers, small = [], []
    if all_seqs <= 1 or all_seqs <= local and all_turns <= turns:
        small, live = [live], None
    while live is not None:
        upper, done, live = _round(live, local, turns)
        uppers.append(upper)
        small.append(done)
    rows = small[0]
    for s in small[1:]:
        rows = rows.union(s)
    found = materialize(rows.repartition("low", "top").sortWithinPartitions("low", "top").mapInArrow(_sorted_out, NODE))
    lower = found.select("low", "top", "parent", "n_convs", "n_children", "n_leaves", "below", "ends", F.posexplode("tails").alias("at", "tail"), F.size("tails").alias("run"))
    out = _steps(lower)
    if uppers:
        above = uppers[0]
        for u in uppers[1:]:
            above = above.union(u)
        out = out.union(_steps(_summed(above, found)))
    return out


def _summed(above: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of the nodes that the rounds made, one per step of their runs, with what lies below them."""
    total = F.aggregate("sizes", F.lit(0).cast("long"), lambda s, x: s + x)
    saved = found.where("path IS NOT NULL").select("path", "n_leaves", ((F.col("n_convs") - 1) * F.element_at("tails", 1) + F.col("below")).alias("saved"))
    # a sequence that ends at a node adds no leaf there, since the node has children
    gifts = saved.union(above.select("path", F.lit(0).cast("long"), (F.col("n_convs") - 1) * total))
    sums = gifts.select(F.explode("path").alias("up"), "n_leaves", "saved").groupBy(F.col("up.low").alias("low"), F.col("up.top").alias("top")).agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("below"))
    steps = above.select("low", "top", "parent", "n_convs", "n_children", "ends", F.posexplode("sizes").alias("at", "size"), F.size("sizes").alias("run"))
    tail = F.expr("sum(size) OVER (PARTITION BY low, top ORDER BY at DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
    return steps.withColumn("tail", tail).join(sums, ["low", "top"]).select("low", "top", "parent", "n_convs", "n_children", "n_leaves", "below", "ends", "at", "tail", "run")


def _steps(rows: DataFrame) -> DataFrame:
    """Runs, one row a step (at, and tail, the bytes from there to the run's end), as nodes."""
    last = F.col("at") == F.col("run") - 1
    return rows.select(
        F.col("low").alias("conv_id"),
        (F.col("top") + F.col("at")).cast("long").alias("depth"),
        F.when(F.col("at") == 0, F.col("parent")).otherwise(F.col("low")).alias("parent_conv_id"),
        "n_convs",
        F.when(last, F.col("n_children")).otherwise(F.lit(1)).cast("long").alias("n_children"),
        "n_leaves",
        ((F.col("n_convs") - 1) * F.col("tail") + F.col("below")).alias("saved_tokens"),
        F.when(last, F.col("ends")).otherwise(F.lit(NO_MEMBERS)).alias("ends_sha256"),
    )
