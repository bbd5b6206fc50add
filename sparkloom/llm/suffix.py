"""Quality rules: suffix-array repetition over words, beside a base of plain counts.

A text's words become numbers and their suffix array is built by prefix doubling; the common prefixes of neighbours in
it bound every longest-common-prefix interval, so each suffix's longest repeat is the larger of its two neighbours'
prefixes.  The union of those spans is the union of all maximal repeats.  Only suffixes that begin with a repeated
run of LEAST words can lie in a repeat that counts, so texts without such a run need no suffix array.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .textcore import Block, blocks, pick, windows

LEAST = 8  #: words of the shortest repeat that counts
MOST_COVERED = 0.30  #: of a text's words, in repeats
MOST_LONGEST = 200  #: words of a text's longest repeat
BASE_WORDS, BASE_WINDOW, BASE_PERCENT = 50, 3, 50
SYMBOLS = b"#*$%&|<>"


def suffix_array(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of a number sequence, and each suffix's common prefix with the one before it."""
    n = len(ids)
    rank = np.unique(ids, return_inverse=True)[1].astype(np.int64)
    levels = [rank]
    k = 1
    while rank.max(initial=0) < n - 1:
        second = np.zeros(n, np.int64)
        second[: max(0, n - k)] = rank[k:] + 1
        key = rank * (n + 1) + second
        rank = np.unique(key, return_inverse=True)[1].astype(np.int64)
        levels.append(rank)
        k *= 2
    order = np.argsort(rank)
    lcp = np.zeros(n, np.int64)
    a, b = order[:-1].copy(), order[1:].copy()
    for j in range(len(levels) - 2, -1, -1):
        ok = (a < n) & (b < n)
        ok[ok] = levels[j][a[ok]] == levels[j][b[ok]]
        # equal ranks at a level mean equal runs of 2**j words or both cut by the end, which cannot be for two suffixes
        lcp[1:][ok] += 1 << j
        a[ok] += 1 << j
        b[ok] += 1 << j
    return order, lcp


def repeats(ids: np.ndarray, least: int = LEAST) -> tuple[int, int, list[tuple[int, int]]]:
    """Words covered by repeats of at least `least` words, words of the longest one, and the union's spans."""
    n = len(ids)
    if n <= least:
        return 0, 0, []
    order, lcp = suffix_array(ids)
    reach = np.zeros(n, np.int64)
    reach[order] = np.maximum(lcp, np.append(lcp[1:], 0))
    longest = int(reach.max())
    reach[reach < least] = 0
    step = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(reach)
    np.add.at(step, at, 1)
    np.add.at(step, at + reach[at], -1)
    covered = np.cumsum(step[:-1]) > 0
    edge = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(np.int8), [0]])))
    return int(covered.sum()), longest if longest >= least else 0, list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def _shared(h: np.ndarray, first: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For windows with hash h: the text of each, and whether it occurs twice or more in its text."""
    text = np.searchsorted(ptr, first, side="right") - 1
    bounds = np.searchsorted(text, np.arange(len(ptr)))
    twice = np.zeros(len(h), bool)
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a > 1:
            order = np.argsort(h[a:b])
            same = np.diff(h[a:b][order]) == 0
            twice[a + order[1:][same]] = True
            twice[a + order[:-1][same]] = True
    return text, twice


def measure(block: Block) -> dict[str, list]:
    """Base counts and repetition of each text of a block."""
    data, bounds, n = block.data, block.bounds, len(block)
    starts, ends, ptr = block.words()
    points = block.code_points()
    words = np.diff(ptr)
    chars = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(points[ends] - points[starts], out=chars[1:])
    marks = np.zeros(256, np.int64)
    marks[list(SYMBOLS)] = 1
    symbols = np.zeros(len(data) + 1, np.int64)
    np.cumsum(marks[data], out=symbols[1:])
    h = block.hashes(starts, ends, lower=False)
    found, first = windows(h, ptr, BASE_WINDOW)
    _, twice = _shared(found, first, ptr)
    step = np.zeros(len(starts) + 1, np.int64)
    np.add.at(step, first[twice], 1)
    np.add.at(step, first[twice] + BASE_WINDOW, -1)
    inside = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(np.cumsum(step[:-1]) > 0, out=inside[1:])
    found, first = windows(h, ptr, LEAST)
    text, twice = _shared(found, first, ptr)
    repeated = np.zeros(n, bool)
    repeated[text[twice]] = True
    dup = []
    for i in range(n):
        lines, seen = 0, set()
        for line in block.text(i).split(b"\n"):
            if line.strip(b"\x20\t\n\x0b\x0c\r"):
                lines += line in seen
                seen.add(line)
        dup.append(lines)
    covered, longest, spans = [0] * n, [0] * n, [[] for _ in range(n)]
    for i in np.flatnonzero(repeated):
        covered[i], longest[i], spans[i] = repeats(h[ptr[i] : ptr[i + 1]])
    return {
        "n_words": words.tolist(), "word_chars": (chars[ptr[1:]] - chars[ptr[:-1]]).tolist(), "n_symbols": (symbols[bounds[1:]] - symbols[bounds[:-1]]).tolist(), "n_dup_lines": dup,
        "n_repeat_words": (inside[ptr[1:]] - inside[ptr[:-1]]).tolist(), "covered_words": covered, "longest_repeat": longest, "spans": spans,
    }


def quality_rules(docs: DataFrame, most_covered: float = MOST_COVERED, most_longest: int = MOST_LONGEST) -> DataFrame:
    """Counts, repeated spans (first word, end word) and verdicts for every row of docs.

    A null text counts as empty; an empty text has no words and fails the base. Repeated rows each get their row, null
    doc_ids stay null, an empty table gives no rows. Texts are read whole: arrays of about 60 bytes for each byte of a
    text stand in memory at a time, so a single text of 10 MB takes 0.6 GB.
    """
    source = pick(docs, "doc_id", "text")
    kind = source.schema["doc_id"].dataType.simpleString()
    longs = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat"]

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, block in blocks(batches, "text"):
            m = measure(block)
            n, rep, cov, far = (np.array(m[k], np.int64) for k in ("n_words", "n_repeat_words", "covered_words", "longest_repeat"))
            failed = (n < BASE_WORDS) | (100 * rep > BASE_PERCENT * n)
            kept = ~failed & (cov <= most_covered * n) & (far <= most_longest)
            spans = pa.array([[{"start": a, "end": b} for a, b in s] for s in m["spans"]], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *[pa.array(m[k], pa.int64()) for k in longs], pa.array(failed), pa.array(kept), spans], ["doc_id", *longs, "base_failed", "kept", "repeated"])

    return source.mapInArrow(measured, f"doc_id {kind}, {', '.join(f'{k} long' for k in longs)}, base_failed boolean, kept boolean, repeated array<struct<start:long,end:long>>")
