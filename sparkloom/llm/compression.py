"""Classification by compression: zstandard dictionaries trained on two classes, compressed sizes of windows, calibration.

A text is cut into windows at blanks.  Each window is compressed once with the dictionary of either class.  Two ways to
read the sizes:

* ``Difference`` (quality): both dictionaries are trained on all windows of their class and keep their entropy tables.  The
  text's statistic is the difference of the two summed sizes, divided by the text's bytes.  A monotone fit (pooled
  adjacent violators over equal-count bins) turns it into a probability.
* ``Thresholds`` (toxicity): the few windows that matter sit in texts that are otherwise ordinary, so the toxic dictionary
  is trained on those windows of toxic texts that other toxic texts compress better than ordinary texts do: a vote over
  groups of texts chooses them, then two halves of the texts correct each other's choice, each by compressing with the
  dictionary that the other half's windows trained.  A large dictionary trained on ordinary text stands before it, so what
  remains of a window's size difference is what only toxic text holds.  The numbers and shares of windows over some
  thresholds go through a logistic fit.

Calibration is fitted on texts scored with dictionaries that other texts trained.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textcore import blocks, fold, pick

MAX_ROWS = 2000  #: labelled doc_ids of each class that a fit reads, at most; the least by a hash of the key
MAX_BYTES = 32_000_000  #: of their texts in each class: doc_ids beyond it, in the same order, are not read


@dataclass(frozen=True)
class Difference:
    """Parameters of the normalised size difference."""

    window: int = 512  #: bytes of a window, at most; windows end at blanks where they can
    size: int = 32_768  #: bytes of each dictionary
    segment: int = 50  #: bytes of a piece that the trainer takes over
    level: int = 3
    bins: int = 50  #: of the calibration, with equal counts


@dataclass(frozen=True)
class Thresholds:
    """Parameters of the windows over thresholds."""

    window: int = 32
    ordinary_size: int = 1_600_000  #: bytes of the ordinary dictionary
    ordinary_segment: int = 512
    size: int = 4096  #: bytes of the toxic dictionary
    segment: int = 16
    groups: int = 6  #: of each class's texts, that vote on windows
    group_bytes: int = 150_000  #: of text that a group votes with
    vote: float = 3  #: bytes by which the median group of toxic texts must compress a window better
    rounds: int = 2  #: of mutual correction
    gain: int = 4  #: bytes that a window must gain to be kept in a round
    thresholds: tuple[int, ...] = (2, 3, 4, 5, 6)  #: bytes; their weights are calibrated
    level: int = 3


Recipe = Difference | Thresholds


@dataclass(frozen=True)
class Model:
    recipe: Recipe
    negative: bytes  #: dictionary of the class with label 0
    positive: bytes
    #: of a Difference: statistics, ascending, and probabilities at them; of Thresholds: mean and scale, then weights
    knots: np.ndarray
    values: np.ndarray
    prior: float  #: the score where there is no text


def cut(text: bytes, size: int) -> list[bytes]:
    """Windows of at most size bytes that end after a blank where there is one. The empty text is one empty window."""
    out, at, n = [], 0, len(text)
    while at < n:
        end = min(n, at + size)
        if end < n:
            blank = text.rfind(b" ", at, end)
            if blank > at:
                end = blank + 1
        out.append(text[at:end])
        at = end
    return out or [b""]


def train(samples: list[bytes], size: int, segment: int) -> bytes:
    """A zstandard dictionary of about size bytes; of samples that are too few to train on, their text."""
    try:
        return zstandard.train_dictionary(size, samples, k=segment, d=8).as_bytes()
    except zstandard.ZstdError:
        return b" ".join(samples)[:size]


def compressor(dictionary: bytes, level: int, entropy: bool):
    """The compress function of a dictionary; entropy: with its entropy tables too, not only its text."""
    kind = zstandard.DICT_TYPE_AUTO if entropy and dictionary[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
    wide = {} if entropy else {"min_match": 5, "hash_log": 20, "chain_log": 20}
    params = zstandard.ZstdCompressionParameters.from_level(level, window_log=21, write_content_size=False, write_dict_id=False, write_checksum=False, **wide)
    d = zstandard.ZstdCompressionDict(dictionary, dict_type=kind)
    d.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(dict_data=d, compression_params=params).compress


def sizes(compress, windows: list[bytes]) -> np.ndarray:
    return np.fromiter((len(compress(w)) for w in windows), np.int64, len(windows))


def part_of(text: bytes, parts: int, salt: int) -> int:
    """Deals texts into parts: equal texts into the same one."""
    return zlib.crc32(text, salt) // 7 % parts


def _spread(texts: list[bytes], salt: int) -> list[bytes]:
    """The distinct texts in an order that depends on them alone."""
    return sorted(set(texts), key=lambda t: (zlib.crc32(t, salt), t))


def _all_windows(texts: list[bytes], size: int) -> list[bytes]:
    return [w for t in _spread(texts, 1) for w in cut(t, size)]


def vote(toxic: list[bytes], ordinary: list[bytes], recipe: Thresholds) -> list[bytes]:
    """The windows of toxic texts that the median of the other groups' toxic texts compresses better than its ordinary texts."""
    toxic, ordinary = _spread(toxic, 2), _spread(ordinary, 2)
    k, found = recipe.groups, []
    pairs = []
    for g in range(k):
        sides = [b" ".join(t for t in side if part_of(t, k, 3) == g) for side in (ordinary, toxic)]
        n = min(recipe.group_bytes, *map(len, sides))
        pairs.append([compressor(x[:n] or b" ", recipe.level, False) for x in sides])
    for t in toxic:
        own, windows = part_of(t, k, 3), cut(t, recipe.window)
        gains = [sizes(a, windows) - sizes(b, windows) for g, (a, b) in enumerate(pairs) if g != own]
        found += [w for w, v in zip(windows, np.median(gains, axis=0), strict=True) if v >= recipe.vote]
    return found


def build(texts: list[bytes], labels: np.ndarray, recipe: Recipe) -> tuple[bytes, bytes]:
    """The dictionaries of label 0 and 1. Order and repetition of the rows do not matter."""
    sides = [[t for t, y in zip(texts, labels, strict=True) if y == k] for k in (0, 1)]
    if isinstance(recipe, Difference):
        return tuple(train(_all_windows(side, recipe.window), recipe.size, recipe.segment) for side in sides)
    plain = train(_all_windows(sides[0], 256), recipe.ordinary_size, recipe.ordinary_segment)
    halves = [[[t for t in side if part_of(t, 2, 4) == h] for side in sides] for h in (0, 1)]
    chosen = [vote(toxic, ordinary, recipe) for ordinary, toxic in halves]
    base = compressor(plain, recipe.level, False)
    for _ in range(recipe.rounds):
        kept = []
        for h in (0, 1):
            windows = _all_windows(halves[h][1], recipe.window)
            other = compressor(plain + train(chosen[1 - h], recipe.size, recipe.segment), recipe.level, False)
            gains = sizes(base, windows) - sizes(other, windows)
            kept.append([w for w, g in zip(windows, gains, strict=True) if g >= recipe.gain])
        chosen = kept
    return plain, plain + train(chosen[0] + chosen[1], recipe.size, recipe.segment)


class Scorer:
    """The dictionaries of a recipe made ready for use in one process."""

    def __init__(self, recipe: Recipe, negative: bytes, positive: bytes):
        self.recipe = recipe
        self.compressors = [compressor(d, recipe.level, isinstance(recipe, Difference)) for d in (negative, positive)]

    def gains(self, text: bytes) -> np.ndarray:
        """By how many bytes the dictionary of label 1 compresses each window better."""
        windows = cut(text, self.recipe.window)
        negative, positive = self.compressors
        return sizes(negative, windows) - sizes(positive, windows)

    def statistics(self, text: bytes) -> np.ndarray:
        d = self.gains(text)
        if isinstance(self.recipe, Difference):
            return np.array([d.sum() / max(1, len(text))])
        over = [(d >= t).sum() for t in self.recipe.thresholds]
        return np.array([*np.log1p(over), *[n / len(d) for n in over]])


def score(model: Model, scorer: Scorer, text: bytes) -> float:
    """0 to 1, higher: label 1 likelier."""
    if not text.strip():
        return model.prior
    x = scorer.statistics(text)
    if isinstance(model.recipe, Difference):
        return float(np.interp(x[0], model.knots, model.values))
    z = float(np.append(((x - model.knots[0]) / model.knots[1]).clip(-8, 8), 1.0) @ model.values)
    return 1 / (1 + math.exp(-min(30.0, max(-30.0, z))))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """Mean and scale, and the weights (the last one constant) of a logistic regression by Newton steps."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.c_[((x - mean) / scale).clip(-8, 8), np.ones(len(x))]
    w = np.zeros(z.shape[1])
    penalty = np.diag([ridge] * (len(w) - 1) + [1e-3])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-6)[:, None]).T @ z + penalty, z.T @ (p - y) + penalty @ w)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return np.array([mean, scale]), w


def monotone(x: np.ndarray, y: np.ndarray, bins: int, odds: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Statistics, ascending, and probabilities of label 1 at them that never fall: bins with equal counts, neighbours
    whose rates fall pooled, half a row of either label added. odds: by which the labels' odds differ from those of y."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []
    for part in np.array_split(order, min(bins, len(order))):
        pools.append([x[part].mean(), y[part].sum(), len(part)])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            at, ones, n = pools.pop()
            a = pools[-1]
            a[0], a[1], a[2] = (a[0] * a[2] + at * n) / (a[2] + n), a[1] + ones, a[2] + n
    rate = np.array([(ones + 0.5) / (n + 1) for _, ones, n in pools])
    odd = odds * rate / (1 - rate)
    return np.array([p[0] for p in pools]), np.maximum.accumulate(odd / (1 + odd))


def fit(texts: list[bytes], labels: list[int], recipe: Recipe, totals: tuple[int, int] | None = None) -> Model:
    """Dictionaries from all texts; the calibration from two halves, each scored with the other half's dictionaries.

    totals: how many rows of label 0 and 1 there are, where the texts are a sample that has other shares; the scores
    then follow the shares of all rows. Equal texts go to one half. Where a half has fewer than two different texts of a
    class, the score is the smoothed rate of label 1.
    """
    y = np.array(labels, float)
    own = np.array([(y == 0).sum(), (y == 1).sum()]) + 0.5
    every = own if totals is None else np.array(totals) + 0.5
    prior = float(every[1] / every.sum())
    half = np.array([part_of(t, 2, 5) for t in texts], int)
    if any(len({t for t, k, h in zip(texts, y, half, strict=True) if k == c and h == s}) < 2 for c in (0, 1) for s in (0, 1)):
        width = 1 if isinstance(recipe, Difference) else 2 * len(recipe.thresholds)
        flat = (np.zeros(1), np.full(1, prior)) if width == 1 else (np.array([np.zeros(width), np.ones(width)]), np.append(np.zeros(width), math.log(prior / (1 - prior))))
        return Model(recipe, b" ", b" ", *flat, prior)
    x: list = [None] * len(texts)
    for side in (0, 1):
        scorer = Scorer(recipe, *build([t for t, h in zip(texts, half, strict=True) if h != side], y[half != side], recipe))
        for i in np.flatnonzero(half == side):
            x[i] = scorer.statistics(texts[i])
    odds = float(every[1] / every[0] * own[0] / own[1])
    if isinstance(recipe, Difference):
        knots, values = monotone(np.array(x)[:, 0], y, recipe.bins, odds)
    else:
        knots, values = logistic(np.array(x), y)
        values[-1] += math.log(odds)
    return Model(recipe, *build(texts, y, recipe), knots, values, prior)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held: int, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> tuple[list[bytes], list[int], tuple[int, int]]:
    """Labelled rows outside the held-out fold, at most max_rows doc_ids of each class, the least by a hash of the key; and
    how many there are of each. Each text is whole; a doc_id whose texts do not fit into what its class has left of
    max_bytes is passed over, and those behind it still serve.

    Null doc_ids, null texts, and labels other than 0 and 1 do not count, nor does a doc_id with both labels. Repeated
    labels count once; rows that repeat a doc_id all serve.
    """
    marked = pick(labels, "doc_id", label).select("doc_id", F.col(label).cast("int").alias("mark")).where("mark IN (0, 1) AND doc_id IS NOT NULL").where(fold("doc_id", modulus) != held)
    marked = marked.groupBy("doc_id").agg(F.min("mark").alias("mark"), F.max("mark").alias("top")).where("mark = top").select("doc_id", "mark")
    rank = F.xxhash64(F.lit(11), "doc_id")
    # a first cut by the key alone keeps the texts of all other rows out of the join
    few = None
    for k in (0, 1):
        part = marked.where(F.col("mark") == k).orderBy(rank, "doc_id").limit(max_rows)
        few = part if few is None else few.union(part)
    rows = pick(docs, "doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(few), "doc_id")
    sizes = rows.groupBy("mark", rank.alias("rank"), "doc_id").agg(F.sum(F.octet_length("text")).alias("size")).collect()
    left, beyond = {0: max_bytes, 1: max_bytes}, []
    for r in sorted(sizes, key=lambda r: (r.rank, r.doc_id)):
        if r.size <= left[r.mark]:
            left[r.mark] -= r.size
        else:
            beyond.append(r.doc_id)
    if beyond:
        rows = rows.where(~F.col("doc_id").isin(beyond))
    got = sorted((r.text.encode(), r.mark) for r in rows.select("text", "mark").collect())
    counts = {r.mark: r["count"] for r in marked.groupBy("mark").count().collect()}
    return [t for t, _ in got], [k for _, k in got], (counts.get(0, 0), counts.get(1, 0))


def fit_labelled(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held: int, recipe: Recipe) -> Model:
    """fit on labelled_sample. Without labelled rows (empty tables) every score is 0.5."""
    texts, marks, totals = labelled_sample(docs, labels, label, modulus, held)
    return fit(texts, marks, recipe, totals)


def classify(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """The columns keep of docs, and score, for every row.

    A null text counts as empty: an empty or blank text scores the share of label 1 among the labelled rows. Equal texts
    score the same, repeated rows each get their row, and a text of any length is scored whole, window by window.
    """
    source = pick(docs, *keep, text).toDF(*keep, "__text")
    schema = source.drop("__text").schema.add("score", "double")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.recipe, model.negative, model.positive)
        for part, block in blocks(batches, "__text"):
            scores = pa.array([score(model, scorer, block.text(i)) for i in range(len(block))], pa.float64())
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], scores], [*keep, "score"])

    return source.mapInArrow(scored, schema)
