"""Language identification: script ranges narrow the candidates, byte trigrams score words, Viterbi labels spans.

Each word gets, for every language, the log-likelihood of its lower-cased byte trigrams, blanks at its edges included.
Languages that do not write the word's script are out.  The best path over a text's words pays PENALTY for each change
of language.  A text in which no run of words gains PENALTY by another language has a constant best path, which is
found without the recursion; only the others are decoded word by word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textcore import Block, blocks, fold, pick

CODES = 1 << 16
PENALTY = 20.0
MAX_ROWS = 400  #: labelled rows of each language that the fit reads, at most
FIT_CHARS, FIT_WINDOWS = 20_000, 20  #: of a longer row the fit reads so many characters, in windows spread evenly over all of it
OUT = -1e6
_ONE_BLANK = np.arange(256, dtype=np.uint32)
_ONE_BLANK[9:14] = 32

#: First and last code point of the letters of a script. Fixed values, from the Unicode blocks.
SCRIPTS = [
    ("latin", 0x41, 0x24F), ("latin", 0x1E00, 0x1EFF), ("greek", 0x370, 0x3FF), ("greek", 0x1F00, 0x1FFF), ("cyrillic", 0x400, 0x52F),
    ("armenian", 0x530, 0x58F), ("hebrew", 0x590, 0x5FF), ("arabic", 0x600, 0x77F), ("arabic", 0xFB50, 0xFDFF), ("devanagari", 0x900, 0x97F),
    ("bengali", 0x980, 0x9FF), ("gurmukhi", 0xA00, 0xA7F), ("gujarati", 0xA80, 0xAFF), ("tamil", 0xB80, 0xBFF), ("telugu", 0xC00, 0xC7F),
    ("kannada", 0xC80, 0xCFF), ("malayalam", 0xD00, 0xD7F), ("sinhala", 0xD80, 0xDFF), ("thai", 0xE00, 0xE7F), ("lao", 0xE80, 0xEFF),
    ("myanmar", 0x1000, 0x109F), ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF), ("hangul", 0xAC00, 0xD7AF), ("ethiopic", 0x1200, 0x137F),
    ("khmer", 0x1780, 0x17FF), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x9FFF), ("han", 0x20000, 0x3FFFF),
]
NAMES = ["other", *dict.fromkeys(s for s, _, _ in SCRIPTS)]


def letter_scripts() -> np.ndarray:
    """For each code point below 0x40000: 0 for no letter, else 1 plus the number of its script."""
    out = np.array([chr(i).isalpha() if not 0xD800 <= i < 0xE000 else False for i in range(0x40000)], np.int8)
    for name, lo, hi in SCRIPTS:
        out[lo : hi + 1] *= np.int8(1 + NAMES.index(name))
    return out


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    table: np.ndarray  #: log probability of each trigram code by language, float32 [CODES, languages]
    writes: np.ndarray  #: whether a language writes a script, bool [1 + scripts, languages]


class Words:
    """What the model needs of some texts: words, trigram codes, and the script of each word's first letter."""

    def __init__(self, texts: list[str], scripts: np.ndarray):
        self.block = block = Block.of([t.lower() for t in texts])
        self.starts, self.ends, self.ptr = block.words()
        data = block.data
        padded = np.full(len(data) + 2, 32, np.uint32)
        padded[1:-1] = _ONE_BLANK[data]
        before = padded[:-2].copy()
        before[block.bounds[1:-1][block.bounds[1:-1] < len(data)]] = 32  # the byte before a text is not its own
        self.codes = ((before | padded[1:-1] << np.uint32(8) | padded[2:] << np.uint32(16)) * np.uint32(2654435761)) >> np.uint32(16)
        # the script of a word's first letter: step over what comes before it, for all words at once
        self.script = np.zeros(len(self.starts), np.int8)
        at, open_ = self.starts.copy(), np.arange(len(self.starts))
        while len(open_):
            lead = data[at].astype(np.int64)
            point, size = lead.copy(), np.ones(len(at), np.int64)
            for low, more, mask in ((0xC0, 1, 0x1F), (0xE0, 2, 0x0F), (0xF0, 3, 0x07)):
                wide = np.flatnonzero(lead >= low)
                value = lead[wide] & mask
                for k in range(1, more + 1):
                    value = value << 6 | (data[np.minimum(at[wide] + k, len(data) - 1)] & 0x3F)
                point[wide], size[wide] = value, more + 1
            kind = scripts[np.minimum(point, len(scripts) - 1)]
            self.script[open_] = kind
            at = at + size
            left = (kind == 0) & (at < self.ends[open_])
            at, open_ = at[left], open_[left]

    def scores(self, model: LanguageModel) -> np.ndarray:
        """Log-likelihood by word and language, relative to the word's best; words without a letter get zeros."""
        if not len(self.starts):
            return np.zeros((0, len(model.languages)))
        inside = np.zeros(len(self.codes) + 1, np.int8)
        inside[self.starts] += 1
        np.subtract.at(inside, self.ends, 1)
        codes = self.codes[np.cumsum(inside[:-1], dtype=np.int8) > 0]
        first = np.cumsum(self.ends - self.starts) - (self.ends - self.starts)
        s = np.add.reduceat(model.table[codes], first, axis=0).astype(np.float64)
        allowed = model.writes[self.script]
        s = np.where(allowed | ~allowed.any(1, keepdims=True), s, OUT)
        s -= s.max(1, keepdims=True, initial=OUT)
        s[self.script == 0] = 0
        return s


def train(texts: list[str], langs: list[str]) -> LanguageModel:
    """Smoothed trigram frequencies and scripts by language."""
    languages = tuple(sorted(set(langs)))
    scripts = letter_scripts()
    table, writes = np.zeros((CODES, len(languages)), np.float32), np.zeros((1 + len(NAMES), len(languages)), bool)
    for k, lang in enumerate(languages):
        words = Words([t for t, x in zip(texts, langs, strict=True) if x == lang], scripts)
        inside = np.zeros(len(words.codes) + 1, np.int64)
        np.add.at(inside, words.starts, 1)
        np.add.at(inside, words.ends, -1)
        counts = np.bincount(words.codes[np.cumsum(inside)[:-1] > 0], minlength=CODES) + 0.1
        table[:, k] = np.log(counts / counts.sum())
        used = np.bincount(words.script[words.script > 0], minlength=1 + len(NAMES))
        writes[:, k] = used >= max(1, 0.01 * used.sum())
    return LanguageModel(languages, table, writes)


def viterbi(scores: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """The best path of languages through word scores; of equal paths one that changes late."""
    n, k = scores.shape
    best, came = scores[0].copy(), np.zeros((n, k), np.int32)
    own = np.arange(k)
    for t in range(1, n):
        top = int(best.argmax())
        jump = best[top] - penalty
        came[t] = np.where(best >= jump, own, top)
        best = np.maximum(best, jump) + scores[t]
    path = np.zeros(n, np.int64)
    path[-1] = best.argmax()
    for t in range(n - 1, 0, -1):
        path[t - 1] = came[t, path[t]]
    return path


def constant(scores: np.ndarray, penalty: float = PENALTY) -> int:
    """The language of the whole text if each run of words gains less than half the penalty by another one, else -1.

    Then m runs of other languages gain less than m * penalty / 2, and their path pays (m - 1) penalties, or one if m is 1.
    """
    total = scores.sum(0)
    k = int(total.argmax())
    sums = np.zeros((len(scores) + 1, scores.shape[1]))
    np.cumsum(scores - scores[:, k : k + 1], axis=0, out=sums[1:])
    return k if (sums - np.minimum.accumulate(sums, axis=0)).max() < penalty / 2 else -1


def lead(total: np.ndarray, k: int) -> float:
    """1 - exp(-m), where m is by how much total[k] is above the greatest of the others, at least 0."""
    others = np.delete(total, k)
    return float(-np.expm1(-max(0.0, total[k] - others.max()))) if len(others) else 1.0


def label(texts: list[str | None], model: LanguageModel, scripts: np.ndarray, penalty: float = PENALTY) -> Iterator[tuple[str, float, list[tuple[int, int, str]]]]:
    """For each text its language, a score, and spans by word numbers.

    The score is the share of the words with a letter that have the language, times 1 - exp(-m): m is what the language gains
    over the next best for the whole text, by word with a letter. Where no other language is left, it is the share.
    """
    words = Words([t or "" for t in texts], scripts)
    scores = words.scores(model) if model.languages else np.zeros((len(words.starts), 0))
    for a, b in zip(words.ptr[:-1], words.ptr[1:], strict=True):
        letters = words.script[a:b] > 0
        if not letters.any() or not model.languages:
            yield "und", 0.0, []
            continue
        total = scores[a:b].sum(0) / letters.sum()
        k = constant(scores[a:b], penalty)
        if k >= 0:
            yield model.languages[k], lead(total, k), [(0, int(b - a), model.languages[k])]
            continue
        path = viterbi(scores[a:b], penalty)
        share = np.bincount(path[letters], minlength=len(model.languages)) / letters.sum()
        ends = [*np.flatnonzero(np.diff(path)) + 1, b - a]
        spans = [(int(x), int(y), model.languages[path[x]]) for x, y in zip([0, *ends[:-1]], ends, strict=True)]
        k = int(share.argmax())
        yield model.languages[k], float(share[k]) * lead(total, k), spans


def fit(docs: DataFrame, modulus: int | None = None, held: int = 0, max_rows: int = MAX_ROWS) -> LanguageModel:
    """Learns from at most max_rows rows of each language, the least by a hash of doc_id; rows of the held-out fold stay out.

    Rows without text, language or doc_id do not serve. Of rows of more than FIT_CHARS characters, FIT_WINDOWS windows do, from
    their beginning to their end, so that a language of long texts only is learned like any other and the fit stays bounded.
    """
    rows = pick(docs, "doc_id", "text", "lang").where("doc_id IS NOT NULL AND lang IS NOT NULL")
    if modulus:
        rows = rows.where(fold("doc_id", modulus) != held)
    counts = {r.lang: r["count"] for r in rows.select("lang").groupBy("lang").count().collect()}
    if not counts:
        return LanguageModel((), np.zeros((CODES, 0), np.float32), np.zeros((1 + len(NAMES), 0), bool))
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1_000_000, 2_000_000 * max_rows // n + 1))])
    rank = F.xxhash64(F.lit(13), "doc_id")
    size = FIT_CHARS // FIT_WINDOWS
    places = F.transform(F.sequence(F.lit(0), F.lit(FIT_WINDOWS - 1)), lambda k: F.floor((F.length("text") - size) * k / (FIT_WINDOWS - 1)).cast("int") + 1)
    windows = F.array_join(F.transform(places, lambda at: F.substring("text", at, F.lit(size))), " ")
    read = F.when(F.length("text") <= FIT_CHARS, F.col("text")).otherwise(windows)
    few = rows.where(F.pmod(rank, F.lit(1_000_000)) < share[F.col("lang")]).where(F.col("text").isNotNull()).withColumn("text", read)
    taken: dict[str, list[str]] = {}
    for r in sorted(few.select("lang", rank.alias("rank"), "text").collect(), key=lambda r: (r.lang, r.rank, r.text)):
        if len(taken.setdefault(r.lang, [])) < max_rows:
            taken[r.lang].append(r.text)
    return train([t for x in taken.values() for t in x], [k for k, x in taken.items() for _ in x])


def identify(docs: DataFrame, model: LanguageModel, penalty: float = PENALTY) -> DataFrame:
    """doc_id, lang_pred, score, and spans (first word, end word, lang) for every row of docs.

    A null text, or one without a letter, gives 'und', score 0 and no spans; so does a model without languages (an empty
    table to learn from). Repeated rows each get their row and equal texts equal results; of languages with equal scores
    the first by name holds. Texts of any length are read whole. A word's script is that of its first letter, so a text
    without blanks is one word with one language.
    """
    source = pick(docs, "doc_id", "text")
    kind = source.schema["doc_id"].dataType.simpleString()
    scripts = letter_scripts()

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))
        for part, _ in blocks(batches, "text", 1_000_000):
            got = list(label(part.column("text").to_pylist(), model, scripts, penalty))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64()), pa.array([[{"start": a, "end": b, "lang": k} for a, b, k in x[2]] for x in got], spans)],
                ["doc_id", "lang_pred", "score", "spans"],
            )

    return source.mapInArrow(labelled, f"doc_id {kind}, lang_pred string, score double, spans array<struct<start:int,end:int,lang:string>>")
