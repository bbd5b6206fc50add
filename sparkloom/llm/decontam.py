"""Benchmark decontamination: a BM25 index of the test items, block-max WAND, and a check of question and answer.

The test items are the indexed documents; each passage of each training text is a query.  A score counts as a share of
what the item's own text would score, so one threshold serves long and short items.  Passages are windows of twice the
longest item that start every one such length, so each item that a text holds lies in one passage as a whole.  Items are
taken by classes of length, so one very long item does not stretch the passages that all others are sought in.  How often
words occur, and the mean length, are those of all items, however many indexes hold them.

Most passages share no more than common words with any item.  So a passage is first held against bounds, which spare
the walk but decide nothing else: of each item's words only the rarest are gathered (all but the most frequent ones that
together weigh LOOSE), and what the others weigh is added in full.  A passage whose bound reaches the threshold for some
item goes to block-max WAND, which finds all items that do.  The gather takes passages in slices of at most GATHER
postings, so its memory follows neither the items nor the passages.  Found items are then confirmed by the word pairs of
question and answer.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textcore import Block, blocks, materialize, pick, release

K1, B = 1.2, 0.75
THRESHOLD = 0.5  #: of the item's score for its own text
QUESTION, ANSWER = 0.6, 0.5  #: of the word pairs of either that the passage must hold
POSTINGS = 8  #: entries of a posting block
LOOSE = 0.25  #: of an item's weight that its most frequent words may hold without being gathered
GATHER = 2_000_000  #: postings that bounds are computed from at a time
SLICE_BYTES = 32_000_000  #: of item text in one index; more items make more passes
CLASS_WORDS, CLASS_FACTOR = 256, 16  #: words of the longest item of the first class of lengths; each next class has so many times as many

_WORD = np.ones(256, bool)  # bytes of other characters count as letters
_WORD[:128] = False
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True


def normal_words(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words without ASCII punctuation at their ends, A-Z lower-cased; and each text's bounds in them."""
    starts, ends, ptr = block.words()
    text = np.repeat(np.arange(len(block)), np.diff(ptr))
    marks = np.zeros(len(block.data) + 1, np.int64)
    np.cumsum(_WORD[block.data], out=marks[1:])
    has = marks[ends] > marks[starts]
    starts, ends, text = starts[has], ends[has], text[has]
    at = np.flatnonzero(_WORD[block.data])
    first = at[marks[starts]] if len(starts) else starts
    last = at[marks[ends] - 1] + 1 if len(starts) else ends
    return block.hashes(first, last, lower=True), np.searchsorted(text, np.arange(len(block) + 1))


def halves(n: int, breaks: int) -> int:
    """Words of the question: those before the last line, or three quarters of a one-line item."""
    return breaks if 0 < breaks < n else max(1, n - max(1, n // 4))


@dataclass(frozen=True)
class Statistics:
    """Of all items: how many, their mean length, in how many each word occurs; and the longest item of the class."""

    n: int
    mean: float
    frequency: Mapping[int, int]
    longest: int


class Index:
    """Posting lists of the items by word hash, with a bound for each block of POSTINGS entries."""

    def __init__(self, items: list[tuple[int, str]], among: Statistics | None = None):
        """among: the statistics of all items, where these are only some of them."""
        items = sorted((i, t) for i, t in items if t and t.strip())
        block = Block.of([t for _, t in items])
        h, ptr = normal_words(block)
        keep = [k for k in range(len(items)) if ptr[k + 1] > ptr[k]]
        self.ids = [items[k][0] for k in keep]
        self.words = [h[ptr[k] : ptr[k + 1]] for k in keep]
        self.question = []
        for k in keep:
            head = items[k][1].rstrip().rpartition("\n")[0]
            self.question.append(halves(int(ptr[k + 1] - ptr[k]), len(normal_words(Block.of([head]))[0])))
        n = len(keep)
        self.longest = among.longest if among else max([8, *map(len, self.words)])
        mean = among.mean if among else np.mean([len(w) for w in self.words]) if n else 1.0
        lists: dict[int, list[tuple[int, float]]] = {}
        for d, words in enumerate(self.words):
            for word, tf in zip(*np.unique(words, return_counts=True), strict=True):
                lists.setdefault(int(word), []).append((d, tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(words) / mean))))
        self.vocabulary = np.array(sorted(lists), np.uint64)
        own = np.zeros(n)
        for word in lists:
            df, total = (among.frequency[word], among.n) if among else (len(lists[word]), n)
            idf = np.log(1 + (total - df + 0.5) / (df + 0.5))
            lists[word] = [(d, idf * w) for d, w in lists[word]]
            for d, w in lists[word]:
                own[d] += w
        self.docs, self.weights, self.bounds = [], [], []
        for word in self.vocabulary.tolist():
            d = np.array([x for x, _ in lists[word]], np.int64)
            w = np.array([x for _, x in lists[word]]) / own[d]
            self.docs.append(d)
            self.weights.append(w)
            self.bounds.append(np.maximum.reduceat(w, np.arange(0, len(w), POSTINGS)))
        # each item's words from the most frequent on, as long as they weigh no more than LOOSE, are left out of the gather
        term = np.repeat(np.arange(len(self.docs)), [len(d) for d in self.docs])
        item = np.concatenate([np.zeros(0, np.int64), *self.docs])
        weight = np.concatenate([np.zeros(0), *self.weights])
        order = np.lexsort((term, -np.array([len(d) for d in self.docs], np.int64)[term], item))
        sums = np.cumsum(weight[order])
        first = np.searchsorted(item[order], item[order])
        left_out = sums - (sums - weight[order])[first] <= LOOSE
        self.rest = np.bincount(item[order][left_out], weight[order][left_out], minlength=n)
        kept = np.sort(order[~left_out])
        self.at = np.searchsorted(term[kept], np.arange(len(self.docs) + 1))
        self.flat_docs, self.flat_weights = item[kept], weight[kept]
        self.lists = ([d.tolist() for d in self.docs], [w.tolist() for w in self.weights], [b.tolist() for b in self.bounds], [float(w.max()) for w in self.weights])
        self.slots = np.zeros(1 << 16, bool)
        self.slots[(self.vocabulary >> np.uint64(48)).astype(np.int64)] = True

    def terms(self, h: np.ndarray) -> np.ndarray:
        """The number of each word in the vocabulary, or -1."""
        out = np.full(len(h), -1, np.int64)
        maybe = np.flatnonzero(self.slots[(h >> np.uint64(48)).astype(np.int64)])
        at = np.searchsorted(self.vocabulary, h[maybe])
        at[at == len(self.vocabulary)] = 0
        ok = self.vocabulary[at] == h[maybe]
        out[maybe[ok]] = at[ok]
        return out

    def hopeful(self, passage: np.ndarray, term: np.ndarray, threshold: float) -> np.ndarray:
        """Passages (of word occurrences in two parallel arrays) for which some item's bound reaches the threshold."""
        if (self.rest >= threshold - 1e-9).any():  # some item needs none of its gathered words
            return np.unique(passage)
        m, n = max(1, len(self.docs)), max(1, len(self.ids))
        pairs = np.unique(passage * m + term)
        passage, term = pairs // m, pairs % m
        sizes = self.at[term + 1] - self.at[term]
        passage, term, sizes = passage[sizes > 0], term[sizes > 0], sizes[sizes > 0]
        done = np.concatenate([[0], np.cumsum(sizes)])
        firsts = np.flatnonzero(np.diff(passage, prepend=-1))  # where a passage begins
        found, at = [np.zeros(0, np.int64)], 0
        while at < len(passage):
            # whole passages up to the limit, or one that is larger
            k = np.searchsorted(done[firsts], done[at] + GATHER, side="right") - 1
            end = int(firsts[k]) if k < len(firsts) and firsts[k] > at else len(passage)
            if end == len(passage) and done[-1] - done[at] > GATHER:
                later = firsts[firsts > at]
                end = int(later[0]) if len(later) else len(passage)
            some = slice(at, end)
            key = np.repeat(passage[some], sizes[some]) * n
            entry = np.arange(len(key)) + np.repeat(self.at[term[some]] - (done[at:end] - done[at]), sizes[some])
            keys, where = np.unique(key + self.flat_docs[entry], return_inverse=True)
            bound = np.bincount(where, self.flat_weights[entry]) + self.rest[keys % n]
            found.append(np.unique(keys[bound >= threshold - 1e-9] // n))
            at = end
        return np.unique(np.concatenate(found))

    def search(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """All items whose score for the distinct terms reaches the threshold, by block-max WAND."""
        end, least = len(self.ids), threshold - 1e-9
        docs, weights, bounds, tops = self.lists
        cursors = [[docs[t][0], 0, t] for t in terms]  # item, place in the list, term
        out = []
        while True:
            cursors.sort()
            while cursors and cursors[-1][0] >= end:
                cursors.pop()
            total, pivot = 0.0, -1
            for i, x in enumerate(cursors):
                total += tops[x[2]]
                if total >= least:
                    pivot = i
                    break
            if pivot < 0:
                return out
            doc = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == doc:
                pivot += 1
            # the bounds of the posting blocks that would hold the item
            bound, skip = 0.0, cursors[pivot + 1][0] if pivot + 1 < len(cursors) else end
            for x in cursors[: pivot + 1]:
                own = docs[x[2]]
                k = x[1] // POSTINGS if x[0] == doc else bisect_left(own, doc, x[1]) // POSTINGS
                if k < len(bounds[x[2]]):
                    bound += bounds[x[2]][k]
                    skip = min(skip, own[min(len(own), (k + 1) * POSTINGS) - 1] + 1)
            if bound < least:
                target = max(skip, doc + 1)
            elif cursors[0][0] == doc:
                score = sum(weights[x[2]][x[1]] for x in cursors[: pivot + 1])
                if score >= least:
                    out.append((doc, score))
                target = doc + 1
            else:
                target = doc
            for x in cursors[: pivot + 1]:
                if x[0] < target:
                    own = docs[x[2]]
                    x[1] = bisect_left(own, target, x[1])
                    x[0] = own[x[1]] if x[1] < len(own) else end

    def overlap(self, item: int, words: np.ndarray) -> tuple[float, float]:
        """The shares of the word pairs of question and answer that words hold. A part of one word counts as that word."""
        own, q = self.words[item], self.question[item]
        held = set(zip(words[:-1].tolist(), words[1:].tolist(), strict=True))
        single = set(words.tolist())

        def share(part: np.ndarray) -> float:
            if len(part) == 1:
                return float(int(part[0]) in single)
            pairs = set(zip(part[:-1].tolist(), part[1:].tolist(), strict=True))
            return len(pairs & held) / len(pairs)

        return share(own[:q]), share(own[q:]) if q < len(own) else 1.0

    def matches(self, block: Block, threshold: float = THRESHOLD, exhaustive: bool = False) -> list[tuple[int, int, float, float, float]]:
        """(text, item, score, question overlap, answer overlap) of what a block of texts holds, best passage per pair."""
        if not self.ids:
            return []
        h, ptr = normal_words(block)
        step = self.longest
        term = self.terms(h)
        known = np.flatnonzero(term >= 0)
        text = np.searchsorted(ptr, known, side="right") - 1
        chunk = (known - ptr[text]) // step
        last = np.maximum(0, (np.diff(ptr) - 1) // step - 1)[text] if len(known) else chunk
        base = np.concatenate([[0], np.cumsum(np.maximum(1, -(-np.diff(ptr) // step)))])
        # passage c holds the chunks c and c + 1 of its text
        first, second = np.minimum(chunk, last), np.maximum(chunk - 1, 0)
        passage = np.concatenate([base[text] + first, (base[text] + second)[second != first]])
        terms = np.concatenate([term[known], term[known][second != first]])
        best: dict[tuple[int, int], tuple[float, float, float]] = {}
        for p in np.unique(passage) if exhaustive else self.hopeful(passage, terms, threshold):
            i = int(np.searchsorted(base, p, side="right")) - 1
            a = ptr[i] + (p - base[i]) * step
            b = min(ptr[i + 1], a + 2 * step)
            t = term[a:b]
            for d, score in self.search(np.unique(t[t >= 0]).tolist(), threshold):
                q, r = self.overlap(d, h[a:b])
                if q >= QUESTION and r >= ANSWER and (score, q, r) > best.get((i, d), (0, 0, 0)):
                    best[i, d] = (score, q, r)
        return [(i, self.ids[d], *x) for (i, d), x in sorted(best.items())]


def _indexes(items: DataFrame) -> Iterator[Index]:
    """The indexes of items (item_id, text): one, or one for each slice of each class of lengths, with statistics of all items."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, block in blocks(batches, "text"):
            _, ptr = normal_words(block)
            yield pa.RecordBatch.from_arrays([part.column("item_id"), part.column("text"), pa.array(np.diff(ptr), pa.int64())], ["item_id", "text", "n"])

    def worded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, block in blocks(batches, "text"):
            h, ptr = normal_words(block)
            words = [np.unique(h[a:b]) for a, b in zip(ptr[:-1], ptr[1:], strict=True)]
            keys = [part.column(c).take(pa.array(np.repeat(np.arange(len(words)), [len(w) for w in words]))) for c in ("class", "slice")]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(np.concatenate(words).view(np.int64))], ["class", "slice", "word"])

    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    sized = items.mapInArrow(counted, "item_id long, text string, n long").where("n > 0")
    kind = F.greatest(F.lit(0), F.ceil(F.log(F.col("n") / CLASS_WORDS) / float(np.log(CLASS_FACTOR)))).cast("int")
    slices = max(1, -(-int(size) // SLICE_BYTES))
    placed = sized.withColumn("class", kind).withColumn("slice", F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)).cast("int"))
    groups = placed.groupBy("class", "slice").agg(F.count("*").alias("items"), F.sum("n").alias("words"), F.max("n").alias("longest")).orderBy("class", "slice").collect()  # as many as indexes
    if len(groups) < 2:
        yield Index([(r.item_id, r.text) for r in placed.select("item_id", "text").collect()])
        return
    placed = materialize(placed)
    words = placed.select("class", "slice", "text").mapInArrow(worded, "class int, slice int, word long")
    table = materialize(words.distinct().join(words.groupBy("word").agg(F.count("*").alias("df")), "word"))
    n = sum(g["items"] for g in groups)
    mean = sum(g["words"] for g in groups) / n
    for g in groups:
        here = (F.col("class") == g["class"]) & (F.col("slice") == g["slice"])
        frequency = {r.word & (2**64 - 1): r.df for r in table.where(here).select("word", "df").collect()}
        longest = max([8, *[x["longest"] for x in groups if x["class"] == g["class"]]])
        yield Index([(r.item_id, r.text) for r in placed.where(here).select("item_id", "text").collect()], Statistics(n, mean, frequency, longest))
    release(placed, table)


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap: one row per document and item that it holds.

    Null or blank texts and items hold nothing; items without item_id are left out; documents without doc_id give rows
    with a null doc_id. Repeated documents each give their rows, repeated items one each. A text is read whole, passage by
    passage. The items are gathered on the driver by classes of length and in slices of about SLICE_BYTES, each of which makes
    one pass over the documents: benchmarks are small beside a corpus, so passes are few. Rows do not depend on the slices.
    """
    items = pick(benchmark, "item_id", "text").select(F.col("item_id").cast("long"), "text").where("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    source = pick(docs, "doc_id", "text")
    kind = source.schema["doc_id"].dataType.simpleString()
    found = None
    for index in _indexes(items):

        def searched(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for rows, block in blocks(batches, "text"):
                got = index.matches(block, threshold)
                ids = rows.column("doc_id").take(pa.array([x[0] for x in got], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array([x[1] for x in got], pa.int64()), *[pa.array([x[j] for x in got], pa.float64()) for j in (2, 3, 4)]], ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        hits = source.mapInArrow(searched, f"doc_id {kind}, item_id long, score double, question_overlap double, answer_overlap double")
        found = hits if found is None else found.union(hits)
    return found
