"""Personal data: four checked patterns, and a linear-chain conditional random field over word shapes that adds spans.

The field's tokens are runs of letters, runs of digits and single other characters.  It is trained here, in numpy, from
a small labelled table, and labels B/I per kind or outside; besides the patterns' kinds it knows secrets (keys, tokens,
passwords).  Every token of a text is read: it gets a shape, and features of the shapes around it.  A hard constraint of
the model, in training and decoding alike, says that a token farther than REACH tokens from any anchor is outside; an
anchor is a run of digits, ``@``, the mark of an access key, or ``at`` with a spelt or inner dot among the next REACH tokens, and no kind's check
passes without one.  Tokens that must be outside cut the chain, so the pieces between them are decoded on their own, all
in one Viterbi recursion, with the same result as one pass over the whole text.  A decoded span must pass its kind's
check and may not touch a span of the patterns.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .textcore import blocks, pick

KINDS = ["email", "ip", "card", "phone"]
ALL_KINDS = [*KINDS, "secret"]  #: those of the patterns, and one that only the field finds
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: An address without ``@``: the dot comes after ``at``, in its line, and ends no sentence (a blank on neither or on both sides).
AT = re.compile(r"\bat\b.*[^.\s](?:\.(?=[\w\])])|\s\.\s(?=\w)|\s?\bdot\b)", re.IGNORECASE)
HINT = re.compile(r"[0-9@]")
SECRET = re.compile(r"[A-Za-z0-9+/_-]{12,}")
REACH = 16  #: tokens on either side of an anchor that can belong to a span

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def valid(kind: str, text: str) -> bool:
    """The check of a kind."""
    digits = re.sub(r"[^0-9]", "", text)
    if kind == "ip":
        parts = re.findall("[0-9]+", text)
        parts = [p.lstrip("0") for p in parts]
        return len(parts) == 4 and all(len(p) <= 3 and int(p or "0") <= 255 for p in parts)
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 9 <= len(digits) <= 15
    if kind == "secret":
        return bool(SECRET.fullmatch(text)) and len(digits) < len(text) and (len(digits) >= 2 or len(text) >= 16 and text.isupper())
    if "@" in text:
        return bool(re.search(r"[^.\s]\s?(?:\.|\bdot\b)", text, re.I))
    return bool(AT.search(text))


def patterns(text: str) -> list[Span]:
    """The patterns' spans by kind as in KINDS, then start; leftmost and non-overlapping per kind, failing ones dropped."""
    if not HINT.search(text):
        return []
    out: list[Span] = []
    at, done = text.find("@"), 0
    while at >= 0:
        # all starts in one run of local characters agree on what follows, so only its first one is tried
        start = at
        while start > done and LOCAL.match(text, start - 1):
            start -= 1
        m = EMAIL.match(text, start) if start < at else None
        done = m.end() if m else at + 1
        if m:
            out.append(("email", m.start(), m.end()))
        at = text.find("@", done)
    for kind, pattern in (("ip", IP), ("card", CARD), ("phone", PHONE)):
        out += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if valid(kind, m.group())]
    return out


# The field

LABELS = ["O", *[f"{p}-{k}" for k in ALL_KINDS for p in "BI"]]
#: Words that are features of their own.
CUES = ["at", "dot", "com", "net", "org", "mail", "email", "phone", "tel", "call", "fax", "mobile", "card", "visa", "ip", "host", "server", "version", "token", "order", "id", "page", "year", "password", "secret", "key", "api", "commit", "pass", "pwd", "akia"]
MARKS = "@.+-()[]:/_=\"'#<>"
#: The shapes: text borders; letters by case and length; digits by length; marks; anything else.
SHAPES = ["^^", "^", "$", "$$", *[f"{c}{n}" for c in ("x", "X", "Xx") for n in range(1, 5)], *[f"d{n}" for n in range(1, 21)], *MARKS, "?", *CUES]
SHAPE = {s: i for i, s in enumerate(SHAPES)}
N = len(SHAPES)
#: Where the eight kinds of features begin: own shape; with glue on either side; the neighbours; pairs.
OFFSETS = np.cumsum([0, N, 4 * N, N, N, 2 * N * N, 2 * N * N, N * N, N * N])

_CUE_KEYS = np.array([int.from_bytes(c.encode(), "big") for c in CUES], np.uint64)
_CUE_ORDER = np.argsort(_CUE_KEYS)
_MARK_SHAPES = np.full(128, SHAPE["?"])
_MARK_SHAPES[[ord(c) for c in MARKS]] = [SHAPE[c] for c in MARKS]
#: By code point: 0 blank, 1 letter, 2 ASCII digit, 3 other; 4 lower case, 8 upper case; 255 not looked up yet.
_CLASSES = np.full(0x110000, 255, np.uint8)


def classes(codes: np.ndarray) -> np.ndarray:
    found = _CLASSES[codes]
    for u in np.unique(codes[found == 255]):
        c = chr(u)
        kind = 0 if c.isspace() else 2 if c in "0123456789" else 1 if c.isalnum() and not c.isdecimal() else 3
        _CLASSES[u] = kind + 4 * c.islower() + 8 * (c.isupper() or c.istitle())
    return _CLASSES[codes] if (found == 255).any() else found


@dataclass(frozen=True)
class Tokens:
    """The tokens of some texts, one after the other."""

    text: np.ndarray  #: number of its text
    start: np.ndarray  #: code points in its text
    end: np.ndarray
    shape: np.ndarray
    features: np.ndarray  #: [tokens, 8]
    free: np.ndarray  #: whether it may be inside a span


def _shapes(codes: np.ndarray, found: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    size, kind = end - start, found[start] & 3
    lower, upper = (np.concatenate([[0], np.cumsum((found & bit) > 0)]) for bit in (4, 8))
    low, up = lower[end] - lower[start], upper[end] - upper[start]
    case = np.where((up == 0) & (low > 0), 0, np.where((low == 0) & (up > 0), 1, 2))
    out = np.select([kind == 1, kind == 2], [SHAPE["x1"] + 4 * case + np.minimum(size, 4) - 1, SHAPE["d1"] + np.minimum(size, 20) - 1], _MARK_SHAPES[np.minimum(codes[start], 127)])
    out = np.where((kind == 3) & (codes[start] > 127), SHAPE["?"], out)
    short = np.flatnonzero((kind == 1) & (size <= 8))
    key = np.zeros(len(short), np.uint64)
    plain = np.ones(len(short), bool)
    for j in range(8):
        on = size[short] > j
        c = codes[np.minimum(start[short] + j, len(codes) - 1)]
        plain &= ~on | (c < 128)
        key = np.where(on, (key << np.uint64(8)) | ((c | 32) & 255).astype(np.uint64), key)
    at = np.minimum(np.searchsorted(_CUE_KEYS[_CUE_ORDER], key), len(CUES) - 1)
    hit = plain & (_CUE_KEYS[_CUE_ORDER][at] == key)
    out[short[hit]] = SHAPE[CUES[0]] + _CUE_ORDER[at[hit]]
    # a run of letters that begins with the mark of an access key
    long = np.flatnonzero((kind == 1) & (size > 4))
    out[long[np.all([codes[long_at] == ord(c) for long_at, c in zip([start[long] + j for j in range(4)], "AKIA", strict=True)], axis=0)]] = SHAPE["akia"]
    return out


def tokenize(texts: list[str]) -> Tokens:
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    found = classes(codes)
    kind = found & 3
    first = np.zeros(len(codes) + 1, bool)
    first[bounds] = True
    edge = first.copy()
    edge[:-1] |= (kind == 3) | (kind == 0)
    edge[1:-1] |= kind[1:] != kind[:-1]
    edges = np.flatnonzero(edge)
    inside = edges[:-1][kind[edges[:-1]] > 0] if len(codes) else np.zeros(0, np.int64)
    start, end = inside, edges[np.searchsorted(edges, inside, side="right")]
    text = np.searchsorted(bounds, start, side="right") - 1
    s = _shapes(codes, found, start, end)
    n = len(s)
    same = np.zeros(n + 1, bool)  # whether token i - 1 is in the text of token i
    same[1:n] = text[1:] == text[:-1]
    same2 = np.zeros(n + 2, bool)
    same2[2:n] = text[2:] == text[:-2]
    around = np.concatenate([[0, 0], s, [0, 0]])
    back, ahead = same[:n], same[1 : n + 1]
    s_1 = np.where(back, around[1 : n + 1], SHAPE["^"])
    s_2 = np.where(same2[:n], around[:n], np.where(back, SHAPE["^"], SHAPE["^^"]))
    s1 = np.where(ahead, around[3 : n + 3], SHAPE["$"])
    s2 = np.where(same2[2 : n + 2], around[4 : n + 4], np.where(ahead, SHAPE["$"], SHAPE["$$"]))
    touch = np.zeros(n + 1, bool)
    touch[1:n] = same[1:n] & (end[:-1] == start[1:])
    glued, glues = touch[:n].astype(np.int64), touch[1:].astype(np.int64)
    features = np.stack([s, s * 4 + glued * 2 + glues, s_1, s1, (s_1 * N + s) * 2 + glued, (s * N + s1) * 2 + glues, s_2 * N + s_1, s1 * N + s2], axis=1) + OFFSETS[:8]

    dot = (s == SHAPE["."]) & ((glues == 1) & (s1 != SHAPE["."]) | (glued == 0) & (glues == 0)) | (s == SHAPE["dot"])
    dots = np.concatenate([[0], np.cumsum(dot)])
    ends = np.searchsorted(text, text, side="right")  # one past the last token of each one's text
    ahead_to = np.minimum(np.arange(n) + REACH + 1, ends)
    anchor = (s >= SHAPE["d1"]) & (s <= SHAPE["d20"]) | (s == SHAPE["@"]) | (s == SHAPE["akia"]) | (s == SHAPE["at"]) & (dots[ahead_to] > dots[1:])
    at = np.flatnonzero(anchor)
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, np.maximum(at - REACH, np.searchsorted(text, text[at], side="left")), 1)
    np.add.at(change, np.minimum(at + REACH + 1, ends[at]), -1)
    return Tokens(text, start - bounds[text], end - bounds[text], s, features, np.cumsum(change)[:n] > 0)


@dataclass(frozen=True)
class Field:
    emit: np.ndarray  #: [features, labels]; zeros for what training never saw
    move: np.ndarray  #: [labels, labels]

    def emissions(self, features: np.ndarray) -> np.ndarray:
        return self.emit[features].sum(1)


def forbidden() -> np.ndarray:
    """Moves into I-k from anything but B-k or I-k."""
    out = np.zeros((len(LABELS), len(LABELS)), bool)
    for j, to in enumerate(LABELS):
        if to[0] == "I":
            out[:, j] = [x[2:] != to[2:] for x in LABELS]
    return out


def viterbi(emissions: list[np.ndarray], move: np.ndarray) -> list[np.ndarray]:
    """The best label path of each sequence, all in one numpy recursion; sequences are sorted by length inside."""
    order = sorted(range(len(emissions)), key=lambda i: -len(emissions[i]))
    lengths = np.array([len(emissions[i]) for i in order], np.int64)
    if not len(order) or not lengths[0]:
        return [np.zeros(0, np.int64) for _ in emissions]
    starts_inside = np.array([x[0] == "I" for x in LABELS])
    flat = np.concatenate([emissions[i] for i in order])
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    back = np.zeros(flat.shape, np.int8)
    best = flat[first[lengths > 0]] + np.where(starts_inside, -1e9, 0)
    best = np.concatenate([best, np.zeros((len(order) - len(best), len(LABELS)))])
    live = int((lengths > 0).sum())
    for t in range(1, int(lengths[0])):
        live = int(np.searchsorted(-lengths, -t, side="left"))
        step = best[:live, :, None] + move
        came = step.argmax(1)
        back[first[:live] + t] = came
        best[:live] = np.take_along_axis(step, came[:, None], 1)[:, 0] + flat[first[:live] + t]
    path = np.zeros(len(flat), np.int64)
    state = best.argmax(1)
    for t in range(int(lengths[0]) - 1, -1, -1):
        live = int(np.searchsorted(-lengths, -t, side="left"))
        path[first[:live] + t] = state[:live]
        if t:
            state[:live] = back[first[:live] + t, state[:live]]
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(emissions)
    for k, i in enumerate(order):
        out[i] = path[first[k] : first[k] + lengths[k]]
    return out


def labelled_table(copies: int = 8, seed: int = 5) -> list[tuple[str, list[Span]]]:
    """The default labelled table: sentences with marked values in several spellings, and look-alikes that are none."""
    rng = np.random.default_rng(seed)

    def digits(n: int) -> str:
        return "".join(map(str, rng.integers(0, 10, n)))

    def name() -> str:
        return "".join(chr(97 + i) for i in rng.integers(0, 26, int(rng.integers(3, 9))))

    def groups(*sizes: int, by: str) -> str:
        return by.join(digits(n) for n in sizes)

    def octets(by: str) -> str:
        return by.join(str(x) for x in rng.integers(1, 255, 4))

    def sha(n: int) -> str:
        while True:
            out = hashlib.sha1(rng.bytes(8)).hexdigest()[:n]
            if sum(c.isdigit() for c in out) >= 2 and not out.isdigit():
                return out

    makers = {
        "email": [lambda: f"{name()}@{name()}.com", lambda: f"{name()}.{digits(2)}@{name()}{digits(1)}.example.org", lambda: f"{name()} at {name()} dot com", lambda: f"{name()} [at] {name()} [dot] net", lambda: f"{name()}(at){name()}(dot)org", lambda: f"{name()} @ {name()} . com"],
        "ip": [lambda: octets("."), lambda: octets("[.]"), lambda: octets(" . "), lambda: octets("(.)")],
        "card": [lambda: digits(16), lambda: groups(4, 4, 4, 4, by=" "), lambda: groups(4, 4, 4, 4, by="-"), lambda: groups(4, 4, 4, 4, by="."), lambda: groups(4, 6, 5, by="/")],
        "phone": [lambda: f"+{digits(1)} ({digits(3)}) {groups(3, 4, by='-')}", lambda: f"+{groups(2, 3, 3, 4, by=' ')}", lambda: f"({digits(3)}) {groups(3, 4, by='-')}", lambda: groups(3, 3, 4, by="-"), lambda: groups(3, 3, 4, by=".")],
    }
    secrets = [lambda: ('token = "', sha(40), '"'), lambda: ("password=", sha(18), ""), lambda: ("password=", sha(18), ""), lambda: ("pwd: ", sha(16), ""), lambda: ("", "AKIA" + "".join(rng.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), 16)), ""), lambda: ("api_key: '", sha(32), "'"), lambda: ("secret = ", sha(24), ""), lambda: ("TOKEN = \"", sha(40).upper(), '"')]
    plain = [lambda: f"commit {sha(10)}", lambda: f"{sha(8)}-{sha(4)}", lambda: f"{name()}{sha(6)}", lambda: f"password {name()}", lambda: f"the token of {name()}", lambda: f"key = {name()}", lambda: f"version {groups(1, 1, 1, by='.')}", lambda: f"CC BY-NC {groups(1, 1, by='.')}", lambda: f"Version {groups(1, 1, by='.')}", lambda: groups(4, 2, 2, by="-"), lambda: groups(2, 2, by=":"), lambda: digits(int(rng.integers(1, 13))), lambda: f"{digits(2)}.{digits(2)}", lambda: f"{name()}{digits(2)}", lambda: f"page {digits(2)}", lambda: f"{digits(3)},{digits(3)}", lambda: f"at {name()}", lambda: f"the dot of {name()}", lambda: f"@{name()}", lambda: f"{groups(2, 2, 4, by='/')}", lambda: f"{groups(1, 2, 1, by='.')}"]
    out = []
    for _ in range(copies):
        for kind, spellings in [*makers.items(), (None, plain)]:
            for make in spellings:
                words = [name() for _ in range(int(rng.integers(0, 6)))]
                head = " ".join(words).capitalize() if rng.random() < 0.3 else " ".join(words)
                value = make()
                tail = ("" if rng.random() < 0.5 else str(rng.choice([".", ",", "###", "!!", "&&&"]))) + "".join(" " + name() for _ in range(int(rng.integers(0, 5))))
                text = f"{head} {value}{tail}".strip()
                start = text.index(value)
                out.append((text, [(kind, start, start + len(value))] if kind else []))
        for make in 4 * secrets:
            before, value, after = make()
            head = "".join(name() + str(rng.choice([" ", ". ", ", ", " ... "])) for _ in range(int(rng.integers(0, 5)))) + before
            out.append((head + value + after + str(rng.choice([" ", " ", ". ", "### ", "!! "])) + " ".join(name() for _ in range(int(rng.integers(0, 5)))), [("secret", len(head), len(head) + len(value))]))

    def case(word: str) -> str:
        return word.upper() if rng.random() < 0.1 else word.capitalize() if rng.random() < 0.2 else word

    # "at" with a plain dot, and sentences that have both and hold no address
    spelt = [" at ", " at ", " (at) ", " [at] ", "(at)", "[at]", " AT "]
    other = [lambda: f"{name()} at {name()}. {name().capitalize()} {name()}", lambda: f"{name()} at {name()}.", lambda: f"{name()} at {name()}, {name()} {name()}. {name().capitalize()}", lambda: f"{name()} (at {name()}). {name().capitalize()}", lambda: f"{name()} at {name()}.\n{name().capitalize()} {name()}", lambda: f"{name()}. At {name()} {name()}", lambda: f"{name()} at {name()} {name()}. {name().capitalize()} {name()} at {name()}."]
    for _ in range(copies):
        for at in spelt:
            local = case(name()) + (f".{name()}" if rng.random() < 0.2 else "")
            value = f"{local}{at}{case(name())}{f'.{name()}' if rng.random() < 0.2 else ''}.{rng.choice(['com', 'org', 'net', name()[:3]])}"
            head = "".join(case(name()) + str(rng.choice([" ", " ", ": ", ", ", ". "])) for _ in range(int(rng.integers(0, 5))))
            text = head + value + str(rng.choice(["", ".", ",", "!!"])) + "".join(" " + case(name()) for _ in range(int(rng.integers(0, 5))))
            out.append((text, [("email", len(head), len(head) + len(value))]))
        for make in other:
            out.append((" ".join(name() for _ in range(int(rng.integers(0, 5)))) + " " + make(), []))

    # ordinary prose, in which nothing is to be found
    def sentence() -> str:
        words = [str(rng.choice(["at", "the", "of", "dot", "in", name(), name(), name(), name(), "é" + name(), str(rng.integers(1, 3000))])) for _ in range(int(rng.integers(4, 14)))]
        words = [w.upper() + "!!" for w in words] if rng.random() < 0.1 else [w + str(rng.choice(["###", "%%%", " |", "$$$"])) for w in words] if rng.random() < 0.1 else words
        return " ".join(w + str(rng.choice(["", "", "", "", ",", ";"])) for w in words).capitalize() + str(rng.choice([".", ".", ".", "!", "?", ".\n"]))

    out += [(" ".join(sentence() for _ in range(int(rng.integers(1, 3)))), []) for _ in range(20 * copies)]
    return out


def summed(x: np.ndarray, step: np.ndarray) -> np.ndarray:
    """log(exp(x) @ step), row by row."""
    top = x.max(1, keepdims=True)
    return np.log(np.maximum(np.exp(x - top) @ step, 1e-300)) + top


def train(rows: list[tuple[str, list[Span]]], rounds: int = 120, ridge: float = 1e-3, rate: float = 0.3) -> Field:
    """Maximum likelihood with a ridge, by Adam on the exact gradient (forward and backward over all rows at once).

    Rows go from the longest to the shortest and their tokens stand by place, so that each step of a recursion is one run of
    tokens and nothing is filled up.
    """
    tokens, k = tokenize([text for text, _ in rows]), len(LABELS)
    length = np.bincount(tokens.text, minlength=len(rows))
    length[np.bincount(tokens.text[tokens.free], minlength=len(rows)) == 0] = 0  # rows without free tokens teach nothing
    order = np.argsort(-length, kind="stable")
    rank = np.argsort(order, kind="stable")
    n, ends = int((length > 0).sum()), np.sort(length)[::-1]
    place = np.arange(len(tokens.text)) - np.searchsorted(tokens.text, tokens.text)
    at = np.lexsort((rank[tokens.text], place))
    at = at[length[tokens.text[at]] > 0]
    place, row = place[at], rank[tokens.text[at]]
    live = np.bincount(place)
    first = np.concatenate([[0], np.cumsum(live)])
    run = [slice(first[t], first[t + 1]) for t in range(len(live))]
    after = np.flatnonzero(place > 0)
    before = first[place[after] - 1] + row[after]
    last = first[ends[:n] - 1] + np.arange(n)

    label = lambda i, a: next((LABELS.index(("B-" if a == s else "I-") + x) for x, s, e in rows[i][1] if s <= a < e), 0)
    y = np.array([label(i, a) for i, a in zip(tokens.text[at].tolist(), tokens.start[at].tolist(), strict=True)])
    held = np.where(tokens.free[at][:, None], 0.0, np.where(np.arange(k) > 0, -1e4, 0.0))  # tokens that must be outside
    seen, ids = np.unique(tokens.features[at], return_inverse=True)
    ids = ids.reshape(-1, 8)
    emit, move = np.zeros((len(seen), k)), np.zeros((k, k))
    barred = np.where(forbidden(), -1e4, 0.0)
    moments = [[np.zeros_like(emit), np.zeros_like(emit)], [np.zeros_like(move), np.zeros_like(move)]]
    one = np.eye(k)[y]
    pairs = one[before].T @ one[after]
    for r in range(1, rounds + 1):
        score = held + sum(emit[ids[:, j]] for j in range(8))
        step = np.exp(move + barred)
        a, b = score.copy(), np.zeros_like(score)
        for t in range(1, len(live)):
            a[run[t]] += summed(a[first[t - 1] : first[t - 1] + live[t]], step)
        for t in range(len(live) - 1, 0, -1):
            b[first[t - 1] : first[t - 1] + live[t]] = summed(score[run[t]] + b[run[t]], step.T)
        z = np.logaddexp.reduce(a[last], axis=1)[row][:, None]
        node = np.exp(np.clip(a + b - z, -50, 0))
        # of each neighbouring pair exp(a + move + score + b - z), all pairs summed as one product
        top = a[before].max(1, keepdims=True)
        edge = np.exp(a[before] - top).T @ np.exp(np.minimum((score + b - z)[after] + top, 700)) * step
        error = np.repeat(node - one, 8, axis=0)
        g_emit = np.stack([np.bincount(ids.ravel(), error[:, j], minlength=len(emit)) for j in range(k)], axis=1)
        grads = [g_emit / n + ridge * emit, (edge - pairs) / n + ridge * move]
        for value, g, (p, q) in zip((emit, move), grads, moments, strict=True):
            p += 0.1 * (g - p)
            q += 0.001 * (g * g - q)
            value -= rate * (p / (1 - 0.9**r)) / (np.sqrt(q / (1 - 0.999**r)) + 1e-8)
    weights = np.zeros((OFFSETS[8], k), np.float32)
    weights[seen] = emit
    return Field(weights, move + barred)


@functools.cache
def default_field() -> Field:
    return train(labelled_table())


def pieces(tokens: Tokens) -> list[tuple[int, int]]:
    """Runs of tokens of one text that may be inside a span."""
    at = np.flatnonzero(tokens.free)
    if not len(at):
        return []
    cut = np.flatnonzero((np.diff(at) > 1) | (np.diff(tokens.text[at]) > 0))
    return list(zip(at[np.concatenate([[0], cut + 1])].tolist(), (at[np.concatenate([cut, [len(at) - 1]])] + 1).tolist(), strict=True))


def decode(tokens: Tokens, field: Field) -> list[tuple[int, str, int, int]]:
    """Text, kind, first token and end token of each run that the best paths label."""
    parts = pieces(tokens)
    paths = viterbi([_piece(tokens, field, a, b) for a, b in parts], field.move)
    out = []
    for (first, _), path in zip(parts, paths, strict=True):
        t = 0
        while t < len(path):
            label = LABELS[path[t]]
            if label[0] != "B":
                t += 1
                continue
            end = t + 1
            while end < len(path) and LABELS[path[end]] == "I-" + label[2:]:
                end += 1
            out.append((int(tokens.text[first]), label[2:], first + t, first + end))
            t = end
    return out


def _piece(tokens: Tokens, field: Field, first: int, end: int) -> np.ndarray:
    """Emissions of a piece, with the moves from and to the tokens outside that stand around it."""
    score = field.emissions(tokens.features[first:end]).astype(np.float64)
    if first > 0 and tokens.text[first - 1] == tokens.text[first]:
        score[0] += field.move[0]
    if end < len(tokens.text) and tokens.text[end] == tokens.text[first]:
        score[-1] += field.move[:, 0]
    return score


def find(texts: list[str], field: Field) -> list[tuple[list[Span], list[Span]]]:
    """For each text the patterns' spans and the spans that the field adds, by kind as in ALL_KINDS, then start."""
    base = [patterns(t) for t in texts]
    added: list[list[Span]] = [[] for _ in texts]
    tokens = tokenize(texts)
    for i, kind, first, end in decode(tokens, field):
        a, b = int(tokens.start[first]), int(tokens.end[end - 1])
        if valid(kind, texts[i][a:b]) and not any(x < b and a < y for _, x, y in base[i]):
            added[i].append((kind, a, b))
    order = lambda s: (ALL_KINDS.index(s[0]), s[1])
    return [(b, sorted(set(x), key=order)) for b, x in zip(base, added, strict=True)]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact(text: str, spans: list[Span]) -> str:
    """text with each span replaced by its kind in angle brackets; of overlapping spans the union, by its first kind."""
    out, at = [], 0
    merged: list[list] = []
    for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], b)
        else:
            merged.append([k, a, b])
    for k, a, b in merged:
        out += [text[at:a], f"<{k}>"]
        at = b
    return "".join([*out, text[at:]])


def personal_data(docs: DataFrame, field: Field | None = None, clean: bool = False) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (the patterns' spans), base_sha256, spans (all), n_added (by the field), n_spans (all) for every row of docs.

    Places count code points, ends are exclusive. A null or empty text has no spans. Repeated rows each get their row;
    texts of any length are read whole. clean: also text, with all spans replaced by their kinds (null stays null).
    """
    field = field or default_field()
    source = pick(docs, "doc_id", "text")
    kind = source.schema["doc_id"].dataType.simpleString()

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _ in blocks(batches, "text"):
            texts = part.column("text").to_pylist()
            got = find([t or "" for t in texts], field)
            every = [sorted([*b, *x], key=lambda s: (ALL_KINDS.index(s[0]), s[1])) for b, x in got]
            columns = [part.column("doc_id"), *[pa.array([sum(s[0] == k for s in b) for b, _ in got], pa.int64()) for k in KINDS]]
            columns += [pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b, _ in got], pa.string()), pa.array([joined(s) for s in every], pa.string()), pa.array([len(x) for _, x in got], pa.int64()), pa.array([len(s) for s in every], pa.int64())]
            names = ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_added", "n_spans"]
            if clean:
                columns.append(pa.array([t if t is None else redact(t, s) for t, s in zip(texts, every, strict=True)], pa.string()))
                names.append("text")
            yield pa.RecordBatch.from_arrays(columns, names)

    return source.mapInArrow(searched, f"doc_id {kind}, {', '.join(f'n_{k} long' for k in KINDS)}, base_sha256 string, spans string, n_added long, n_spans long" + ", text string" * clean)


def redacted(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """docs (doc_id, text, lang, source, n_chars) with each span of text replaced by its kind; n_chars follows.

    Null texts stay null, rows without spans stay as they are, repeated rows too.
    """
    field = field or default_field()
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    source = pick(docs, *columns)

    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _ in blocks(batches, "text"):
            texts, counts = part.column("text").to_pylist(), part.column("n_chars").to_pylist()
            spans = [[*b, *x] for b, x in find([t or "" for t in texts], field)]
            new = [redact(t, s) if s else t for t, s in zip(texts, spans, strict=True)]
            counts = [len(t) if s else n for t, s, n in zip(new, spans, counts, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(new, pa.string()), part.column("lang"), part.column("source"), pa.array(counts, part.column("n_chars").type)], columns)

    return source.mapInArrow(cleaned, source.schema)
