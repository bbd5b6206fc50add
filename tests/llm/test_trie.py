"""The trie against plain dictionaries, at limits that leave everything to the rounds, to quicksort, or to both."""

import collections
import hashlib
import random
import zlib

import pytest

from sparkloom.llm import queries, trie

SCHEMA = "conv_id long, turn long, role string, text string"


def ordered_plainly(rows):
    convs = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append(((turn is not None, turn or 0), role or "", text or ""))
    return {c: [x[1:] for x in sorted(xs)] for c, xs in convs.items()}


def rebuilt_plainly(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        out[c] = convs.get(base, [])[:h] + own[h:]
    return out


def nodes_plainly(convs):
    """Each node from its set of members."""
    members = collections.defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = collections.Counter(p[:-1] for p in members if p)
    total, leaves = collections.Counter(), collections.Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            total[p[:d]] += (len(m) - 1) * (len(p[-1][1].encode()) if p else 0)
            leaves[p[:d]] += not children[p]
    out = []
    for p, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(convs[c]) == len(p))))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], total[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda x: (x[1], x[0]))


def got(df):
    assert [f.dataType.simpleString() for f in df.schema][:7] == ["bigint"] * 7
    rows = df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()
    return sorted(map(tuple, rows), key=lambda x: (x[1], x[0]))


def some_conversations(rng, n):
    """Copies, shared beginnings, sequences that end inside others, long runs, and turns that differ in role only."""
    rows = []
    for c in range(n):
        kind = rng.randrange(6)
        if kind == 0:
            turns = [("user", "same"), ("assistant", "answer"), ("user", "é end")]
        elif kind == 1:
            turns = [("user" if i % 2 else "", f"long {i}") for i in range(rng.randrange(1, 40))]
        else:
            turns = [(rng.choice("ab"), rng.choice(["", "x", "yy", "ü"])) for _ in range(rng.randrange(1, 9))]
        rows += [(c * 3 - 20, i, r, t) for i, (r, t) in enumerate(turns)]
    return rows


@pytest.mark.parametrize("local,turns", [(4096, 1_000_000), (1, 1_000_000), (3, 1_000_000), (8, 60)])
def test_nodes_against_dictionaries(spark, local, turns):
    rng = random.Random(local)
    rows = some_conversations(rng, 90)
    rng.shuffle(rows)
    convs = ordered_plainly(rows)
    encoded = trie.encoded(spark.createDataFrame(rows, SCHEMA))
    assert got(trie.nodes(encoded, local, turns)) == nodes_plainly(convs)
    if local == 3:
        assert got(trie.nodes(queries.rebuilt(encoded), local, turns)) == nodes_plainly(rebuilt_plainly(convs))


def test_quicksort_of_random_sequences():
    rng = random.Random(7)
    for _ in range(200):
        seqs = list({(0, *[rng.randrange(3) for _ in range(rng.randrange(6))]) for _ in range(rng.randrange(1, 30))})
        found = set()
        for _, at, end, members, over in trie.branches(seqs, 0):
            for d in range(at, end):
                prefix = seqs[members[0]][: d + 1]
                assert prefix not in found and sorted(members) == [i for i, s in enumerate(seqs) if s[: d + 1] == prefix]
                found.add(prefix)
            assert (over is None) == (seqs[members[0]][:end] not in seqs) and (over is None or seqs[over] == seqs[members[0]][:end])
        assert found == {s[:d] for s in seqs for d in range(1, len(s) + 1)}


def test_many_copies_and_pieces(spark, monkeypatch):
    """A third of all conversations are equal: one sequence, whose members are hashed in many pieces."""
    monkeypatch.setattr(trie, "PIECE", 7)
    rows = [(c, 0, "user", "hot" if c % 3 else f"cold {c}") for c in range(3000)]
    convs = ordered_plainly(rows)
    assert got(trie.nodes(trie.encoded(spark.createDataFrame(rows, SCHEMA)), 50)) == nodes_plainly(convs)


def test_odd_rows(spark):
    """Null ids, turns, roles and texts, empty and long texts, tied and repeated turns, clashing columns, an empty table."""
    long = "w " * 200_000
    rows = [(None, 0, "u", "gone"), (0, None, None, None), (0, 1, "", ""), (0, None, "b", "a"), (5, 1, "u", long), (5, 1, "u", long), (5, 1, "u", "a"), (6, 3, "u", long), (-7, 0, None, "z"), (7, 2, "u", ""), (5, 1, "a", long)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA + ", extra string")
    want = ordered_plainly(rows)
    assert got(trie.nodes(trie.encoded(df))) == nodes_plainly(want)
    assert got(trie.nodes(queries.rebuilt(trie.encoded(df)), 1)) == nodes_plainly(rebuilt_plainly(want))
    assert got(trie.nodes(trie.encoded(df.limit(0)))) == []
