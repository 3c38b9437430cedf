"""Tries of conversation prefixes against a plain reading of the same rows."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest

from chronotape.llm import prefix_trie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def brute(rows, every=100, most=6):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", text or ""))
    plain = {c: [t[2:] for t in sorted(v)] for c, v in turns.items()}
    paths = {}
    for c, own in plain.items():
        h = zlib.crc32(str(c).encode()) % most
        head = c - (c % every if c >= 0 else -(-c % every))
        paths[c] = tuple(plain.get(head, [])[:h] + own[h:])
    members = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    out = {}
    leaves, saved, children = Counter(), Counter(), Counter()
    for path in members:
        if path:
            children[path[:-1]] += 1
    for path, ids in members.items():
        own = (len(ids) - 1) * len(path[-1][1]) if path else 0
        for d in range(len(path) + 1):
            saved[path[:d]] += own
            leaves[path[:d]] += not children[path]
    for path, ids in members.items():
        ends = ",".join(str(c) for c in sorted(ids) if paths[c] == path)
        out[min(ids), len(path)] = (
            min(members[path[:-1]]) if path else None, len(ids), children[path], leaves[path], saved[path],
            hashlib.sha256(ends.encode()).hexdigest(),
        )
    return Counter((*key, *value) for key, value in out.items())


def trie(df):
    turns, members = prefix_trie.rebuilt(prefix_trie.numbered_turns(df), 100, 6)
    return Counter(tuple(r[c] for c in COLUMNS) for r in prefix_trie.trie(turns, members).collect())


def some_rows(seed, count, longest, texts):
    rng = random.Random(seed)
    rows = []
    for c in range(count):
        for turn in range(rng.randint(0, longest)):
            rows.append((c, turn, rng.choice(["user", "assistant"]), rng.choice(texts)))
    return rows


ODD = [
    (-205, 1, "user", "minus"), (-205, 2, None, None), (-200, 1, "user", "head"), (300, None, "user", "no turn"),
    (300, 0, "user", "no turn"), (300, 0, "user", "no turn"), (301, 5, None, "é😀"), (302, 5, "", "é😀"), (303, 1, "user", ""),
    (None, 1, "user", "nobody"), (7_000_000_000, 1, "a" * 500, "long " * 5000), (304, 1, "x", "y"), (304, 1, "x", "y"), (304, 1, "w", "y"),
]


def test_trie(spark):
    rows = some_rows(1, 130, 7, ["a", "b", "ccc", "é"]) + ODD
    assert trie(spark.createDataFrame(rows, SCHEMA).repartition(3)) == brute(rows)


def test_copies_over_many_small_trees(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "TREE_ROWS", 7)
    monkeypatch.setattr(prefix_trie, "PART_IDS", 3)
    rows = some_rows(2, 60, 5, ["a", "b"])
    rows += [(1000 + i, t, "user", f"copy {t}") for i in range(120) for t in range(4)]
    assert trie(spark.createDataFrame(rows, SCHEMA).repartition(5)) == brute(rows)


@pytest.mark.parametrize("band", [1, 3])
def test_bands(spark, monkeypatch, band):
    monkeypatch.setattr(prefix_trie, "BAND", band)
    monkeypatch.setattr(prefix_trie, "TREE_ROWS", 9)
    rows = some_rows(3, 40, 6, ["a", "b"]) + [(1000 + i, t, "user", "same") for i in range(30) for t in range(6 + i % 3)]
    assert trie(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_empty_and_clashing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert not trie(empty)
    rows = some_rows(4, 20, 4, ["a", "b"])
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as place", "'x' as id", "2 as one", "3 as size", "4 as head", "5 as part", "6 as has_turn")
    assert trie(df) == brute(rows)


def test_balanced_trees():
    tree = prefix_trie.Ternary()
    for i in prefix_trie.medians(1023):
        tree.insert([i], [0], 1, i)

    def height(at):
        return 0 if at < 0 else 1 + max(height(tree.low[at]), height(tree.high[at]))

    assert height(tree.top) == 10
