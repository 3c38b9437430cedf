"""The dual-tree search against scores of every item and every document."""

import math
import random
import re
from collections import Counter

import pytest

from chronotape.llm import lexical_search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(rows, items, k):
    docs = [(i, Counter(terms(t))) for i, t, *_ in rows]
    docs = [(i, c) for i, c in docs if c]
    n, length = len(docs), sum(c.total() for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = Counter()
    for item_id, text in items:
        found = []
        for i, c in docs:
            m = 75 + (25 * c.total() * n) // length
            score = 0
            for t in terms(text):
                if t in c:
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m))
            if score > 0:
                found.append((-score, i is None, i or 0))
        out.update((item_id, rank, None if null else i, -s) for rank, (s, null, i) in enumerate(sorted(found)[:k], 1))
    return out


def got(docs, items, k):
    return Counter((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in lexical_search.search(docs, items, k).collect())


ITEMS = [(1, "a b c"), (2, None), (None, "aA Aa a"), (3, ""), (4, "zzz-unseen"), (5, "a b c"), (5, "a b c"), (6, "😀 é wide"), (7, "!?")]


def test_odd_rows(spark, table, odd_rows, clashing):
    items = [*ITEMS, (8, odd_rows[4][1]), (9, odd_rows[8][1]), *[(20 + i, odd_rows[20 + i][1][:80]) for i in range(30)]]
    asked = spark.createDataFrame(items, "item_id bigint, text string")
    for k in (1, 20):
        assert got(clashing(table(odd_rows)), asked.selectExpr("*", "1 as item", "2 as size"), k) == brute(odd_rows, items, k)


def test_blocks_ties_and_deep_trees(spark, table, monkeypatch):
    monkeypatch.setattr(lexical_search, "BLOCK_TERMS", 40)
    monkeypatch.setattr(lexical_search, "TREE_POSTINGS", 3000)
    rng = random.Random(3)
    words = [f"w{i}" for i in range(120)]
    pick = lambda n: " ".join(words[min(119, int(rng.expovariate(1 / 25)))] for _ in range(n))
    rows = [(i, pick(rng.randint(1, 60)), "en", "a") for i in range(1500)]
    rows += [(5000 + i, rows[7][1], "en", "a") for i in range(400)]
    items = [(i, pick(rng.randint(1, 25))) for i in range(25)] + [(99, rows[7][1])]
    assert got(table(rows), spark.createDataFrame(items, "item_id bigint, text string"), 20) == brute(rows, items, 20)


def test_empty_tables(spark, table):
    asked = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    assert not got(table([]), asked, 20)
    assert not got(table([(1, "a b", "en", "a")]), asked.limit(0), 20)
    assert lexical_search.search(table([]), asked).columns == lexical_search.search(table([]), asked.limit(0)).columns


def test_long_texts_in_chunks(monkeypatch):
    text = ("ab cd-Ef é9 " * 500 + "x" * 3000 + " end").encode()
    whole = lexical_search.terms_of(text)
    monkeypatch.setattr(lexical_search, "CHUNK_BYTES", 64)
    assert lexical_search.terms_of(text) == whole == Counter(w.encode() for w in terms(text.decode()))


def test_pairs_are_pruned(monkeypatch):
    """A passage that a few neighbours share leaves most leaves unscored."""
    import numpy as np

    rng = np.random.default_rng(1)
    count, width = 6400, 400
    lists = [np.unique(rng.integers(4 * (i // 100), 4 * (i // 100) + 40, 20)) % width for i in range(count)]
    begins = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
    flat = np.concatenate(lists).astype(np.int64)
    tree = lexical_search.Documents(np.arange(count), list(range(count)), begins, flat, rng.integers(1, 1000, len(flat)), width)
    weights = np.zeros((12, width), np.int64)
    for i in range(12):
        weights[i, rng.integers(0, 40, 10) + 30 * i] = 1000
    scored = []
    sums = lexical_search.row_sums
    monkeypatch.setattr(lexical_search, "row_sums", lambda b, w, t, v, q: (scored.append(len(w) if b is tree.begins else 0), sums(b, w, t, v, q))[1])
    best = lexical_search.Best(12, 5)
    lexical_search.search_tree(lexical_search.Items(weights), tree, best)
    assert sum(scored) < 12 * count / 3
    for i in range(12):
        all_scores = sorted((-int(s), r) for r, s in enumerate(sums(begins, np.arange(count), flat, tree.values, weights[i])) if s > 0)[:5]
        assert [(s, r) for s, _, _, r in best.found[i]] == all_scores


@pytest.mark.parametrize("text", ["A_b-c9", "ÀÉ", "日本 語x", "\x7fa\x80b", ""])
def test_terms(text):
    assert lexical_search.terms_of(text.encode()) == Counter(w.encode() for w in terms(text))
