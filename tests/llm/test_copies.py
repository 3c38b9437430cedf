"""Exact copies, near copies and repeated passages against plain readings of the same rows."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

from chronotape.llm import exact_dedup, jaccard_join, substring_dedup

SPACE = re.compile(r"[\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def last_id(i):
    return (i is None, i or 0)


def collected(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


def exact_brute(rows):
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[SPACE.sub("", t or "")].append((-len(t or ""), last_id(i), i))
    out = Counter()
    for bare, members in groups.items():
        members.sort(key=lambda m: m[:2])
        for n, (_, _, i) in enumerate(members):
            out[i, members[0][2], len(members), n == 0, hashlib.sha256(bare.encode()).hexdigest()] += 1
    return out


def test_exact_copies(table, odd_rows):
    got = collected(exact_dedup.decisions(table(odd_rows)), "doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert got == exact_brute(odd_rows)


def test_exact_copies_many_runs(table):
    rows = [(i, "same text" if i % 3 else f"text {i}", "en", "a") for i in range(300)]
    got = collected(exact_dedup.decisions(table(rows, 70)), "doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert got == exact_brute(rows)


def test_deduplicate_keeps_whole_rows(table, odd_rows, clashing):
    docs = clashing(table(odd_rows))
    out = exact_dedup.deduplicate(docs)
    assert out.columns == docs.columns
    want = Counter((k[0], k[4]) for k in exact_brute(odd_rows).elements() if k[3])
    got = Counter((r["doc_id"], hashlib.sha256(SPACE.sub("", r["text"] or "").encode()).hexdigest()) for r in out.collect())
    assert got == want


def test_empty_tables(table, spark):
    empty = table([])
    assert exact_dedup.decisions(empty).count() == 0
    assert exact_dedup.deduplicate(empty).count() == 0
    assert jaccard_join.near_copies(empty).count() == 0
    assert jaccard_join.one_of_each(empty).count() == 0
    assert substring_dedup.repeats(empty).count() == 0
    assert substring_dedup.without_repeats(empty).count() == 0


def shingles(text, n=5):
    words = WORD.findall(text or "")
    if len(words) < n:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def near_brute(rows, threshold=0.8):
    sets = [shingles(t) for _, t, *_ in rows]
    parent, links = list(range(len(rows))), [0] * len(rows)

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and len(a & b) >= threshold * len(a | b) - 1e-9:
            links[i] += 1
            links[j] += 1
            parent[root(i)] = root(j)
    heads = {}
    for i, row in enumerate(rows):
        heads[root(i)] = min(heads.get(root(i), (True, 0)), last_id(row[0]))
    named = lambda head: None if head[0] else head[1]
    return Counter((row[0], named(heads[root(i)]), links[i]) for i, row in enumerate(rows))


def perturbed(rng, words, changes):
    out = list(words)
    for _ in range(changes):
        out[rng.randrange(len(out))] = f"w{rng.randrange(10**6)}"
    return " ".join(out)


def near_rows():
    rng = random.Random(3)
    rows, n = [], itertools.count()
    for size in (60, 150, 400):
        for _ in range(6):
            base = [f"v{rng.randrange(3000)}" for _ in range(size)]
            for changes in (0, 1, 1, 2, 3, 4, 6, 9):
                rows.append((next(n), perturbed(rng, base, changes), "en", "a"))
    shared = " ".join(f"s{i}" for i in range(30))
    rows += [(next(n), shared + " " + perturbed(rng, [f"u{rng.randrange(5000)}" for _ in range(60)], 0), "en", "a") for _ in range(60)]
    return rows


def test_near_copies(table, odd_rows):
    rows = odd_rows + [(1000 + i, *r) for i, *r in near_rows()]
    assert collected(jaccard_join.near_copies(table(rows)), "doc_id", "class_id", "n_links") == near_brute(rows)


def test_near_copies_in_blocks(table, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_DOCUMENTS", 5)
    rng = random.Random(9)
    base = [f"v{i}" for i in range(200)]
    rows = near_rows() + [(5000 + i, perturbed(rng, base, rng.randint(0, 4)), "en", "a") for i in range(40)]
    assert collected(jaccard_join.near_copies(table(rows)), "doc_id", "class_id", "n_links") == near_brute(rows)


def test_one_of_each_class_stays(table, odd_rows, clashing):
    docs = clashing(table(odd_rows))
    out = jaccard_join.one_of_each(docs)
    assert out.columns == docs.columns
    classes = {(i, c) for (i, c, _) in near_brute(odd_rows)}
    blank = Counter(i for i, t, *_ in odd_rows if not shingles(t))
    texts = Counter(r["doc_id"] for r in out.collect() if shingles(r["text"]))
    assert Counter(r["doc_id"] for r in out.collect() if not shingles(r["text"])) == blank
    heads = {c for i, c in classes if i not in blank or i is None} - {c for c in blank if c is not None}
    assert {i for i in texts if i is not None} == {h for h in heads if h is not None}
    assert all(n == 1 for n in texts.values())


def test_pruning_keeps_what_can_reach_the_threshold():
    steps = jaccard_join.least_matches(0.8, 1e-6)
    assert [n for n, _ in steps] == list(range(16, 129, 16))
    for n, least in steps:
        assert 0 <= least < 0.8 * n
    rng = random.Random(1)
    base = [f"v{i}" for i in range(1000)]
    import numpy as np

    sets = [np.unique(np.array([hash(x) & (2**63 - 1) for x in shingles(perturbed(rng, base, k))], np.uint64)) for k in (0, 20, 20, 300)]
    signs, sizes = np.stack([jaccard_join.minhash(s) for s in sets]), np.array([len(s) for s in sets])
    left, right = np.triu_indices(4, 1)
    alive = jaccard_join.plausible(signs, sizes, left, right, 0.8, steps)
    kept = {(int(left[i]), int(right[i])) for i in alive}
    assert {(0, 1), (0, 2)} <= kept
    assert not any(3 in p for p in kept)


def passages_brute(rows, window):
    found = Counter()
    for _, t, *_ in rows:
        w = WORD.findall(t or "")
        found.update(tuple(w[i : i + window]) for i in range(len(w) - window + 1))
    out = Counter()
    for i, t, *_ in rows:
        w = WORD.findall(t or "")
        gone = set()
        for s in range(len(w) - window + 1):
            if found[tuple(w[s : s + window])] > 1:
                gone.update(range(s, s + window))
        kept = " ".join(x for n, x in enumerate(w) if n not in gone)
        out[i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    return out


def passage_rows():
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(4000)}"
    passages = [[word() for _ in range(n)] for n in (8, 20, 34, 35, 36, 60, 140)]
    rows = []
    for i in range(120):
        words = [word() for _ in range(rng.randrange(120))]
        for _ in range(rng.randrange(3)):
            p, at = rng.choice(passages), rng.randrange(len(words) + 1)
            begin = rng.randrange(max(1, len(p) // 3))
            words[at:at] = p[begin:]
        rows.append((i, rng.choice([" ", "\n"]).join(words), "en", "a"))
    rows.append((500, " ".join(["a"] * 200), "en", "a"))
    rows.append((501, " ".join(["a", "b"] * 100 + ["c"] * 30), "en", "a"))
    rows.append((502, " ".join([f"q{i}" for i in range(40)] * 2), "en", "a"))
    return rows


def test_passages(table, odd_rows):
    rows = odd_rows + passage_rows()
    for window in (35, 12, 5):
        got = collected(substring_dedup.repeats(table(rows), window), "doc_id", "n_words", "n_removed", "kept_sha256")
        assert got == passages_brute(rows, window), window


def test_levels_double():
    for window in (1, 5, 9, 10, 35, 50, 200):
        sizes = substring_dedup.levels(window)
        assert sizes[-1] == window
        assert all(a < b <= 2 * a for a, b in zip(sizes, sizes[1:], strict=False))


def test_texts_without_repeats(table, odd_rows, clashing):
    rows = odd_rows + passage_rows()
    docs = clashing(table(rows))
    out = substring_dedup.without_repeats(docs)
    assert out.columns == docs.columns
    want = passages_brute(rows, 35)
    got = Counter((r["doc_id"], hashlib.sha256(" ".join(WORD.findall(r["text"] or "")).encode()).hexdigest()) for r in out.collect())
    assert got == Counter({(k[0], k[3]): 0 for k in want}) + Counter((k[0], k[3]) for k in want.elements())
