"""Encoding, counts and packing against the tokenizer library and plain packing."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from chronotape.llm import byte_bpe, token_counts, token_packing

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def ranks(spark):
    return byte_bpe.Ranks(PATH)


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks.ranks, special_tokens={})


def tricky(rows):
    texts = [
        "It's we'll they'RE 1234 ½ ⅷ  two  spaces\n\n\n and\ttabs\r\n", "naïve café wide　日本語テキスト 한국어", "🙂🙂 👩‍👩‍👧 é",
        "<|endoftext|> is text", "a" * 300, " " * 300 + "x", "\n" * 200, "ab" * 90 + " " + "!?" * 100, "   \u0085 ​ \x1c\x1d",
        "Erreth ofretihaou ouan\x00nul", "'s 't 're 've 'm 'll 'd '", "x " * 50 + " ", "ÀÉÎõü ßẞ ǅ ʰ ª",
    ]
    return rows + [(700 + i, t, "en", "a") for i, t in enumerate(texts)]


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def test_encoding_equals_the_library(table, odd_rows, ranks, library, clashing):
    rows = tricky(odd_rows)
    docs = clashing(table(rows))
    encoded = byte_bpe.encode(docs, ranks, PATTERN)
    column = encoded.columns[-1]
    assert encoded.columns[:-1] == docs.columns
    got = Counter(tuple(r) for r in byte_bpe.digests(encoded, ranks, column).collect())
    want = Counter()
    for i, t, *_ in rows:
        ids = library.encode_ordinary(t or "")
        want[i, len(ids), sha(" ".join(map(str, ids)).encode()), sha((t or "").encode())] += 1
    assert got == want


def test_every_fold_equals_the_library(spark, ranks, library):
    from pyspark.sql import functions as F

    rng = random.Random(6)
    letters = "abcdefghijklmnopqrstuvwxyzéüß日 '-\n"
    words = {w for _ in range(40) for w in __import__("regex").findall(PATTERN, "".join(rng.choice(letters) for _ in range(300)))}
    rows = spark.createDataFrame([(w,) for w in sorted(words)], "word string")
    folded = byte_bpe.bound(ranks.pairs[0], lambda t: byte_bpe.folded(F.col("word"), t, ranks))
    out = rows.select("word", folded.alias("letters")).collect()
    assert len(out) > 500
    assert all(list(map(byte_bpe.rank_of, r["letters"])) == library.encode_ordinary(r["word"]) for r in out)


def test_blocks_of_long_and_rare_words(table, ranks, library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "PART_ROWS", 3)
    monkeypatch.setattr(byte_bpe, "HELD_WORDS", 20)
    rng = random.Random(6)
    letters = "abcdefghijklmnopqrstuvwxyzéüß日 '-\n"
    rows = [(i, "".join(rng.choice(letters) for _ in range(400)) + " " + "xyz" * i * 20, "en", "a") for i in range(20)] * 2
    out = byte_bpe.encode(table(rows, 7), ranks, PATTERN).select("text", "ids").collect()
    assert len(out) == 40
    assert all(r["ids"] == library.encode_ordinary(r["text"]) for r in out)


def test_pieces_have_the_matches_of_their_text():
    import regex

    rng, split = random.Random(8), regex.compile(PATTERN).findall
    pieces, parts = byte_bpe.cuts(PATTERN)
    texts = ["".join(rng.choice("ab1.' \n\t\u00a0\u3000\x1cé日'sll") for _ in range(rng.randint(0, 12))) for _ in range(4000)]
    texts += [" ".join(rng.choice(["a", "b's", "1,", "\x1c", "\n", "''t", "x\ny", "", "é日"]) for _ in range(6)) for _ in range(4000)]
    for text in texts:
        assert [w for p in pieces(text) for w in parts(p)] == split(text), text
    held = {p for t in texts for p in pieces(t)}
    assert byte_bpe.matches(held, PATTERN, split) == {w for t in texts for w in split(t)}


def test_packs_of_words():
    words = ["a", " é", "\n\n", "\x00", "日" * 40, "😀"]
    assert byte_bpe.unpacked(byte_bpe.packed(words)) == words


def test_words_travel_as_packs(spark, tmp_path, ranks, library):
    """The exchanges carry a row per block and bucket and a row per part of a block, not one per word."""
    rng = random.Random(9)
    texts = [" ".join("".join(rng.choice("abcdeé") for _ in range(9)) for _ in range(400)) for _ in range(40)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(2).write.parquet(str(tmp_path / "docs"))
    docs, buckets = spark.read.parquet(str(tmp_path / "docs")), 5
    packs = byte_bpe.block_words(docs, ranks, PATTERN, buckets)
    rows = byte_bpe.folded_words(packs, ranks, buckets).collect()
    assert len(rows) <= buckets * docs.rdd.getNumPartitions()
    table = byte_bpe.Words(ranks.ranks, byte_bpe.cuts(PATTERN)[1])
    for r in rows:
        table.learn(r["words"], r["ids"])
    assert len(table) > 10_000
    assert all(np.frombuffer(ids, np.int32).tolist() == library.encode_ordinary(w) for w, ids in table.items())


def test_blocks_are_cut_by_the_order_of_rows_alone():
    import pyarrow as pa

    texts = ["x" * n for n in (5, 0, 9 << 20, 3, 8 << 20, 1)] + [None, "é" * (5 << 20), "end"]
    rows = pa.RecordBatch.from_arrays([pa.array([7] * len(texts), pa.int32()), pa.array(texts, pa.string())], names=["part", "text"])
    numbers = []
    for step in (1, 2, 4, 20):
        batches = iter([rows.slice(i, step) for i in range(0, len(texts), step)])
        numbers.append([n for n, some in byte_bpe.blocks(batches, 1) for _ in range(some.num_rows)])
    assert numbers[0] == [(7 << 32) + k for k in (0, 0, 0, 1, 1, 2, 2, 2, 3)]
    assert all(n == numbers[0] for n in numbers)


def test_texts_of_several_blocks(table, ranks, library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "BLOCK_BYTES", 1500)
    rng = random.Random(10)
    rows = [(i, " ".join("".join(rng.choice("abcdeé\n") for _ in range(7)) for _ in range(rng.randint(0, 200))), "en", "a") for i in range(60)]
    out = byte_bpe.encode(table(rows), ranks, PATTERN).select("text", "ids").collect()
    assert len(out) == 60 and all(r["ids"] == library.encode_ordinary(r["text"]) for r in out)


def test_another_pattern(table):
    letters = r"\p{L}|\P{L}+"
    known = byte_bpe.Ranks(PATH)
    library = tiktoken.Encoding("own", pat_str=letters, mergeable_ranks=known.ranks, special_tokens={})
    out = byte_bpe.encode(table([(i, "some words é  1 \n x" * i, "en", "a") for i in range(5)]), known, letters).select("text", "ids").collect()
    assert len(out) == 5 and all(r["ids"] == library.encode_ordinary(r["text"]) for r in out)


def test_decoding_beside_a_column_decoded(table, ranks):
    docs = table([(1, "one é", "en", "a"), (2, None, "en", "a"), (2, None, "en", "a")]).selectExpr("*", "'kept' as decoded", "1 as ids")
    out = byte_bpe.decode(byte_bpe.encode(docs, ranks, PATTERN), ranks, "_ids")
    rows = Counter((r["doc_id"], r["decoded"], bytes(r["_decoded"])) for r in out.collect())
    assert rows == {(1, "kept", "one é".encode()): 1, (2, "kept", b""): 2}


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("abcdeinorst é日!  \n"), min_size=1, max_size=60))
def test_heap_equals_the_library(text):
    known = test_heap_equals_the_library.__dict__.setdefault("known", byte_bpe_ranks())
    library = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=known, special_tokens={})
    assert byte_bpe.heap_merged(text.encode(), known) == library.encode_ordinary(text)


def byte_bpe_ranks():
    import base64

    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}


def test_empty_encoding(table, ranks):
    assert byte_bpe.encode(table([]), ranks, PATTERN).count() == 0


def test_histogram_answers_every_limit(spark):
    rng = random.Random(4)
    lengths = [rng.choice([0, 1, 2, 3, 10, 50, 51, 400, 401, 5000]) for _ in range(500)]
    rows = spark.createDataFrame([(n,) for n in lengths] + [(None,)], "n_tokens bigint")
    lengths.append(0)
    counts = token_counts.histogram(rows).cache()
    got = {r["n_tokens"]: r for r in counts.collect()}
    assert set(got) == set(lengths)
    for n, r in got.items():
        assert r["documents"] == lengths.count(n)
        assert r["tokens"] == n * lengths.count(n)
        assert r["documents_longer"] == sum(x > n for x in lengths)
        assert r["tokens_longer"] == sum(x for x in lengths if x > n)
        assert r["documents_shorter"] == sum(x < n for x in lengths)
        assert r["tokens_shorter"] == sum(x for x in lengths if x < n)
        assert r["truncated_total"] == sum(min(x, n) for x in lengths)
        assert abs(r["quantile"] - sum(x <= n for x in lengths) / len(lengths)) < 1e-12
    for limit in (1, 7, 50, 399, 10_000):
        assert token_counts.truncated_total(counts, limit) == sum(min(x, limit) for x in lengths)
    for share in (0.1, 0.5, 0.99, 1.0):
        want = sorted(lengths)[max(0, int(np.ceil(share * len(lengths))) - 1)]
        assert token_counts.quantile(counts, share) == want
    counts.unpersist()
    assert token_counts.histogram(spark.createDataFrame([], "n_tokens bigint")).count() == 0


def plain_best_fit(counts, capacity):
    rows = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fits = [s for s in rows if s >= length]
            if fits:
                rows.remove(min(fits))
                rows.append(min(fits) - length)
            else:
                rows.append(capacity - length)
    return sorted(rows)


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=20))
def test_plan_is_best_fit_decreasing(counts):
    plan, rows = token_packing.best_fit_decreasing(counts, 40)
    space = [40] * rows
    ranks = {n: [] for n in counts}
    for length, rank, count, row, each, offset in plan:
        for k in range(count):
            ranks[length].append(rank + k)
            assert offset + k % each * length == 40 - space[row + k // each]
            space[row + k // each] -= length
    assert all(sorted(r) == list(range(counts[n])) for n, r in ranks.items())
    assert min(space, default=0) >= 0
    assert sorted(space) == plain_best_fit(counts, 40)


def test_packing_round_trip(table, odd_rows, library):
    rows = tricky(odd_rows)
    encoded = token_packing.coded(table(rows), token_packing.rank_encoder(byte_bpe_ranks(), PATTERN))
    out = token_packing.pack(encoded, 256, 50256).collect()
    assert sorted(r["row"] for r in out) == list(range(len(out)))
    segments = []
    for r in out:
        ids, positions = np.frombuffer(r["ids"], np.uint16), np.frombuffer(r["positions"], np.uint16)
        assert len(ids) == len(positions) == 256
        assert r["lengths"][0] == 0 and r["lengths"][-1] == r["n_tokens"] <= 256
        for k, (i, piece) in enumerate(zip(r["doc_ids"], r["pieces"], strict=True)):
            begin, end = r["lengths"][k], r["lengths"][k + 1]
            assert positions[begin:end].tolist() == list(range(end - begin))
            segments.append((i, piece, ids[begin:end].tolist()))
        assert (ids[r["n_tokens"] :] == 50256).all() and not positions[r["n_tokens"] :].any()
    want = Counter()
    for i, t, *_ in rows:
        ids = [*library.encode_ordinary(t or ""), 50256]
        for p in range(0, len(ids), 256):
            want[i, p // 256, tuple(ids[p : p + 256])] += 1
    assert Counter((i, p, tuple(x)) for i, p, x in segments) == want
    # What best fit leaves open: no two rows of the last could be one.
    assert sum(r["n_tokens"] <= 128 for r in out) <= 1


def test_packing_nothing(table):
    encoded = token_packing.coded(table([]), token_packing.rank_encoder(byte_bpe_ranks(), PATTERN))
    assert token_packing.pack(encoded, 256, 50256).count() == 0
