"""Text: normalisation, learned pieces, round trips."""

import unicodedata
from collections import Counter

import duckdb
from pyspark.sql import functions as F

from chronotape.functions.text import normalized
from chronotape.operators import subwords as sx


def plain(text):
    return " ".join(unicodedata.normalize("NFKC", text).split()).casefold() or None


def test_normalisation_of_whole_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = {r["doc_id"]: r["normalized"] for r in normalized(df, "text").collect()}
    rows = duckdb.sql("select doc_id, text from '/root/testdata/sf0.001/documents.parquet'").fetchall()
    assert any(not t.isascii() for _, t in rows)
    assert got == {i: plain(t) for i, t in rows}


def test_normalisation_edges(spark):
    texts = ["ＡＢＣ　ﬁ", "Straße x", "  ", "", None, "A\tB\n C", "\x1cq\x1f"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {r["i"]: r["normalized"] for r in normalized(df, "text").collect()}
    assert got == {i: None if t is None else plain(t) for i, t in enumerate(texts)}


def merge_by_merge(words, merges):
    """One merge at a time, every pair counted again."""
    state = {w: list(w) for w in words}
    learned = []
    for _ in range(merges):
        counts = Counter()
        for w, n in words.items():
            for pair in zip(state[w], state[w][1:]):
                counts[pair] += n
        counts = {p: n for p, n in counts.items() if n >= 2}
        if not counts:
            break
        best = min(counts, key=lambda p: (-counts[p], p[0] + p[1], p[0]))
        learned.append((*best, counts[best]))
        for w, parts in state.items():
            out = []
            for s in parts:
                if out and (out[-1], s) == best and not out[-1] == "":
                    out[-1] = out[-1] + s
                else:
                    out.append(s)
            state[w] = out
    return learned


WORDS = {" low": 5, " lower": 2, " newest": 6, " widest": 3, " aaaa": 4, "baab": 2, " lowest": 3, "new": 9, "weird": 1}


def test_merges_equal_one_merge_at_a_time(spark):
    df = spark.createDataFrame(list(WORDS.items()), "word string, n bigint")
    got = sx.learn_merges(df, 25)
    assert [tuple(x) for x in got] == merge_by_merge(WORDS, 25)


def test_proven_run_stops_before_a_pair_it_may_change():
    assert sx.proven_run([("a", "b", 9), ("b", "c", 8), ("x", "y", 7)], True, 5) == [("a", "b", 9)]
    assert sx.proven_run([("a", "b", 9), ("x", "y", 7), ("u", "v", 6)], True, 5) == [("a", "b", 9), ("x", "y", 7), ("u", "v", 6)]
    assert sx.proven_run([("a", "b", 9), ("z", "a", 8), ("x", "y", 8)], True, 5) == [("a", "b", 9)]
    assert sx.proven_run([("a", "b", 9), ("x", "y", 7)], False, 5) == [("a", "b", 9)]


def test_pieces_round_trip_and_fall_back_to_bytes(spark):
    words = spark.createDataFrame(list(WORDS.items()), "word string, n bigint")
    model = sx.freeze(words, sx.learn_merges(words, 12))
    assert len(set(model.places.values())) == len(model.places) == max(model.places.values()) + 1
    texts = spark.createDataFrame([("new lowest",), ("żółw <0x41> 🐢",), ("aaaab  lower",)], "normalized string")
    encoded = sx.encoded_texts(texts, model)
    assert sx.broken_texts(encoded).count() == 0
    pieces = {r["normalized"]: list(r["pieces"]) for r in encoded.collect()}
    assert any(p.startswith("<0x") for p in pieces["żółw <0x41> 🐢"])
    assert sx.too_long(encoded, 2).count() >= 1


def test_each_text_splits_into_its_words(spark):
    df = spark.createDataFrame([("it's  a test, 42!\n ok ",)], "t string")
    words = df.select(sx.words_of(F.col("t")).alias("w")).first()["w"]
    assert "".join(words) == "it's  a test, 42!\n ok "
    assert words[:2] == ["it", "'s"]
