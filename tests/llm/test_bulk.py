"""Bulk-synchronous packing against the tokenizers library and a plain best fit, longest first."""

import random
import zlib
from bisect import bisect_left, insort
from collections import defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from chronotape.llm import bulk_packing

FILE = public_tokenizers.path("byte_bpe_50k.json")


def plain_best_fit(lengths, capacity):
    gaps, count = [], 0
    for length in sorted(lengths, reverse=True):
        at = bisect_left(gaps, length)
        if at == len(gaps):
            count, gap = count + 1, capacity
        else:
            gap = gaps.pop(at)
        insort(gaps, gap - length)
    return count


def lay_out(rows, capacity):
    """Checks that pieces fill their sequences without gaps or overlaps; returns the number of sequences."""
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


@pytest.mark.parametrize(("capacity", "top", "count"), [(2048, 2048, 3000), (64, 40, 1500)])
def test_few_sequences(spark, capacity, top, count):
    rng = random.Random(capacity + top)
    lengths = [min(top, 1 + int(rng.expovariate(4 / top))) for _ in range(count)]
    pieces = spark.createDataFrame(list(enumerate(lengths)), "piece_no bigint, length bigint").repartition(3)
    placed = bulk_packing.placements(pieces, capacity).join(pieces, "piece_no").collect()
    assert sorted(r["piece_no"] for r in placed) == list(range(count))
    assert lay_out(placed, capacity) <= 1.02 * plain_best_fit(lengths, capacity) + 4


def test_equal_lengths(spark):
    for length, capacity in ((700, 2048), (1, 64)):
        pieces = spark.range(1000).select(F.col("id").alias("piece_no"), F.lit(length).cast("bigint").alias("length"))
        placed = bulk_packing.placements(pieces, capacity).join(pieces, "piece_no").collect()
        assert lay_out(placed, capacity) == -(-1000 // (capacity // length))


def test_documents(table, odd_rows, clashing):
    docs = clashing(table([*odd_rows, (900, "the end <|endoftext|> of it", "en", "a"), (901, "a " * 2047, "en", "a"), (902, "a " * 5000, "en", "a")]))
    cut, places = bulk_packing.pack(docs, bulk_packing.library_encoder(FILE), 2048, 0)
    rows = cut.join(places, "piece_no").collect()
    assert len(rows) == cut.count()
    lay_out(rows, 2048)
    library = Tokenizer.from_file(FILE)
    want = sorted([*library.encode(r["text"] or "", add_special_tokens=False).ids, 0] for r in docs.collect())
    got, pieces = [], sorted(rows, key=lambda r: (r["piece_no"]))
    for r in pieces:
        ids = [int.from_bytes(r["ids"][i : i + 4], "little") for i in range(0, len(r["ids"]), 4)]
        assert len(ids) == r["length"]
        if r["piece"] == 0:
            got.append([])
        assert len(got[-1]) == r["start"] and (r["piece"] == 0 or len(ids) == 2048)
        got[-1] += ids
    assert sorted(got) == want
    laid = {r["sequence_id"]: r for r in bulk_packing.sequences(cut, places).collect()}
    for r in rows:
        at = 4 * r["offset"]
        assert laid[r["sequence_id"]]["ids"][at : at + len(r["ids"])] == r["ids"]
    assert sum(r["n_tokens"] for r in laid.values()) == sum(map(len, want))


def test_text_ids_and_empty_tables(spark, table):
    cut, places = bulk_packing.pack(table([]), bulk_packing.library_encoder(FILE), 2048, 0)
    assert cut.count() == places.count() == bulk_packing.sequences(cut, places).count() == 0
    docs = spark.createDataFrame([("x", "one two"), (None, None)], "doc_id string, text string")
    cut, places = bulk_packing.pack(docs, bulk_packing.library_encoder(FILE), 2048, 0)
    assert {r["doc_id"] for r in cut.join(places, "piece_no").collect()} == {"x", None}
    assert {r["c"] for r in cut.select(F.crc32("ids").alias("c")).collect()} >= {zlib.crc32(bytes(4))}
