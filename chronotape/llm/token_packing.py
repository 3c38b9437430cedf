"""Documents packed into rows of fixed length: best fit, longest first."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronotape.llm.byte_bpe import few_rows
from chronotape.llm.rows import prefix_sums
from chronotape.plans.shared import written


class Capacities:
    """A segment tree over the space left in open rows: finds the least space that still takes a length."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.any = [False] * (2 * self.size)

    def put(self, space: int, there: bool) -> None:
        at = self.size + space
        self.any[at] = there
        while at > 1:
            at //= 2
            self.any[at] = self.any[2 * at] or self.any[2 * at + 1]

    def least(self, length: int) -> int | None:
        """The least space >= length that some row has."""
        at = self.size + length
        if self.any[at]:
            return length
        while at > 1:
            if at % 2 == 0 and self.any[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.any[2 * at] else 2 * at + 1
                return at - self.size
            at //= 2
        return None


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Where best fit, longest first, puts `counts` (length -> pieces), and the number of rows.

    Pieces of one length are alike, and so are rows with the same space left: the plan moves whole ranges of
    rows, and its size follows the number of lengths, not of pieces. One entry says that the pieces of
    `length` from `rank` on, `count` of them, go to rows `row`, row + 1, ..., `each` in a row from `offset` on:
    (length, rank, count, row, each, offset).
    """
    spaces: dict[int, list[tuple[int, int]]] = {}
    tree = Capacities(capacity)
    plan, rows = [], 0

    def leave(space: int, first: int, count: int) -> None:
        if count and space:
            spaces.setdefault(space, []).append((first, count))
            tree.put(space, True)

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            space = tree.least(length)
            if space is None:
                space = capacity
                first, count = rows, -(-left // (capacity // length))
                rows += count
            else:
                first, count = spaces[space].pop()
                if not spaces[space]:
                    tree.put(space, False)
            each = space // length
            full = min(count, left // each)
            if full:
                plan.append((length, rank, full * each, first, each, capacity - space))
                leave(space - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            rest = count - full
            if rest and left:
                # The last row of this length takes fewer than it could.
                plan.append((length, rank, left, first + full, left, capacity - space))
                leave(space - left * length, first + full, 1)
                rest, full, left = rest - 1, full + 1, 0
            leave(space, first + full, rest)
    return plan, rows


def pack(encoded: DataFrame, capacity: int, end: int) -> DataFrame:
    """Rows of `capacity` ids from documents (doc_id, ids: binary of unsigned 16-bit little-endian ids).

    Every document is ended by the id `end`; what is longer than a row is split into whole rows and a rest,
    nothing is dropped or repeated. One result row per packed row: row, n_tokens, ids (binary, `capacity`
    ids, filled up with `end`), lengths (cumulative, from 0), positions (binary: places in the segment, from
    0 again in every segment; 0 in the filling), doc_ids and pieces (of each segment; piece p of a document
    begins at its id p * capacity). A null or empty document is the `end` alone; null and repeated doc_ids
    are kept as they are; an empty table gives an empty result.

    The packing is exact best fit, longest first, over the whole table. Only the counts per length, at most
    `capacity` numbers, are planned in one place; pieces find their rows by their rank in their length.
    """
    ids = F.coalesce(F.col("ids"), F.lit(b""))
    documents = written(
        encoded.select("doc_id", ids.alias("ids"), (F.octet_length(ids) / 2 + 1).cast("bigint").alias("n")).withColumn(
            "document", F.monotonically_increasing_id()
        ),
        "ids",
    )
    pieces = documents.select(
        "document", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / capacity).cast("bigint"))).alias("piece")
    ).select(
        "document",
        "piece",
        F.least(F.lit(capacity).cast("bigint"), F.col("n") - F.col("piece") * capacity).alias("length"),
        F.lit(1).cast("bigint").alias("one"),
    )
    ranked, totals = prefix_sums(pieces, ["document", "piece"], {"rank": "one"}, ("length",))
    counts = {r["length"]: r["rank"] for r in totals.collect()}
    plan, _ = best_fit_decreasing(counts, capacity)
    spark = encoded.sparkSession
    planned = spark.createDataFrame(plan or [(1, 0, 0, 0, 1, 0)], "length bigint, first bigint, pieces bigint, row bigint, each bigint, offset bigint")
    place = F.col("rank") - F.col("first")
    # The plan has a few entries per length, and lengths are at most `capacity`.
    placed = ranked.join(F.broadcast(planned), "length").where((place >= 0) & (place < F.col("pieces"))).select(
        "document",
        F.struct(
            (F.col("row") + F.floor(place / F.col("each"))).alias("row"),
            (F.col("offset") + place % F.col("each") * F.col("length")).alias("offset"),
            "length",
            "piece",
        ).alias("at"),
    )
    body = F.substring("ids", (F.col("at.piece") * (2 * capacity) + 1).cast("int"), F.lit(2 * capacity))
    parts = documents.join(placed, "document").select("at.row", F.struct("at.offset", "at.length", "doc_id", "at.piece", body.alias("ids")).alias("part"))
    gathered = parts.groupBy("row").agg(F.sort_array(F.collect_list("part")).alias("parts"))
    return laid_out(gathered, capacity, end, dict(encoded.dtypes)["doc_id"])


def laid_out(gathered: DataFrame, capacity: int, end: int, kind: str) -> DataFrame:
    def run(batches):
        for batch in few_rows(batches):
            out: dict[str, list] = {n: [] for n in ("row", "n_tokens", "ids", "lengths", "positions", "doc_ids", "pieces")}
            for row, parts in zip(batch.column("row").to_pylist(), batch.column("parts").to_pylist(), strict=True):
                ids = np.full(capacity, end, np.uint16)
                positions = np.zeros(capacity, np.uint16)
                for p in parts:
                    body = np.frombuffer(p["ids"], np.uint16)
                    ids[p["offset"] : p["offset"] + len(body)] = body
                    positions[p["offset"] : p["offset"] + p["length"]] = np.arange(p["length"], dtype=np.uint16)
                total = sum(p["length"] for p in parts)
                out["row"].append(row)
                out["n_tokens"].append(total)
                out["ids"].append(ids.tobytes())
                out["lengths"].append([p["offset"] for p in parts] + [total])
                out["positions"].append(positions.tobytes())
                out["doc_ids"].append([p["doc_id"] for p in parts])
                out["pieces"].append([p["piece"] for p in parts])
            yield pa.RecordBatch.from_pydict(out, schema=shape)

    ids_kind = pa.string() if kind == "string" else pa.int32() if kind == "int" else pa.int64()
    shape = pa.schema(
        [("row", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("lengths", pa.list_(pa.int32())),
         ("positions", pa.binary()), ("doc_ids", pa.list_(ids_kind)), ("pieces", pa.list_(pa.int64()))]
    )
    return gathered.mapInArrow(
        run, f"row bigint, n_tokens bigint, ids binary, lengths array<int>, positions binary, doc_ids array<{kind}>, pieces array<bigint>"
    )


def coded(docs: DataFrame, encoder: Callable[[], Callable[[str], np.ndarray]]) -> DataFrame:
    """doc_id and ids of every whole text; `encoder` makes, once per task, the function from text to 16-bit ids."""

    def run(batches):
        encode = encoder()
        for batch in few_rows(batches):
            ids = [np.asarray(encode(t), np.uint16).tobytes() if t else b"" for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids binary")


def rank_encoder(ranks: dict[bytes, int], pattern: str) -> Callable[[], Callable[[str], np.ndarray]]:
    """An encoder by the ranks of a public byte-level vocabulary, without special tokens."""

    def make():
        import tiktoken

        encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return encoding.encode_ordinary

    return make
