"""Documents packed into few sequences by bulk-synchronous best fit.

Pieces are placed in rounds, long ones first. The pieces of a round share the number of them that fills a
sequence, so a gap that earlier rounds left takes one of them as a rule. In a round, pieces and gaps are
range-sorted together; one sweep gives every piece its successor, the smallest gap that takes it; where
several pieces have the same successor, rank decides, and the later ones move on to the next gaps. Gaps
are updated, pieces that no gap takes open sequences, as many to each as fit, and the next round begins.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronotape.llm.rows import shuffle_partitions
from chronotape.plans.shared import written

#: Sequences that hold up to so many equal pieces have a round of their own; shorter pieces are halved by length.
OWN_ROUNDS = 8
#: Ids that a batch of pieces holds.
BATCH_IDS = 1 << 20

_PIECE, _SLOT = 0, 1
_NEVER = -(1 << 62)

#: Ids of every text.
Encoder = Callable[[list[str]], list[Sequence[int]]]


def pieces(docs: DataFrame, encoder: Callable[[], Encoder], capacity: int, end: int) -> DataFrame:
    """doc_id, piece, start, length, ids (binary: unsigned 32-bit little-endian) of every document.

    A document is the ids of its whole text, none if the text is null, and then `end`. A longer one than
    `capacity` is cut so that all pieces but the first are full. `encoder` is called once per task.
    """
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches):
        encode = encoder()
        for rows, ids in encoded(batches, encode):
            out: list[tuple] = []
            for row, values in zip(rows, ids, strict=True):
                data = np.append(np.asarray(values, "<u4"), np.uint32(end)).astype("<u4", copy=False)
                start, piece = 0, 0
                until = len(data) % capacity or capacity
                while start < len(data):
                    out.append((row, piece, start, until - start, data[start:until].tobytes()))
                    start, until, piece = until, until + capacity, piece + 1
            at, *columns = (list(c) for c in zip(*out, strict=True))
            arrays = [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(at, ids_kind), *arrays], names=["doc_id", "piece", "start", "length", "ids"])

    ids_kind = docs.select("doc_id").limit(0).toArrow().schema.field(0).type
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start bigint, length bigint, ids binary")


def encoded(batches: Iterator[pa.RecordBatch], encode: Encoder) -> Iterator[tuple[list, list[Sequence[int]]]]:
    """Document identifiers and ids, a few texts at a time; a long text is alone."""
    for batch in batches:
        rows, texts, held = [], [], 0
        for row, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            rows.append(row)
            texts.append(text.as_py() or "")
            held += len(texts[-1])
            if held >= BATCH_IDS:
                yield rows, encode(texts)
                rows, texts, held = [], [], 0
        if rows:
            yield rows, encode(texts)


def rounds(capacity: int) -> list[tuple[int, int]]:
    """Lengths (least, most) of each round, long ones first."""
    # Pieces of a round with a count of their own: more than capacity / (q + 1), capacity / q at most.
    tops = {capacity // q for q in range(1, OWN_ROUNDS + 1)} - {0}
    while min(tops) > 1:
        tops.add(min(tops) // 2)
    ordered = sorted(tops, reverse=True)
    return [(below + 1, top) for top, below in zip(ordered, [*ordered[1:], 0], strict=True)]


def swept(lengths: DataFrame, slots: DataFrame) -> DataFrame:
    """Pieces and slots in one order of size, each with what its partition has before it.

    Columns: size, kind, id, slot, gap, part, and of the same partition: pieces and slots before this row, and
    lead, the most that slots were ahead of pieces where a piece stood, up to this row. A piece stands before
    the slots of its size, so all slots behind it take it.
    """
    none = F.lit(0).cast("bigint")
    rows = lengths.select(F.col("length").alias("size"), F.lit(_PIECE).alias("kind"), F.col("piece_no").alias("id"), F.lit(0).alias("slot"), none.alias("gap"))
    rows = rows.unionByName(slots.select("size", F.lit(_SLOT).alias("kind"), F.col("sequence_id").alias("id"), "slot", "gap"))
    order = ["size", "kind", "id", "slot"]
    ranged = rows.repartitionByRange(shuffle_partitions(rows), *order).sortWithinPartitions(*order)
    ranged = ranged.select(*order, "gap", F.spark_partition_id().alias("part"))

    def run(batches):
        n_pieces, n_slots, lead = 0, 0, _NEVER
        for batch in batches:
            is_slot = batch.column("kind").to_numpy() == _SLOT
            slots_before = n_slots + np.cumsum(is_slot) - is_slot
            pieces_before = n_pieces + np.cumsum(~is_slot) - ~is_slot
            ahead = np.where(is_slot, _NEVER, slots_before - pieces_before)
            leads = np.maximum(np.maximum.accumulate(ahead), lead) if len(ahead) else ahead
            n_slots, n_pieces = n_slots + int(is_slot.sum()), n_pieces + int((~is_slot).sum())
            lead = int(leads[-1]) if len(leads) else lead
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(pieces_before, pa.int64()), pa.array(slots_before, pa.int64()), pa.array(leads, pa.int64())],
                names=[*batch.schema.names, "pieces_before", "slots_before", "lead"],
            )

    return ranged.mapInArrow(
        run, "size bigint, kind int, id bigint, slot int, gap bigint, part int, pieces_before bigint, slots_before bigint, lead bigint"
    )


def offsets(rows: DataFrame) -> tuple[DataFrame, int]:
    """What all partitions before each one hold: (part, piece_offset, slot_offset, carry), and the number of slots.

    The driver gets three numbers per partition.
    """
    is_piece = F.col("kind") == _PIECE
    totals = rows.groupBy("part").agg(F.count_if(is_piece).alias("pieces"), F.count_if(~is_piece).alias("slots"), F.max("lead").alias("lead"))
    out, n_pieces, n_slots, carry = [], 0, 0, _NEVER
    for r in sorted(totals.collect()):
        out.append((r["part"], n_pieces, n_slots, carry))
        if r["lead"] != _NEVER:
            carry = max(carry, r["lead"] + n_slots - n_pieces)
        n_pieces, n_slots = n_pieces + r["pieces"], n_slots + r["slots"]
    return rows.sparkSession.createDataFrame(out, "part int, piece_offset bigint, slot_offset bigint, carry bigint"), n_slots


def placed(rows: DataFrame, capacity: int) -> DataFrame:
    """One row per piece or slot of swept rows: piece_no (null: a free slot), sequence_id, offset, length, gap, last.

    The i-th piece takes slot i + max(slots ahead of pieces, so far): its successor, or the slot after the
    one that the piece before it took. Pieces beyond the last slot open sequences, as many in each as fit,
    named by their first piece. `gap` is what the sequence has left, on one row of each sequence (`last`).
    """
    before, n_slots = offsets(rows)
    located = rows.join(F.broadcast(before), "part")
    is_piece = F.col("kind") == _PIECE
    ahead = F.greatest("carry", F.col("lead") + F.col("slot_offset") - F.col("piece_offset"))
    wanted = located.where(is_piece).select(
        F.col("id").alias("piece_no"), F.col("size").alias("length"), (F.col("piece_offset") + F.col("pieces_before") + ahead).alias("place")
    )
    there = located.where(~is_piece).select(F.col("id").alias("sequence_id"), "slot", "gap", (F.col("slot_offset") + F.col("slots_before")).alias("place"))
    taken = there.join(wanted.where(F.col("place") < n_slots), "place", "left")
    # A sequence has at most `capacity` slots.
    mine = Window.partitionBy("sequence_id")
    used = F.coalesce(F.sum("length").over(mine.orderBy("slot")), F.lit(0))
    held = taken.select(
        "piece_no", "sequence_id", (F.lit(capacity) - F.col("gap") + used - F.col("length")).alias("offset"), "length",
        (F.col("gap") - F.coalesce(F.sum("length").over(mine), F.lit(0))).alias("gap"), (F.col("slot") == 0).alias("last"),
    )
    many = F.floor(F.lit(capacity) / F.col("length")).cast("bigint")
    rest = wanted.where(F.col("place") >= n_slots).select("piece_no", "length", (F.col("place") - F.lit(n_slots)).alias("rank"), many.alias("many"))
    # Ranks ascend with the length; there are at most `capacity` different values of `many`.
    counts = rest.groupBy("many").agg(F.min("rank").alias("first"))
    grouped = rest.join(F.broadcast(counts), "many").withColumn("place", F.col("rank") - F.col("first"))
    grouped = grouped.withColumn("group", F.floor(F.col("place") / F.col("many")))
    # A group has `many` rows at most.
    group = Window.partitionBy("many", "group")
    inside = group.orderBy("place")
    opened = grouped.select(
        "piece_no", F.first("piece_no").over(inside).alias("sequence_id"), (F.sum("length").over(inside) - F.col("length")).alias("offset"), "length",
        (F.lit(capacity) - F.sum("length").over(group)).alias("gap"), (F.row_number().over(inside) == 1).alias("last"),
    )
    return held.unionByName(opened)


def placements(lengths: DataFrame, capacity: int) -> DataFrame:
    """(piece_no, sequence_id, offset) for pieces (piece_no: unique long, length: 1 to `capacity`).

    Equal lengths are told apart by piece_no. An empty table gives an empty result. The driver gets the
    number of pieces per length and, per round, of gaps per size (at most `capacity` numbers each).
    """

    def histogram(df: DataFrame, size: str) -> dict[int, int]:
        return {r[size]: r["n"] for r in df.groupBy(size).agg(F.count(F.lit(1)).alias("n")).collect()}

    waiting = histogram(lengths, "length")
    shortest = min(waiting, default=1)
    moves: list[DataFrame] = []
    gaps = lengths.select(F.col("piece_no").alias("sequence_id"), F.col("length").alias("gap")).limit(0)
    free: dict[int, int] = {}

    def update(state: DataFrame) -> None:
        """Keep the moves; the gaps are those of this round and of sequences that had no part in it."""
        nonlocal gaps, free
        state = written(state, "round")
        moves.append(state.where("piece_no is not null").select("piece_no", "sequence_id", "offset"))
        now = state.where(F.col("last") & (F.col("gap") >= shortest)).select("sequence_id", "gap")
        gaps = now.unionByName(gaps.where(F.col("gap") < least))
        free = histogram(gaps, "gap")

    for least, most in rounds(capacity):
        if least > shortest and sum(n for length, n in waiting.items() if length <= most) <= sum(n * max(1, g // most) for g, n in free.items() if g >= most):
            # Every shorter piece finds a slot of this size: one round places them all.
            least = 1
        count = sum(n for length, n in waiting.items() if least <= length <= most)
        now = lengths.where(F.col("length").between(least, most))
        while count:
            if not free and 2 * least > capacity:
                # Nothing fits beside them.
                alone = F.lit(0).cast("bigint")
                update(now.select("piece_no", F.col("piece_no").alias("sequence_id"), alone.alias("offset"), "length", (F.lit(capacity) - F.col("length")).alias("gap"), F.lit(True).alias("last")))
                break
            many = F.greatest(F.lit(1), F.floor(F.col("gap") / most)).cast("int")
            size = F.when(many > 1, F.lit(most).cast("bigint")).otherwise(F.col("gap")).alias("size")
            slots = gaps.where(F.col("gap") >= least).select("sequence_id", "gap", size, F.explode(F.sequence(F.lit(0), many - 1)).alias("slot"))
            n_slots = sum(n * max(1, g // most) for g, n in free.items() if g >= least)
            state = placed(written(swept(now, slots), "sweep"), capacity)
            if most > capacity // OWN_ROUNDS or not n_slots or count <= n_slots // 2:
                # No gap has room for a second piece of this round, or there are slots enough: the others open sequences.
                update(state)
                break
            # Short pieces: what found no slot tries the gaps again, as long as some find one.
            state = written(state, "tried")
            again = state.where("piece_no = sequence_id and offset = 0").select("sequence_id").distinct()
            held = state.join(again, "sequence_id", "left_anti")
            found = held.where("piece_no is not null").count()
            if found in (0, count):
                update(state)
                break
            now, count = now.join(held.select("piece_no"), "piece_no", "left_anti"), count - found
            now = written(now, "rest")
            update(held)
        waiting = {length: n for length, n in waiting.items() if not least <= length <= most}
        if not waiting:
            break
    if not moves:
        return lengths.select("piece_no", F.col("piece_no").alias("sequence_id"), F.col("length").alias("offset")).limit(0)
    return reduce(DataFrame.unionByName, moves)


def pack(docs: DataFrame, encoder: Callable[[], Encoder], capacity: int, end: int) -> tuple[DataFrame, DataFrame]:
    """Pieces (piece_no, doc_id, piece, start, length, ids; written) and their places (piece_no, sequence_id, offset).

    Every row of `docs` is a document of its own, also rows that are equal and rows without an id. A null or
    empty text is the id `end` alone. Other columns are not read. Empty in, empty out.
    """
    cut = pieces(docs, encoder, capacity, end).select(F.monotonically_increasing_id().alias("piece_no"), "*")
    cut = written(cut, "pieces")
    return cut, placements(cut.select("piece_no", "length"), capacity)


def sequences(cut: DataFrame, places: DataFrame) -> DataFrame:
    """One row per sequence: sequence_id, n_tokens, ids (binary), lengths, doc_ids and pieces in their order."""
    # A sequence has at most as many pieces as it has ids.
    part = F.struct("offset", "length", "doc_id", "piece", "ids")
    gathered = cut.join(places, "piece_no").groupBy("sequence_id").agg(F.sort_array(F.collect_list(part)).alias("parts"))
    joined = F.aggregate("parts.ids", F.lit(b""), lambda whole, ids: F.concat(whole, ids))
    return gathered.select(
        "sequence_id",
        F.aggregate("parts.length", F.lit(0).cast("bigint"), lambda a, b: a + b).alias("n_tokens"),
        joined.alias("ids"),
        F.col("parts.length").alias("lengths"),
        F.col("parts.doc_id").alias("doc_ids"),
        F.col("parts.piece").alias("pieces"),
    )


@cache
def byte_level(content: str) -> Encoder:
    """The encoder of a byte-level BPE file, made once per Python worker."""
    import json

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    model = json.loads(content)
    added = [t["content"] for t in model["added_tokens"]]
    # The bytes that the file writes as themselves; it writes the others as the letters from 256 on, in order.
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in visible)}
    ranks = {bytes(letters[c] for c in piece): i for piece, i in model["model"]["vocab"].items() if piece not in added}
    fast = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_to_numpy
    library = cache(lambda: Tokenizer.from_str(content))

    def encode(texts: list[str]) -> list[Sequence[int]]:
        return [library().encode(t, add_special_tokens=False).ids if any(a in t for a in added) else fast(t) for t in texts]

    return encode


def library_encoder(tokenizer_file: str) -> Callable[[], Encoder]:
    """Ids as the tokenizers library has them for a byte-level BPE file, without added special tokens.

    The merges of a byte-level file are ranks of its vocabulary, which the tiktoken library walks several times
    faster. A text with one of the file's added tokens in it goes to the tokenizers library itself.
    """
    # Read where the plan is made: tasks get the file with their code.
    with open(tokenizer_file, encoding="utf-8") as file:
        content = file.read()
    return lambda: byte_level(content)
