"""Byte-level BPE: ranked merges of distinct words, and decoding.

Every distinct word of the table is folded once, by higher-order functions over a literal rank map, whatever
its frequency. Documents are read in blocks, stretches of the partitions of their scan: a block sends its distinct words to
the word table, gets their ids back, and lays them out along its texts.
"""

from __future__ import annotations

import base64
import heapq
import json
import zlib
from array import array
from collections.abc import Callable, Iterator
from itertools import batched
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronotape.llm.rows import fresh, shuffle_partitions
from chronotape.plans.shared import written

#: Bytes of the longest word that is folded; a fold takes time by the square of the length, so longer words go to a heap.
FOLD_BYTES = 128
#: Distinct pieces of texts that a task holds before it passes their words on.
HELD_WORDS = 500_000
#: What stands between packed words: a byte that UTF-8 does not have, as Python reads it.
BETWEEN = "\udcff"
#: Rows that a task holds as Python objects at a time.
PART_ROWS = 256
#: Bytes of the texts that travel together.
PART_BYTES = 1 << 20
#: Bytes of the texts of a block, about: a task holds the words of one block.
BLOCK_BYTES = 8 << 20
#: Entries of a literal table that share a bucket, about.
PER_BUCKET = 4
#: Characters that the description of a plan with literal tables may have; the driver keeps it for every query.
PLAN_CHARACTERS = 20_000


def letter(rank: int) -> str:
    """An id as one character: letters are ordered as their ids, and surrogates are left out."""
    at = 0x100 + rank
    return chr(at if at < 0xD800 else at + 0x800)


def rank_of(character: str) -> int:
    at = ord(character)
    return at - 0x100 if at < 0xD800 else at - 0x900


class Ranks:
    """A rank file as literals. Inside expressions a byte array is a string with one letter per id.

    `pairs` maps two letters to the letter of the bytes they join to, which is also their rank: letters sort
    by id. `ranks` has the id of every piece, `pieces` the bytes of every id. The file is read where
    the plan is made; tasks get its tables with their code.
    """

    def __init__(self, path: str):
        lines = [line.split() for line in Path(path).read_bytes().splitlines() if line.strip()]
        self.ranks = {base64.b64decode(piece): int(rank) for piece, rank in lines}
        self.pieces = [b""] * (max(self.ranks.values()) + 1)
        pairs = {}
        for piece, rank in self.ranks.items():
            self.pieces[rank] = piece
            for cut in range(1, len(piece)):
                left, right = self.ranks.get(piece[:cut]), self.ranks.get(piece[cut:])
                if left is not None and right is not None:
                    pairs[letter(left) + letter(right)] = letter(rank)
        self.pairs = bucketed(pairs)
        self.latin = "".join(chr(b) for b in range(256))
        self.letters = "".join(letter(self.ranks[bytes([b])]) for b in range(256))


def bucketed(entries: dict[str, str]) -> tuple[Column, int]:
    """A literal map that is looked up in constant time: an array of small maps, by the checksum of the key."""
    size = 1 << max(1, (len(entries) // PER_BUCKET).bit_length())
    buckets: list[dict] = [{} for _ in range(size)]
    for key, value in entries.items():
        buckets[zlib.crc32(key.encode()) % size][key] = value
    return F.from_json(F.lit(json.dumps(buckets, ensure_ascii=False, separators=(",", ":"))), "array<map<string,string>>"), size


def found(table: Column, size: int, key: Column) -> Column:
    return F.element_at(F.element_at(table, (F.crc32(key.cast("binary")) % size + 1).cast("int")), key)


def bound(value: Column, body) -> Column:
    """`body` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def folded(word: Column, pairs: Column, ranks: Ranks) -> Column:
    """The letters of one word: a fold over its bytes that merges the leftmost pair of the least rank, until none has one."""
    size = ranks.pairs[1]

    def step(state: Column, _: Column) -> Column:
        merged = F.transform(F.sequence(F.lit(1), F.length(state) - 1), lambda i: found(pairs, size, F.substring(state, i, F.lit(2))))

        def merge(all_of: Column) -> Column:
            least = F.array_min(all_of)
            at = F.array_position(all_of, least).cast("int")
            return F.when(least.isNotNull(), F.overlay(state, least, at, F.lit(2))).otherwise(state)

        return bound(merged, merge)

    def fold(start: Column) -> Column:
        return F.when(F.length(start) > 1, F.aggregate(F.sequence(F.lit(2), F.length(start)), start, step)).otherwise(start)

    return bound(F.translate(F.decode(word.cast("binary"), "ISO-8859-1"), ranks.latin, ranks.letters), fold)


def heap_merged(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges for a long word, which no fold takes, in n log n steps."""
    if word in ranks:
        return [ranks[word]]
    parts = [word[i : i + 1] for i in range(len(word))]
    after, before = list(range(1, len(word) + 1)), list(range(-1, len(word) - 1))
    waiting: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        j = after[i]
        if j < len(parts) and (rank := ranks.get(parts[i] + parts[j])) is not None:
            heapq.heappush(waiting, (rank, i, len(parts[i]) + len(parts[j])))

    for i in range(len(parts)):
        offer(i)
    while waiting:
        rank, i, length = heapq.heappop(waiting)
        j = after[i]
        if not parts[i] or j >= len(parts) or len(parts[i]) + len(parts[j]) != length or ranks.get(parts[i] + parts[j]) != rank:
            continue
        parts[i], parts[j] = parts[i] + parts[j], b""
        after[i] = after[j]
        if after[i] < len(parts):
            before[after[i]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [ranks[p] for p in parts if p]


Cut = Callable[[str], list[str]]


def cuts(pattern: str) -> tuple[Cut, Cut]:
    """How a text is cut into pieces, each looked up as a whole, and a piece into its matches of `pattern`.

    Under PATTERN a space between two other characters that are no white space begins a match, and no match depends
    on what is beyond it, so a text of such spaces is cut there, and a piece that repeats is matched once. Of other
    texts, and under other patterns, the matches are the pieces.
    """
    import regex

    split = regex.compile(pattern).findall
    if pattern != public_tokenizers.PATTERN:
        return split, lambda piece: [piece]
    run_of_spaces = regex.compile(r"\s\s").search
    return lambda text: split(text) if run_of_spaces(text) else text.replace(" ", BETWEEN + " ").split(BETWEEN), split


def matches(pieces: set[str], pattern: str, split: Cut) -> set[str]:
    """The distinct matches in pieces: those that begin with a space and end without white space are matched in a row."""
    if pattern != public_tokenizers.PATTERN:
        return pieces
    words: set[str] = set()
    in_a_row = (p for p in pieces if p[:1] == " " and not p[-1].isspace())
    for some in batched(in_a_row, PART_ROWS):
        words.update(split("".join(some)))
    for piece in pieces:
        if piece[:1] != " " or piece[-1].isspace():
            words.update(split(piece))
    return words


class Words(dict):
    """Ids, as bytes, of the pieces of a block. Words in the rank file are their own ids, long words are merged here; all others were folded."""

    def __init__(self, ranks: dict[bytes, int], split: Cut):
        super().__init__()
        self.ranks, self.split = ranks, split

    def __missing__(self, word: str) -> bytes:
        if (words := self.split(word)) != [word]:
            self[word] = out = b"".join(map(self.__getitem__, words))
            return out
        data = word.encode()
        if data in self.ranks:
            ids = [self.ranks[data]]
        elif len(data) > FOLD_BYTES:
            ids = heap_merged(data, self.ranks)
        else:
            raise KeyError(f"{word!r} is not among the words of its block: the table changed between two reads")
        self[word] = out = array("i", ids).tobytes()
        return out

    def learn(self, words: bytes, ids: bytes) -> None:
        """A pack of words with the pack of their ids, see `packed` and `folded_words`."""
        names, data = unpacked(words), zlib.decompress(ids)
        ends = (len(names) + 4 * np.cumsum(np.frombuffer(data, np.uint8, len(names)), dtype=np.int64)).tolist()
        self.update((w, data[a:b]) for w, a, b in zip(names, [len(names), *ends], ends, strict=False))


def packed(words: list[str]) -> bytes:
    """One or more words as compressed bytes; between them is a byte that UTF-8 does not have."""
    return zlib.compress(BETWEEN.join(words).encode("utf-8", "surrogateescape"), 1)


def unpacked(words: bytes) -> list[str]:
    return zlib.decompress(words).decode("utf-8", "surrogateescape").split(BETWEEN)


def ids_of(letters: pa.Array) -> list[bytes]:
    """The ids, as bytes, that strings of letters stand for."""
    points = np.frombuffer("".join(letters.to_pylist()).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int32)
    data = np.where(points < 0xD800, points - 0x100, points - 0x900).astype(np.int32).tobytes()
    ends = (4 * np.cumsum(pc.utf8_length(letters).to_numpy())).tolist()
    return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def blocks(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The rows of a task, its partition in the first column, cut where the texts in column `at` fill another block.

    A block is numbered by its partition and its place there; only the order of rows decides, not the batches.
    """
    before = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy().astype(np.int64)
        ends = before + np.cumsum(sizes)
        places = (ends - sizes) // BLOCK_BYTES
        edges = (np.flatnonzero(places[1:] != places[:-1]) + 1).tolist()
        for begin, end in zip([0, *edges], [*edges, batch.num_rows], strict=True):
            yield (batch.column(0)[0].as_py() << 32) + int(places[begin]), batch.slice(begin, end - begin)
        before = int(ends[-1])


def block_words(docs: DataFrame, ranks: Ranks, pattern: str, buckets: int) -> DataFrame:
    """bucket, block, words: the distinct words of every block that are to be folded, packed by the bucket of the word.

    A word has one bucket in all blocks; it may come more than once from a block.
    """
    known = ranks.ranks

    def run(batches):
        (pieces, split), held, block = cuts(pattern), set(), 0

        def rows() -> Iterator[pa.RecordBatch]:
            packs: dict[int, list[str]] = {}
            for w in matches(held, pattern, split):
                if (data := w.encode()) not in known and len(data) <= FOLD_BYTES:
                    packs.setdefault(zlib.crc32(data) % buckets, []).append(w)
            for some in batched(sorted(packs), PART_ROWS):
                words = pa.array([packed(sorted(packs[k])) for k in some], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([block] * len(some), pa.int64()), words], names=["bucket", "block", "words"])

        for here, some in blocks(batches, 1):
            if here != block:
                yield from rows()
                block, held = here, set()
            for part in few_rows([some]):
                for text in part.column(1).to_pylist():
                    if text:
                        held.update(pieces(text))
                if len(held) > HELD_WORDS:
                    yield from rows()
                    held = set()
        yield from rows()

    texts = docs.select(F.spark_partition_id().alias("part"), "text")
    return texts.mapInArrow(run, "bucket bigint, block bigint, words binary")


def folded_words(packs: DataFrame, ranks: Ranks, buckets: int) -> DataFrame:
    """block, words, ids: the packs with the ids of their words; every distinct word is folded once, in its bucket.

    A task numbers the words of its buckets as they come, hands new words to the fold, and lays their ids out along
    the packs: the number of ids of each word as a byte, then all ids as 32-bit numbers, compressed.
    """

    def number(batches):
        numbers: dict[str, int] = {}
        for part in few_rows(batches, PART_BYTES // 8):
            places, fresh_words = [], []
            for words in map(unpacked, part.column(1).to_pylist()):
                first = len(numbers)
                at = [numbers.setdefault(w, len(numbers)) for w in words]
                places.append(array("i", at).tobytes())
                fresh_words.append([w for w, i in zip(words, at, strict=True) if i >= first])
            columns = [*part.columns, pa.array(places, pa.binary()), pa.array(fresh_words, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, names=["block", "words", "places", "fresh"])

    def lay_out(batches):
        table: list[bytes] = []
        for part in few_rows(batches, PART_BYTES // 8):
            out = []
            for places, letters in zip(part.column(2).to_pylist(), part.column(3), strict=True):
                if len(letters.values):
                    table += ids_of(letters.values)
                ids = [table[i] for i in np.frombuffer(places, np.int32).tolist()]
                out.append(zlib.compress(bytes([len(x) // 4 for x in ids]) + b"".join(ids), 1))
            yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(out, pa.binary())], names=["block", "words", "ids"])

    dealt = packs.repartitionById(buckets, F.col("bucket").cast("int")).select("block", "words")
    numbered = dealt.mapInArrow(number, "block bigint, words binary, places binary, fresh array<string>")
    letters = bound(ranks.pairs[0], lambda t: F.transform("fresh", lambda w: folded(w, t, ranks)))
    coded = numbered.select("block", "words", "places", letters.alias("letters"))
    return coded.mapInArrow(lay_out, "block bigint, words binary, ids binary")


def block_rows(docs: DataFrame) -> DataFrame:
    """block, rows: the documents of every block, as compressed Arrow."""
    at = 1 + docs.columns.index("text")

    def run(batches):
        for block, some in blocks(batches, at):
            for part in few_rows([some]):
                sink = pa.BufferOutputStream()
                slim = pa.RecordBatch.from_arrays(part.columns[1:], names=[f"c{i}" for i in range(part.num_columns - 1)])
                with pa.ipc.new_stream(sink, slim.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_batch(slim)
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "rows"])

    return docs.select(F.spark_partition_id().alias(*fresh(docs, "part")), *[F.col(f"`{c}`") for c in docs.columns]).mapInArrow(
        run, "block bigint, rows binary"
    )


def short_plans(spark: SparkSession) -> None:
    """Literal tables would fill the descriptions of plans: without a limit of the session's own they are cut."""
    if spark.conf.get("spark.sql.maxPlanStringLength", None) in (None, str(2**31 - 1 - 15)):
        spark.conf.set("spark.sql.maxPlanStringLength", str(PLAN_CHARACTERS))


def encode(docs: DataFrame, ranks: Ranks, pattern: str, column: str | None = None, scan: bool = False) -> DataFrame:
    """The rows of `docs` with the ids of their whole text, array<int>, in a column named ids (or `column`).

    Every match of `pattern` is encoded by itself, without special tokens; a null text is empty and has no
    ids. Each row is encoded by its text alone, so rows of equal text get equal ids, rows that are equal all
    stay, an empty table gives an empty result and all other columns stay as they are.

    `docs` is read twice and both reads must see the same partitions in the same order of rows. A plain read of files does; say so by
    `scan`. Any other table is written first. Distinct words are shuffled by word and back by block, as compressed
    packs, documents once as compressed Arrow; the driver gets nothing.
    """
    short_plans(docs.sparkSession)
    ids = column or fresh(docs, "ids")[0]
    if not scan:
        docs = written(docs, "documents")
    known, names = ranks.ranks, docs.columns
    at, parts = names.index("text"), shuffle_partitions(docs)
    words = folded_words(block_words(docs, ranks, pattern, parts), ranks, parts)
    none = F.lit(None).cast("binary")
    both = words.select("block", "words", "ids", none.alias("rows")).unionByName(block_rows(docs).select("block", none.alias("words"), none.alias("ids"), "rows"))
    # Partitions of the scan are dealt out evenly, and in every block the words come first.
    dealt = both.repartitionById(parts, (F.shiftright("block", 32) % parts).cast("int")).sortWithinPartitions("block", F.col("words").isNull())

    def run(batches):
        (pieces, split), block, table = cuts(pattern), None, None
        for batch in batches:
            for here, pack, coded_ids, rows in zip(*(batch.column(i) for i in range(4)), strict=True):
                if here.as_py() != block:
                    block, table = here.as_py(), Words(known, split)
                if pack.is_valid:
                    table.learn(pack.as_py(), coded_ids.as_py())
                    continue
                get = table.__getitem__
                for part in pa.ipc.open_stream(rows.as_buffer()):
                    coded = [b"".join(map(get, pieces(text))) if text else b"" for text in part.column(at).to_pylist()]
                    yield pa.RecordBatch.from_arrays([*part.columns, lists_of(coded)], names=[*names, ids])

    return dealt.select("block", "words", "ids", "rows").mapInArrow(run, docs.select("*", F.array(F.lit(0)).alias(ids)).schema)


def few_rows(batches: Iterator[pa.RecordBatch], size: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices of a few rows, which bound what a task holds as Python objects."""
    for batch in batches:
        rows = max(1, min(PART_ROWS, batch.num_rows * size // max(1, batch.nbytes)))
        for begin in range(0, batch.num_rows, rows):
            yield batch.slice(begin, rows)


def lists_of(coded: list[bytes]) -> pa.Array:
    """Lists of 32-bit ids from their bytes."""
    offsets = np.zeros(len(coded) + 1, np.int64)
    np.cumsum([len(x) // 4 for x in coded], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(np.frombuffer(b"".join(coded), np.int32)))


def decoded(ids: Column, ranks: Ranks) -> Column:
    """The bytes that ids stand for: their binary pieces, concatenated; none for null ids."""
    table = F.from_json(F.lit(json.dumps([p.hex() for p in ranks.pieces])), "array<string>")
    parts = bound(table, lambda pieces: F.transform(ids, lambda i: F.element_at(pieces, i + 1)))
    return F.coalesce(F.unhex(F.array_join(parts, "")), F.lit(b""))


def decode(encoded: DataFrame, ranks: Ranks, ids: str = "ids", column: str | None = None) -> DataFrame:
    """The rows with the bytes that their ids stand for, in a column named decoded (or `column`, or the next free name).

    Null ids and no ids give no bytes. All rows and all other columns stay as they are.
    """
    name = column or fresh(encoded, "decoded")[0]
    return encoded.withColumn(name, decoded(F.col(f"`{ids}`"), ranks))


def digests(encoded: DataFrame, ranks: Ranks, column: str = "ids") -> DataFrame:
    """doc_id, n_tokens, and the digests of the ids in decimal and of the decoded bytes; one row per row.

    No ids (those of a null or empty text) give 0 and the digests of nothing; rows that are equal all stay.
    """
    ids = F.col(f"`{column}`")
    return encoded.select(
        "doc_id",
        F.size(ids).cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(ids.cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(decoded(ids, ranks), 256).alias("decoded_sha256"),
    )
