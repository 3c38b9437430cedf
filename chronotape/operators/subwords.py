"""Subword pieces of short texts: learning merges as a loop of Spark aggregates, and encoding.

Words are kept as distinct words with their counts. A word is a string of
wrapped symbols, so a merge is one text replacement. Ties between pairs go to
the smaller text. Several merges are taken from one count of pairs as long as
the count alone proves that a merge-by-merge run would pick the same ones.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronotape.plans.shared import written

# Fixed value: how a text splits into words before merging (a leading space stays with its word).
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
OPEN, CLOSE = "\x02", "\x03"
# Fixed value: the name of a byte piece.
BYTE_PIECE = "<0x{:02X}>"
TOP_PAIRS = 256
REWRITE_EVERY = 16

Pair = tuple[str, str, int]


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORDS), F.lit(0))


def word_counts(texts: DataFrame, text: str = "normalized", n: str = "occurrences") -> DataFrame:
    """Distinct words of the corpus, weighted by how often their texts occur."""
    return texts.select(F.explode(words_of(F.col(text))).alias("word"), F.col(n).alias("_n")).groupBy("word").agg(
        F.sum("_n").alias("n")
    )


def _wrapped(word: Column) -> Column:
    letters = F.regexp_extract_all(word, F.lit(r"(?s)."), F.lit(0))
    return F.concat(F.lit(OPEN), F.array_join(letters, CLOSE + OPEN), F.lit(CLOSE))


def _merge(wrapped: Column, left: str, right: str) -> Column:
    return F.replace(wrapped, F.lit(f"{OPEN}{left}{CLOSE}{OPEN}{right}{CLOSE}"), F.lit(f"{OPEN}{left}{right}{CLOSE}"))


def _pair_counts(words: DataFrame) -> DataFrame:
    inner = F.substring(F.col("wrapped"), 2, F.length("wrapped") - 2)
    rows = words.select(F.split(inner, CLOSE + OPEN).alias("s"), "n").filter(F.size("s") > 1)
    pairs = F.arrays_zip(
        F.slice("s", 1, F.size("s") - 1).alias("a"), F.slice("s", 2, F.size("s") - 1).alias("b")
    )
    return rows.select(F.explode(pairs).alias("p"), "n").groupBy("p.a", "p.b").agg(F.sum("n").alias("n"))


def proven_run(top: list[Pair], complete: bool, wanted: int) -> list[Pair]:
    """The longest start of the pair ranking that a merge-by-merge run must also choose.

    A merge of (a, b) leaves pairs without a and b as they are, lowers others,
    and creates pairs no more frequent than the pairs that end in a or begin
    with b. A later pair is safe while it shares no symbol with the chosen ones
    and beats everything they can create.
    """
    chosen: list[Pair] = []
    used: set[str] = set()
    bound = 0
    floor = 0 if complete else top[-1][2]
    for left, right, n in top[:wanted]:
        if chosen and (left in used or right in used or n <= bound or n <= floor):
            break
        chosen.append((left, right, n))
        used.update((left, right, left + right))
        touching = [m for a, b, m in top if b == left or a == right]
        bound = max([bound, floor, *touching])
    return chosen


def merges_for(words: DataFrame, pieces: int) -> int:
    """Merges that a model of `pieces` pieces has room for next to its letters and the 256 bytes."""
    return max(0, pieces - 256 - alphabet(words).count())


def learn_merges(words: DataFrame, merges: int, min_frequency: int = 2) -> list[Pair]:
    """The first `merges` merges (left, right, count), fewer when no pair reaches `min_frequency` any more.

    Only pair counts of a round reach the driver, at most TOP_PAIRS."""
    base = written(words.select("n", _wrapped(F.col("word")).alias("wrapped")), "words")
    learned: list[Pair] = []
    pending: list[Pair] = []
    while len(learned) < merges:
        current = F.col("wrapped")
        for left, right, _ in pending:
            current = _merge(current, left, right)
        state = base.select("n", current.alias("wrapped"))
        if len(pending) >= REWRITE_EVERY:
            base, pending = written(state, "words"), []
            state = base
        counts = _pair_counts(state).filter(F.col("n") >= min_frequency)
        rank = [F.col("n").desc(), F.concat("a", "b"), "a"]
        found = [(r["a"], r["b"], r["n"]) for r in counts.orderBy(*rank).limit(TOP_PAIRS + 1).collect()]
        if not found:
            break
        run = proven_run(found[:TOP_PAIRS], len(found) <= TOP_PAIRS, merges - len(learned))
        learned += run
        pending += run
    return learned


def alphabet(words: DataFrame) -> DataFrame:
    letters = F.regexp_extract_all(F.col("word"), F.lit(r"(?s)."), F.lit(0))
    return words.select(F.explode(letters).alias("piece")).distinct()


@dataclass(frozen=True)
class Pieces:
    """A learned model: merges in order and the place of every piece."""

    merges: tuple[tuple[str, str], ...]
    places: dict[str, int]


def freeze(words: DataFrame, learned: list[Pair]) -> Pieces:
    """Letters in text order, merged pieces as learned, then the 256 bytes. Unicode bounds the letters."""
    letters = [r["piece"] for r in alphabet(words).orderBy("piece").collect()]
    names = [*letters, *(a + b for a, b, _ in learned), *(BYTE_PIECE.format(i) for i in range(256))]
    places: dict[str, int] = {}
    for name in names:
        places.setdefault(name, len(places))
    return Pieces(tuple((a, b) for a, b, _ in learned), places)


def pieces_table(spark, model: Pieces) -> DataFrame:
    return spark.createDataFrame(list(model.places.items()), "piece string, local int")


def _split_word(word: str, ranks: dict[tuple[str, str], int], known: dict[str, int]) -> list[str]:
    parts = list(word)
    while len(parts) > 1:
        best = min(zip(parts, parts[1:]), key=lambda pair: ranks.get(pair, len(ranks)))
        if best not in ranks:
            break
        joined, i = [], 0
        while i < len(parts):
            step = 2 if tuple(parts[i : i + 2]) == best else 1
            joined.append("".join(parts[i : i + step]))
            i += step
        parts = joined
    out: list[str] = []
    for part in parts:
        out += [part] if part in known else [BYTE_PIECE.format(b) for b in part.encode("utf-8")]
    return out


def encoded_texts(texts: DataFrame, model: Pieces, text: str = "normalized", first: int = 0) -> DataFrame:
    """Pieces and ids of every distinct text; each distinct text is encoded once, in Arrow batches."""
    ranks = {pair: i for i, pair in enumerate(model.merges)}
    known = model.places

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def split(words: pd.Series) -> pd.Series:
        memory: dict[str, list[str]] = {}

        def one(ws):
            out: list[str] = []
            for w in ws:
                if w not in memory:
                    memory[w] = _split_word(w, ranks, known)
                out += memory[w]
            return out

        return words.map(one)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def number(pieces: pd.Series) -> pd.Series:
        return pieces.map(lambda ps: [first + known[p] for p in ps])

    distinct = texts.select(text).filter(F.col(text).isNotNull()).distinct()
    return distinct.withColumn("pieces", split(words_of(F.col(text)))).withColumn("ids", number("pieces"))


def decoded(pieces: Column) -> Column:
    """Text of a list of pieces; runs of byte pieces are put back together."""
    byte = lambda p: p.rlike(r"^<0x[0-9A-F]{2}>$")
    hexed = F.transform(
        pieces, lambda p: F.when(byte(p), F.substring(p, 4, 2)).otherwise(F.hex(F.encode(p, "utf-8")))
    )
    return F.decode(F.unhex(F.array_join(hexed, "")), "utf-8")


def broken_texts(encoded: DataFrame, text: str = "normalized") -> DataFrame:
    """Texts that their pieces do not give back."""
    return encoded.filter(decoded(F.col("pieces")) != F.col(text)).select(text, "pieces")


def too_long(encoded: DataFrame, limit: int = 256, text: str = "normalized") -> DataFrame:
    return encoded.filter(F.size("pieces") > limit).select(text, F.size("pieces").alias("n_pieces"))
