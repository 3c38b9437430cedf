"""Passages that repeat within or across documents, found by windows of doubling length."""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronotape.llm.rows import row_key
from chronotape.llm.wordhash import Words, slices
from chronotape.plans.shared import written

WINDOW = 35
#: The shortest windows that are compared.
SHORTEST = 9


def levels(window: int) -> list[int]:
    """Window lengths from short to `window`, each at most twice the one before."""
    out = [window]
    while out[0] > SHORTEST:
        out.insert(0, -(-out[0] // 2))
    return out


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every `width` neighbours."""
    reach = 1
    while reach * 2 <= width:
        values = np.minimum(values[:-reach], values[reach:])
        reach *= 2
    if reach < width:
        values = np.minimum(values[: len(values) - (width - reach)], values[width - reach :])
    return values


def landmarks(hashes: np.ndarray, runs: np.ndarray, window: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the landmarks of the candidate windows, and for every candidate the hash of its own.

    A window of `window` words contains width = window - length + 1 shorter ones; its landmark is the one of
    the least hash. Equal windows have equal landmarks, so a window whose landmark does not repeat cannot
    repeat either, and only landmarks, about 2 in width + 1 places, need to be compared.
    """
    width = window - length + 1
    marks, own = [], []
    for begin, end in runs:
        here = hashes[begin : end + width - 1]
        least = sliding_least(here, width)
        # A place is a landmark when some candidate over it has its hash as the least.
        padded = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
        highest = ~sliding_least(~padded, width)
        marks.append(here[highest == here])
        own.append(least)
    return (np.concatenate(marks), np.concatenate(own)) if marks else (np.zeros(0, np.uint64),) * 2


def runs_of(found: np.ndarray) -> np.ndarray:
    """Begin and end of every run of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], found.astype(np.int8), [0]])))
    return edges.reshape(-1, 2)


def among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(values), bool)
    known = np.sort(known)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def narrowed(runs: np.ndarray, stays: np.ndarray) -> np.ndarray:
    """The candidates of `runs` that stay, as runs again; `stays` has one value per candidate."""
    out, at = [], 0
    for begin, end in runs:
        out.append(runs_of(stays[at : at + end - begin]) + begin)
        at += end - begin
    return np.concatenate(out) if out else np.zeros((0, 2), np.int64)


def long_list(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64) if flat.dtype == np.uint64 else flat.astype(np.int64)))


def texts_of(batch: pa.RecordBatch):
    """(place in the batch, first word, end word, words of the slice, hashes per length) of every text."""
    for begin, count, words in slices(batch.column("text")):
        hashes: dict[tuple[int, int], np.ndarray] = {}
        for row in range(count):
            yield begin + row, int(words.first[row]), int(words.first[row + 1]), words, hashes


def windows_of(words: Words, cache: dict, first: int, last: int, length: int, which: int = 0) -> np.ndarray:
    if (length, which) not in cache:
        cache[length, which] = words.windows(length, which)
    return cache[length, which][first : max(first, last - length + 1)]


def column_of_longs(batch: pa.RecordBatch, name: str, row: int) -> np.ndarray:
    return np.asarray(batch.column(name)[row].values, dtype=np.int64)


def outlines(docs: DataFrame, window: int, length: int) -> DataFrame:
    """Of every whole text: words, digest of its words joined by a space, and its landmarks at the first level."""
    key_id, key_text = row_key(docs)
    rows = docs.select("doc_id", key_id.alias("key_id"), key_text.alias("key_text"), "text")

    def run(batches):
        for batch in batches:
            counts, digests, marks = [], [], []
            texts = batch.column("text")
            for row, first, last, words, cache in texts_of(batch):
                text = texts[row].as_py()
                counts.append(last - first)
                digests.append(hashlib.sha256(b" ".join((text or "").encode().split())).digest())
                runs = np.array([[0, last - first - window + 1]]) if last - first >= window else np.zeros((0, 2), np.int64)
                marks.append(landmarks(windows_of(words, cache, first, last, length), runs, window, length)[0])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("key_id"), batch.column("key_text"),
                 pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), long_list(marks)],
                names=["doc_id", "key_id", "key_text", "n_words", "digest", "marks"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    return rows.mapInArrow(run, f"doc_id {kind}, key_id bigint, key_text bigint, n_words bigint, digest binary, marks array<bigint>")


def repeated_marks(marked: DataFrame) -> DataFrame:
    """(ref, repeated): of each text the landmarks that occur more than once, counting `copies` of every text."""
    single = marked.select("copies", F.explode("marks").alias("mark"))
    twice = written(single.groupBy("mark").agg(F.sum("copies").alias("n")).where("n > 1").select("mark"), "repeated")
    mine = marked.select(reference().alias("ref"), F.explode(F.array_distinct("marks")).alias("mark"))
    return mine.join(twice, "mark", "left_semi").groupBy("ref").agg(F.collect_list("mark").alias("repeated"))


def reference() -> Column:
    """A short name of a text. Two texts of one name would only be told each other's repeated hashes as well."""
    return F.xxhash64("digest")


def extended(texts: DataFrame, window: int, length: int, longer: int | None) -> DataFrame:
    """Texts (digest, copies, runs, repeated, text) after one level: candidates whose landmark repeats stay.

    Returns digest, copies, text, the runs that stay and, when there is a longer level before the last, the
    landmarks at that length; texts without candidates go.
    """

    def run(batches):
        for batch in batches:
            keep, runs_out, marks = [], [], []
            for row, first, last, words, cache in texts_of(batch):
                if batch.column("runs")[row].is_valid:
                    runs = column_of_longs(batch, "runs", row).reshape(-1, 2)
                else:
                    runs = np.array([[0, max(0, last - first - window + 1)]])
                _, own = landmarks(windows_of(words, cache, first, last, length), runs, window, length)
                runs = narrowed(runs, among(own, column_of_longs(batch, "repeated", row).view(np.uint64)))
                if len(runs):
                    keep.append(row)
                    runs_out.append(runs.reshape(-1))
                    marks.append(
                        landmarks(windows_of(words, cache, first, last, longer), runs, window, longer)[0]
                        if longer
                        else np.zeros(0, np.uint64)
                    )
            picked = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [picked.column("digest"), picked.column("copies"), picked.column("text"), long_list(runs_out), long_list(marks)],
                names=["digest", "copies", "text", "runs", "marks"],
            )

    return texts.select("digest", "copies", "text", "runs", "repeated").mapInArrow(
        run, "digest binary, copies bigint, text string, runs array<bigint>, marks array<bigint>"
    )


def whole_windows(texts: DataFrame, window: int) -> DataFrame:
    """The candidate windows themselves: short name of the text, two hashes, and how often it holds them, copies counted."""

    def run(batches):
        for batch in batches:
            names, left, right, counts = [], [], [], []
            refs, copies = batch.column("ref").to_pylist(), batch.column("copies").to_pylist()
            for row, first, last, words, cache in texts_of(batch):
                a = windows_of(words, cache, first, last, window)
                b = windows_of(words, cache, first, last, window, 1)
                runs = column_of_longs(batch, "runs", row).reshape(-1, 2)
                at = np.concatenate([np.arange(s, e) for s, e in runs])
                values, where, n = np.unique(a[at], return_index=True, return_counts=True)
                names.append(np.full(len(values), refs[row]))
                left.append(values)
                right.append((b[at][where] >> np.uint64(32)).astype(np.int64))
                counts.append(n * copies[row])
                if sum(len(x) for x in left) > 200_000:
                    yield rows_of(names, left, right, counts)
                    names, left, right, counts = [], [], [], []
            if names:
                yield rows_of(names, left, right, counts)

    def rows_of(names, left, right, counts):
        longs = [np.concatenate(names), np.concatenate(left).view(np.int64), np.concatenate(right), np.concatenate(counts)]
        return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in longs], names=["ref", "mark", "second", "copies"])

    rows = texts.select(reference().alias("ref"), "copies", "text", "runs")
    return rows.mapInArrow(run, "ref bigint, mark bigint, second bigint, copies bigint")


def removals(texts: DataFrame, window: int) -> DataFrame:
    """(digest, n_removed, kept_digest, spans): what a text loses, spans as begin and end words in turn."""

    def run(batches):
        for batch in batches:
            removed, kept, spans = [], [], []
            texts = batch.column("text")
            for row, first, last, words, cache in texts_of(batch):
                hits = among(windows_of(words, cache, first, last, window), column_of_longs(batch, "repeated", row).view(np.uint64))
                change = np.zeros(last - first + 1, np.int64)
                change[: len(hits)] += hits
                change[window : window + len(hits)] -= hits
                stays = np.cumsum(change)[:-1] == 0
                removed.append(int((~stays).sum()))
                kept.append(hashlib.sha256(b" ".join(compress(texts[row].as_py().encode().split(), stays.tolist()))).digest())
                spans.append(runs_of(~stays).reshape(-1))
            yield pa.RecordBatch.from_arrays(
                [batch.column("digest"), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()), long_list(spans)],
                names=["digest", "n_removed", "kept_digest", "spans"],
            )

    return texts.select("digest", "text", "repeated").mapInArrow(
        run, "digest binary, n_removed bigint, kept_digest binary, spans array<bigint>"
    )


def repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """For every row: doc_id, n_words, n_removed, kept_sha256, spans, and its row key.

    Words are runs outside [\\x20\\x09-\\x0D], unchanged; a null text has none. Every word goes that is covered
    by a window of `window` words whose sequence also starts anywhere else, in the same document or another,
    overlapping or not. `spans` are the removed ranges of words, begin and end in turn, null where nothing
    goes. kept_sha256 is that of the kept words joined by a space. Blank, short and null texts lose nothing;
    an empty table gives an empty result; equal texts lose the same; other columns are not read.

    Texts of equal words are compared once, with their number. Windows grow from SHORTEST words by doubling:
    only where the windows of one length repeat are those of the next compared, and the search ends when no
    candidate is left. Short levels compare one landmark per stretch, the last compares every candidate by
    96 bits. Counts are summed before the shuffle, so a passage that every document holds costs a row per
    task; texts are shuffled once, candidates' texts again.
    """
    lengths = levels(window)
    outline = written(outlines(docs, window, lengths[0]), "outlines")
    texts = written(
        outline.where(F.col("n_words") >= window)
        .groupBy("digest")
        .agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("key_id", "key_text")).alias("at"), F.any_value("marks").alias("marks")),
        "sequences",
    )
    marked = repeated_marks(texts)
    key_id, key_text = row_key(docs)
    source = docs.select(key_id.alias("key_id"), key_text.alias("key_text"), "text")
    if not outline.groupBy("key_id", "key_text").count().where("count > 1").isEmpty():
        source = source.dropDuplicates(["key_id", "key_text"])
    held = texts.select("digest", "copies", "at.key_id", "at.key_text", reference().alias("ref")).join(marked, "ref").drop("ref")
    now = held.join(source, ["key_id", "key_text"]).withColumn("runs", F.lit(None).cast("array<bigint>"))
    short = lengths[:-1] or lengths
    for length, longer in zip(short, [*short[1:], None], strict=True):
        now = written(extended(now, window, length, longer), "candidates")
        if now.isEmpty():
            break
        if longer:
            now = now.drop("marks").withColumn("ref", reference()).join(repeated_marks(now), "ref").drop("ref")
    whole = whole_windows(now, window)
    twice = written(whole.groupBy("mark", "second").agg(F.sum("copies").alias("n")).where("n > 1").drop("n"), "repeated")
    mine = whole.join(twice, ["mark", "second"], "left_semi").groupBy("ref").agg(F.collect_list("mark").alias("repeated"))
    removed = written(removals(now.select("digest", "text", reference().alias("ref")).join(mine, "ref"), window), "removals")
    return outline.drop("marks").join(removed, "digest", "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_removed", F.lit(0)).cast("bigint").alias("n_removed"),
        F.lower(F.hex(F.coalesce("kept_digest", "digest"))).alias("kept_sha256"),
        "spans",
        "key_id",
        "key_text",
    )


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents, whole rows; a text that loses words becomes its kept words joined by a space."""
    a, b, spans = "__repeat_id", "__repeat_text", "__repeat_spans"
    key_id, key_text = row_key(docs)
    lost = repeats(docs, window).where("spans is not null").groupBy("key_id", "key_text").agg(F.any_value("spans").alias(spans))
    joined = docs.withColumn(a, key_id).withColumn(b, key_text).join(lost.withColumnsRenamed({"key_id": a, "key_text": b}), [a, b], "left")

    @F.pandas_udf("string")
    def cut(text, ranges):
        out = []
        for t, r in zip(text, ranges, strict=True):
            words = t.encode().split()
            stays = np.ones(len(words), bool)
            for begin, end in np.asarray(r).reshape(-1, 2):
                stays[begin:end] = False
            out.append(b" ".join(compress(words, stays.tolist())).decode())
        return type(text)(out)

    changed = joined.where(F.col(spans).isNotNull()).withColumn("text", cut("text", spans))
    return joined.where(F.col(spans).isNull()).unionByName(changed).select(*[F.col(f"`{c}`") for c in docs.columns])
