"""The best documents for each item by words they share: a dual-tree search.

Items of a block form one tree, the documents of a task form others. A node holds the maximum of every
coordinate (term) over what is below it, so a pair of nodes has an upper bound on all scores between them.
A pair whose bound is below the weakest k-th score of its items is dropped with everything below it.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronotape.llm.rows import prefix_sums, shuffle_partitions
from chronotape.plans.shared import written

#: Terms of the items that are searched for in one pass over the documents, about; an item is never cut.
BLOCK_TERMS = 1 << 14
#: Items, and documents, at the foot of a tree, and children of a node.
LEAF_ITEMS, LEAF_DOCUMENTS, FAN_OUT = 4, 32, 8
#: Postings (document, term) in one tree of documents.
TREE_POSTINGS = 2_000_000
#: Leaves of documents that are scored between two looks at the k-th scores.
LEAVES_AT_ONCE = 16
#: Bytes of a text whose words are listed at a time.
CHUNK_BYTES = 1 << 22

# A term is a longest run of ASCII letters, digits and characters beyond ASCII; all others become blanks.
_BLANKED = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()


def terms_of(text: bytes) -> Counter:
    """Every term of a UTF-8 text, A to Z in lower case, with its number of occurrences."""
    text, found, at = text.translate(_BLANKED), Counter(), 0
    while at < len(text):
        end = len(text) if at + CHUNK_BYTES >= len(text) else text.find(b" ", at + CHUNK_BYTES)
        end = len(text) if end < 0 else end
        found.update(text[at:end].split())
        at = end
    return found


def item_terms(items: DataFrame) -> DataFrame:
    """item, item_id, terms (array<binary>), counts: one row per row of `items` with a term."""
    kind = dict(items.dtypes)["item_id"]

    def run(batches):
        for batch in batches:
            found = [terms_of(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in batch.column(2).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([list(f) for f in found], pa.list_(pa.binary())),
                 pa.array([list(f.values()) for f in found], pa.list_(pa.int64()))],
                names=["item", "item_id", "terms", "counts"],
            )

    numbered = items.select(F.monotonically_increasing_id().alias("item"), "item_id", "text")
    return numbered.mapInArrow(run, f"item bigint, item_id {kind}, terms array<binary>, counts array<bigint>").where(F.size("terms") > 0)


def postings(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """document, doc_id, n_terms, terms and counts (those in `vocabulary`) of every document with a term."""

    def run(batches):
        known = vocabulary.get
        for batch in batches:
            out: tuple[list, ...] = ([], [], [])
            for text in batch.column(2).cast(pa.binary()):
                found = terms_of(text.as_buffer().to_pybytes()) if text.is_valid else Counter()
                mine = sorted((i, n) for t, n in found.items() if (i := known(t)) is not None)
                for column, value in zip(out, (found.total(), [i for i, _ in mine], [n for _, n in mine]), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1).cast(pa.int64()), pa.array(out[0], pa.int64()), pa.array(out[1], pa.list_(pa.int32())), pa.array(out[2], pa.list_(pa.int64()))],
                names=["document", "doc_id", "n_terms", "terms", "counts"],
            )

    numbered = docs.select(F.monotonically_increasing_id().alias("document"), F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return numbered.mapInArrow(run, "document bigint, doc_id bigint, n_terms bigint, terms array<int>, counts array<bigint>").where("n_terms > 0")


def flat(lists: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    """All values of a list column, and where each row's begin."""
    ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
    return lists.flatten().to_numpy(zero_copy_only=False).astype(kind), np.concatenate([[0], ends]).astype(np.int64)


def impacts(found: DataFrame, weights: np.ndarray, documents: int, occurrences: int) -> DataFrame:
    """document, doc_id, terms, impacts, in ranges of the terms that count most in a document: like documents lie together."""

    def run(batches):
        for batch in batches:
            terms, begins = flat(batch.column("terms"), np.int64)
            counts, _ = flat(batch.column("counts"), np.int64)
            # Exact whatever the size of the corpus: Python's own integers.
            lengths = np.array([75 + (25 * n * documents) // occurrences for n in batch.column("n_terms").to_pylist()], np.int64)
            values = (1_000_000_000 * counts) // (1000 * counts + 12 * np.repeat(lengths, np.diff(begins)))
            scores = weights[terms] * values
            first, second = [], []
            for a, b in zip(begins, begins[1:], strict=False):
                top = terms[a:b][np.argsort(-scores[a:b], kind="stable")[:2]].tolist() + [-1, -1]
                first.append(top[0])
                second.append(top[1])
            yield pa.RecordBatch.from_arrays(
                [batch.column("document"), batch.column("doc_id"), pa.array(first, pa.int32()), pa.array(second, pa.int32()), batch.column("terms"),
                 pa.ListArray.from_arrays(pa.array(begins.astype(np.int32)), pa.array(values))],
                names=["document", "doc_id", "first", "second", "terms", "impacts"],
            )

    rows = found.where(F.size("terms") > 0).mapInArrow(
        run, "document bigint, doc_id bigint, first int, second int, terms array<int>, impacts array<bigint>"
    )
    order = ["first", "second", "document"]
    return rows.repartitionByRange(shuffle_partitions(rows), *order).sortWithinPartitions(*order).drop("first", "second")


class Level:
    """Nodes of one height: their terms and the maxima of them, flat, and where each node's begin."""

    def __init__(self, nodes: np.ndarray, terms: np.ndarray, values: np.ndarray, width: int):
        key = nodes * width + terms
        order = np.argsort(key, kind="stable")
        key = key[order]
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        self.nodes, self.terms = key[starts] // width, key[starts] % width
        self.values = np.maximum.reduceat(values[order], starts) if len(starts) else values[:0]
        self.count = int(nodes.max()) + 1 if len(nodes) else 0
        self.begins = np.searchsorted(self.nodes, np.arange(self.count + 1))

    def bounds(self, which: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Upper bounds of all scores between nodes of this level and one node of items."""
        return row_sums(self.begins, which, self.terms, self.values, weights)


def row_sums(begins: np.ndarray, which: np.ndarray, terms: np.ndarray, values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Sum of weight * value over the entries of each of the rows `which`."""
    sizes = begins[which + 1] - begins[which]
    ends = np.cumsum(sizes)
    at = np.repeat(begins[which] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
    sums = np.concatenate([[0], np.cumsum(weights[terms[at]] * values[at])])
    return sums[ends] - sums[ends - sizes]


class Documents:
    """The tree over some documents: leaves of neighbours, FAN_OUT children to a node."""

    def __init__(self, document: np.ndarray, doc_id: list, begins: np.ndarray, terms: np.ndarray, values: np.ndarray, width: int):
        self.document, self.doc_id, self.begins, self.terms, self.values = document, doc_id, begins, terms, values
        rows = np.repeat(np.arange(len(document)), np.diff(begins))
        self.levels = [Level(rows // LEAF_DOCUMENTS, terms, values, width)]
        while self.levels[-1].count > FAN_OUT:
            below = self.levels[-1]
            self.levels.append(Level(below.nodes // FAN_OUT, below.terms, below.values, width))

    def below(self, level: int, nodes: np.ndarray) -> np.ndarray:
        children = (nodes[:, None] * FAN_OUT + np.arange(FAN_OUT)).ravel()
        return children[children < self.levels[level - 1].count]

    def rows(self, leaves: np.ndarray) -> np.ndarray:
        rows = (leaves[:, None] * LEAF_DOCUMENTS + np.arange(LEAF_DOCUMENTS)).ravel()
        return rows[rows < len(self.document)]


class Items:
    """The tree over the items of a block. A node is (first item, last, its maxima, its children)."""

    def __init__(self, weights: np.ndarray):
        #: items x terms
        self.weights = weights
        heaviest = np.lexsort((-weights.max(axis=1, initial=0), weights.argmax(axis=1) if weights.size else np.zeros(len(weights))))
        self.order = heaviest
        nodes = [(i, min(i + LEAF_ITEMS, len(heaviest)), ()) for i in range(0, len(heaviest), LEAF_ITEMS)]
        self.height = 0
        while len(nodes) > 1:
            nodes = [(g[0][0], g[-1][1], tuple(g)) for g in (nodes[i : i + FAN_OUT] for i in range(0, len(nodes), FAN_OUT))]
            self.height += 1
        self.top = nodes[0]
        self.maxima: dict[tuple[int, int], np.ndarray] = {}

    def maximum(self, node) -> np.ndarray:
        key = node[:2]
        if key not in self.maxima:
            self.maxima[key] = self.weights[self.order[key[0] : key[1]]].max(axis=0)
        return self.maxima[key]

    def members(self, node) -> np.ndarray:
        return self.order[node[0] : node[1]]


class Best:
    """The k best documents of each item so far: by score, then doc_id (null last), then document."""

    def __init__(self, count: int, k: int):
        self.k = k
        self.least = np.zeros(count, np.int64)
        self.found: list[list[tuple]] = [[] for _ in range(count)]

    def offer(self, item: int, scores: np.ndarray, rows: np.ndarray, tree: Documents) -> None:
        good = np.flatnonzero((scores > 0) & (scores >= self.least[item]))
        if not len(good):
            return
        # Of equal scores all stay until they are ordered by doc_id.
        if len(good) > self.k:
            cut = np.partition(scores[good], len(good) - self.k)[len(good) - self.k]
            good = good[scores[good] >= cut]
        more = []
        for i in good.tolist():
            row = rows[i]
            doc_id = tree.doc_id[row]
            more.append((-int(scores[i]), doc_id is None, doc_id or 0, int(tree.document[row])))
        kept = self.found[item] = sorted(self.found[item] + more)[: self.k]
        if len(kept) == self.k:
            self.least[item] = -kept[-1][0]


def search_tree(items: Items, tree: Documents, best: Best) -> None:
    """Both trees at once, from pairs of top nodes down; pairs below the weakest k-th score are dropped."""
    top = len(tree.levels) - 1
    waiting = [(items.top, items.height, top, np.arange(tree.levels[top].count))]
    while waiting:
        node, height, level, nodes = waiting.pop()
        members = items.members(node)
        bounds = tree.levels[level].bounds(nodes, items.maximum(node))
        kept = np.flatnonzero((bounds > 0) & (bounds >= best.least[members].min()))
        if not len(kept):
            continue
        if height and height >= level:
            waiting += [(child, height - 1, level, nodes[kept]) for child in node[2]]
        elif level:
            waiting.append((node, height, level - 1, tree.below(level, nodes[kept])))
        else:
            order = kept[np.argsort(-bounds[kept], kind="stable")]
            for begin in range(0, len(order), LEAVES_AT_ONCE):
                some = order[begin : begin + LEAVES_AT_ONCE]
                some = some[bounds[some] >= best.least[members].min()]
                if not len(some):
                    break  # the others have smaller bounds
                rows = tree.rows(nodes[some])
                for item in members.tolist():
                    best.offer(item, row_sums(tree.begins, rows, tree.terms, tree.values, items.weights[item]), rows, tree)


def trees(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[Documents]:
    """Trees over the documents of a task, as they come, of bounded size."""
    held, count = [], 0

    def built() -> Documents:
        table = pa.Table.from_batches(held).combine_chunks()
        terms, begins = flat(table.column("terms").combine_chunks(), np.int64)
        values, _ = flat(table.column("impacts").combine_chunks(), np.int64)
        return Documents(table.column("document").to_numpy(), table.column("doc_id").to_pylist(), begins, terms, values, width)

    for batch in batches:
        held.append(batch)
        count += len(batch.column("terms").flatten())
        if count >= TREE_POSTINGS:
            yield built()
            held, count = [], 0
    if any(b.num_rows for b in held):
        yield built()


def candidates(ranged: DataFrame, numbers: list[int], weights: np.ndarray, k: int) -> DataFrame:
    """item, score, doc_id, document: the k best documents that a task has for each item."""

    def run(batches):
        items, best = Items(weights), Best(len(numbers), k)
        for tree in trees(batches, weights.shape[1]):
            search_tree(items, tree, best)
        rows = [(numbers[i], -s, None if null else d, n) for i, found in enumerate(best.found) for s, null, d, n in found]
        columns = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["item", "score", "doc_id", "document"])

    return ranged.mapInArrow(run, "item bigint, score bigint, doc_id bigint, document bigint")


def search(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the k documents with the highest scores above 0 for every item.

    The score sums w * ((10^9 tf) div (1000 tf + 12 m)) over the terms of the item, repeats included, with
    w = floor(1000 ln((2N + 2) / (2df + 1))) and m = 75 + (25 n N) div L over all documents with a term.
    Equal scores are ranked by doc_id (a whole number; null last). Rows are documents and items of their own,
    also when they are equal or have no id; a null text has no terms, an item without terms no results. Empty
    tables give an empty result; other columns are not read.

    Items are taken in blocks, by the number of their terms. For each block the terms, at most BLOCK_TERMS
    and those of one item, go to the driver and from there to the tasks with the code.
    """
    asked = written(item_terms(items).withColumn("size", F.size("terms").cast("bigint")), "items")
    placed, _ = prefix_sums(asked.select("item", "size"), ["item"], {"before": "size"})
    placed = written(placed.select("item", F.floor(F.col("before") / BLOCK_TERMS).alias("block")), "blocks")
    blocks = [r["block"] for r in placed.select("block").distinct().orderBy("block").collect()]
    out, totals = [], None
    for block in blocks:
        rows = asked.join(placed.where(F.col("block") == block), "item").select("item", "terms", "counts").orderBy("item").collect()
        vocabulary = {t: i for i, t in enumerate(sorted({bytes(t) for r in rows for t in r["terms"]}))}
        found = written(postings(docs, vocabulary), "postings")
        if totals is None:
            totals = found.agg(F.count(F.lit(1)).alias("documents"), F.sum("n_terms").alias("occurrences")).first()
        documents, occurrences = totals["documents"], int(totals["occurrences"] or 1)
        # At most as many rows as the block has terms.
        frequencies = found.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")).collect()
        per_term = np.zeros(len(vocabulary), np.int64)
        for r in frequencies:
            per_term[r["term"]] = math.floor(1000 * math.log((2 * documents + 2) / (2 * r["n"] + 1)))
        weights = np.zeros((len(rows), len(vocabulary)), np.int64)
        for i, r in enumerate(rows):
            for term, count in zip(r["terms"], r["counts"], strict=True):
                weights[i, vocabulary[bytes(term)]] = count * per_term[vocabulary[bytes(term)]]
        ranged = written(impacts(found, per_term, documents, occurrences), "impacts")
        out.append(written(candidates(ranged, [r["item"] for r in rows], weights, k), "candidates"))
    if not out:
        kind = dict(items.dtypes)["item_id"]
        return items.sparkSession.createDataFrame([], f"item_id {kind}, rank int, doc_id bigint, score bigint")
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "document")
    ranked = reduce(DataFrame.unionByName, out).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.join(asked.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
