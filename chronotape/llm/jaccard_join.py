"""Similarity join on word shingles: MinHash bands, Bayesian pruning, exact verification."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import accumulate
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronotape.llm.components import components
from chronotape.llm.rows import apply_copies, row_key, shuffle_partitions
from chronotape.llm.wordhash import slices, text_shingles
from chronotape.plans.shared import written

WORDS = 5
THRESHOLD = 0.8
#: A pair is dropped when, after the MinHash values compared so far, it reaches the threshold with less than this probability.
TOLERANCE = 1e-6
#: Four values a band: at similarity 0.8 a pair misses all 32 bands once in 2e7, at 0.1 it shares one once in 300.
BANDS, ROWS = 32, 4
VALUES = BANDS * ROWS
FIRST_BANDS = 6
#: Values compared before each decision.
STEP = 16
#: Documents, and shingles, that a block of a group holds about; two blocks meet in one task.
BLOCK_DOCUMENTS, BLOCK_SHINGLES = 256, 1 << 20
#: Columns of the incidence matrix that are multiplied at a time.
COLUMNS = 8192

_rng = np.random.RandomState(20240229)
_XOR = _rng.randint(0, 1 << 32, VALUES, np.uint64).astype(np.uint32)[:, None]
_MULTIPLY = (_rng.randint(0, 1 << 32, VALUES, np.uint64).astype(np.uint32) | np.uint32(1))[:, None]


def minhash(shingles: np.ndarray) -> np.ndarray:
    """VALUES minima of a set of shingles, each under its own hash; 16 bits of each, which agree by chance once in 65536."""
    low = np.full(VALUES, np.uint32(0xFFFFFFFF))
    for at in range(0, len(shingles), 1 << 14):
        v = (shingles[at : at + (1 << 14)] >> np.uint64(32)).astype(np.uint32)[None, :] ^ _XOR
        v *= _MULTIPLY
        v ^= v >> np.uint32(15)
        v *= np.uint32(0x85EBCA6B)
        v ^= v >> np.uint32(13)
        low = np.minimum(low, v.min(axis=1))
    return low.astype(np.uint16)


def least_matches(threshold: float, tolerance: float) -> list[tuple[int, int]]:
    """(values compared, fewest matches that keep a pair) for every step.

    With a uniform prior, after m matches of n the similarity is Beta(m + 1, n - m + 1), and it reaches t with
    the probability that a binomial of n + 1 draws at t gives at most m.
    """
    out = []
    for n in range(STEP, VALUES + 1, STEP):
        chances = accumulate(comb(n + 1, k) * threshold**k * (1 - threshold) ** (n + 1 - k) for k in range(n + 2))
        out.append((n, next(m for m, p in enumerate(chances) if p >= tolerance)))
    return out


def plausible(signs: np.ndarray, sizes: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float, steps) -> np.ndarray:
    """Which of the pairs (left, right) may reach the threshold: sizes first, then MinHash values step by step."""
    low, high = np.minimum(sizes[left], sizes[right]), np.maximum(sizes[left], sizes[right])
    alive = np.flatnonzero(low >= threshold * high - 1e-9)
    matches = np.zeros(len(alive), np.int32)
    begin = 0
    for end, least in steps:
        if not len(alive):
            break
        matches += (signs[left[alive], begin:end] == signs[right[alive], begin:end]).sum(axis=1, dtype=np.int32)
        stays = matches >= least
        alive, matches, begin = alive[stays], matches[stays], end
    return alive


class Forest:
    """What one task has connected."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def grow(self, n: int) -> None:
        self.parent.extend(range(len(self.parent), n))

    def join(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        self.parent[max(a, b)] = min(a, b)


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of equal keys together, from batches sorted by the keys."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows - 1, bool)
        for c in columns:
            change |= c[1:] != c[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for begin, end in zip(cuts, cuts[1:], strict=False):
            now = tuple(c[begin] for c in columns)
            if held and now != last:
                yield pa.Table.from_batches(held)
                held = []
            last = now
            held.append(batch.slice(begin, end - begin))
    if held:
        yield pa.Table.from_batches(held)


def signatures(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """Row key, digest and size of the shingle set, and its MinHash values; digest null without words."""
    key_id, key_text = row_key(docs)
    rows = docs.select("doc_id", key_id.alias("key_id"), key_text.alias("key_text"), "text")

    def run(batches):
        for batch in batches:
            digests, sizes, signs = [], [], []
            for _, count, found in slices(batch.column("text")):
                windows = found.windows(words)
                for row in range(count):
                    s = text_shingles(found, row, words, windows)
                    sizes.append(len(s))
                    digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    signs.append(minhash(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("key_id"), batch.column("key_text"),
                 pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(signs, pa.binary())],
                names=["doc_id", "key_id", "key_text", "digest", "size", "signs"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    found = rows.mapInArrow(run, f"doc_id {kind}, key_id bigint, key_text bigint, digest binary, size bigint, signs binary")
    return found.withColumn("row", F.monotonically_increasing_id())


def dealt(members: DataFrame, group: str, nodes: DataFrame | None) -> DataFrame:
    """Members of groups dealt to pairs of blocks (low, high): each task gets two blocks of one group at most.

    `members` has node, `blocks` (how many its group is cut into) and the group; a group of one block stays whole.
    """
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    out = members.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)))
    out = out.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other")).drop("other")
    if nodes is not None:
        out = out.join(nodes, "node")
    keys = [group, "low", "high"]
    return out.repartition(shuffle_partitions(members), *keys).sortWithinPartitions(*keys)


def pairs_of(block: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs that this pair of blocks is to compare."""
    if low == high:
        return np.triu_indices(len(block), 1)
    left, right = np.flatnonzero(block == low), np.flatnonzero(block == high)
    return np.repeat(left, len(right)), np.tile(right, len(left))


def candidate_links(nodes: DataFrame, first: int, end: int, threshold: float, tolerance: float) -> DataFrame:
    """Links (a, b) between the labels of nodes (node, label, size, signs) that share one of the bands
    first <= band < end, pass the Bayesian pruning and have different labels.

    Buckets of one label are left out before anything is sent. A task joins what it sees and returns one link
    per label, to the smallest label it is connected with."""
    bands = nodes.select(
        "node",
        "label",
        F.explode(
            F.transform(
                F.sequence(F.lit(first), F.lit(end - 1)),
                lambda b: F.xxhash64(b, F.substring("signs", b * (2 * ROWS) + 1, F.lit(2 * ROWS))),
            )
        ).alias("band"),
    )
    full = bands.groupBy("band").agg(F.count(F.lit(1)).alias("members"), F.min("label").alias("least"), F.max("label").alias("most"))
    full = written(full.where("least <> most").select("band", "members"), "bands")
    cut = full.select("band", F.ceil(F.col("members") / BLOCK_DOCUMENTS).alias("blocks"))
    steps = least_matches(threshold, tolerance)

    def run(batches):
        seen: dict[bytes, int] = {}
        forest = Forest(0)
        for table in grouped(batches, ["band", "low", "high"]):
            n = table.num_rows
            if n < 2:
                continue
            ids = table.column("label").to_pylist()
            signs = np.frombuffer(b"".join(table.column("signs").to_pylist()), np.uint16).reshape(n, VALUES)
            sizes = table.column("size").to_numpy()
            block = table.column("block").to_numpy()
            left, right = pairs_of(block, table.column("low")[0].as_py(), table.column("high")[0].as_py())
            codes = np.unique(np.array(ids, object), return_inverse=True)[1]
            apart = codes[left] != codes[right]
            left, right = left[apart], right[apart]
            alive = plausible(signs, sizes, left, right, threshold, steps)
            for i in np.union1d(left[alive], right[alive]):
                seen.setdefault(ids[i], len(seen))
            forest.grow(len(seen))
            for i, j in zip(left[alive].tolist(), right[alive].tolist(), strict=True):
                forest.join(seen[ids[i]], seen[ids[j]])
        nodes = list(seen)
        least: dict[int, bytes] = {}
        for i, node in enumerate(nodes):
            r = forest.root(i)
            least[r] = min(least.get(r, node), node)
        for begin in range(0, len(nodes), 10_000):
            part = range(begin, min(len(nodes), begin + 10_000))
            links = [(nodes[i], least[forest.root(i)]) for i in part if nodes[i] != least[forest.root(i)]]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.binary()), pa.array([x for _, x in links], pa.binary())], names=["a", "b"])

    sent = dealt(bands.join(cut, "band"), "band", nodes.select("node", "signs", "size"))
    return sent.mapInArrow(run, "a binary, b binary")


def candidate_components(nodes: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """(node, label) of the nodes that are connected with others by candidate links.

    The first bands connect most of what there is; the others only look at buckets of several components."""
    once = nodes.withColumn("label", F.col("node"))
    found = components(candidate_links(once, 0, FIRST_BANDS, threshold, tolerance))
    tagged = nodes.join(found, "node", "left").withColumn("linked", F.col("label").isNotNull())
    tagged = written(tagged.withColumn("label", F.coalesce("label", "node")).select("node", "label", "linked", "size", "signs"), "tagged")
    more = components(candidate_links(tagged, FIRST_BANDS, BANDS, threshold, tolerance))
    named = more.select(F.col("node").alias("label"), F.col("label").alias("top"))
    return (
        tagged.select("node", "label", "linked")
        .join(named, "label", "left")
        .where(F.col("linked") | F.col("top").isNotNull())
        .select("node", F.coalesce("top", "label").alias("label"))
    )


def verified_links(docs: DataFrame, nodes: DataFrame, candidates: DataFrame, words: int, threshold: float, tolerance: float) -> DataFrame:
    """Per node and task: how many documents it is linked to by exact similarity, and a node of its tree (null at its root)."""
    sizes = candidates.join(nodes, "node").select("node", "label", "size", "members", "key_id", "key_text")
    cut = sizes.groupBy("label").agg(
        F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_DOCUMENTS), F.ceil(F.sum("size") / BLOCK_SHINGLES)).alias("blocks")
    )
    needed = written(sizes.join(cut, "label").drop("size"), "needed")
    key_id, key_text = row_key(docs)
    texts = docs.select(key_id.alias("key_id"), key_text.alias("key_text"), "text")
    # Both sides grow with the corpus, so they are merged at every size. Of rows with equal id and text, one stands for the node.
    with_text = needed.join(texts.hint("merge"), ["key_id", "key_text"]).drop("key_id", "key_text")
    steps = least_matches(threshold, tolerance)

    def run(batches):
        for table in grouped(batches, ["label", "low", "high"]):
            ids, first, count, block, sets = {}, [], [], [], []
            column = table.column("node").to_pylist()
            of, at = table.column("members").to_pylist(), table.column("block").to_pylist()
            row = 0
            for _, rows, found in slices(table.column("text")):
                windows = found.windows(words)
                for r in range(rows):
                    if column[row] not in ids:
                        ids[column[row]] = len(first)
                        first.append(column[row])
                        count.append(of[row])
                        block.append(at[row])
                        sets.append(text_shingles(found, r, words, windows))
                    row += 1
            n = len(first)
            if n < 2:
                continue
            left, right = pairs_of(np.array(block), table.column("low")[0].as_py(), table.column("high")[0].as_py())
            signs = np.stack([minhash(s) for s in sets])
            size = np.array([len(s) for s in sets])
            alive = plausible(signs, size, left, right, threshold, steps)
            if not len(alive):
                continue
            left, right = left[alive], right[alive]
            shared = intersections(sets, left, right)
            similar = shared >= threshold * (size[left] + size[right] - shared) - 1e-9
            left, right = left[similar], right[similar]
            members = np.array(count, np.int64)
            links = np.bincount(left, members[right], n) + np.bincount(right, members[left], n)
            forest = Forest(n)
            tree = [None] * n
            for i, j in zip(left.tolist(), right.tolist(), strict=True):
                forest.join(i, j)
            for i in range(n):
                tree[i] = first[forest.root(i)]
            linked = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays(
                [pa.array([first[i] for i in linked], pa.binary()), pa.array(links[linked].astype(np.int64)), pa.array([tree[i] for i in linked], pa.binary())],
                names=["node", "links", "tree"],
            )

    return dealt(with_text, "label", None).mapInArrow(run, "node binary, links bigint, tree binary")


def intersections(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact sizes of the intersections of the pairs, by products of incidence matrices, some columns at a time."""
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values = np.concatenate(sets)
    order = np.argsort(values, kind="stable")
    values, rows = values[order], rows[order]
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    column = np.cumsum(new) - 1
    # Only shingles that two texts share can count.
    common = np.flatnonzero(np.bincount(column) > 1)
    total = np.zeros((len(sets), len(sets)), np.float64)
    place = np.full(column[-1] + 1, -1, np.int64)
    place[common] = np.arange(len(common))
    mine = place[column]
    rows, mine = rows[mine >= 0], mine[mine >= 0]
    for begin in range(0, len(common), COLUMNS):
        now = slice(*np.searchsorted(mine, [begin, begin + COLUMNS]))
        x = np.zeros((len(sets), min(COLUMNS, len(common) - begin)), np.float32)
        x[rows[now], mine[now] - begin] = 1
        total += x @ x.T
    return total[left, right].astype(np.int64)


def near_copies(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """For every row: doc_id, class_id, n_links, kept, and its row key.

    Texts are compared by their sets of `words` consecutive words; a link joins two documents whose sets have
    a Jaccard similarity of `threshold` or more, and a class is a connected component of links, named by its
    smallest doc_id (null when all its ids are null). n_links counts the documents a row is linked to, copies
    included. Texts of fewer words are one shingle; blank and null texts have none, no links and a class of
    their own. Of each class the row of the smallest doc_id is `kept`.

    Documents with equal sets are one node. Nodes that share a band of MinHash values are compared value by
    value and dropped once the posterior probability of the threshold is below `tolerance`; what remains is
    grouped into components, inside which all pairs are pruned in the same way and verified on the whole
    sets. Large buckets and components are cut into blocks, and every two blocks meet in a task of their own;
    tasks return counts and trees, never the pairs.
    """
    rows = written(signatures(docs, words), "signatures")
    best = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row", "key_id", "key_text")
    nodes = written(
        rows.where("digest is not null")
        .groupBy(F.col("digest").alias("node"))
        .agg(F.min(best).alias("best"), F.count(F.lit(1)).alias("members"), F.any_value("size").alias("size"), F.any_value("signs").alias("signs"))
        .select("*", "best.key_id", "best.key_text"),
        "nodes",
    )
    candidates = candidate_components(nodes, threshold, tolerance)
    found = written(verified_links(docs, nodes, candidates, words, threshold, tolerance), "verified")
    labels = components(found.where("node <> tree").select(F.col("node").alias("a"), F.col("tree").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    tagged = (
        nodes.select("node", "best", "members")
        .join(labels, "node", "left")
        .join(links, "node", "left")
        .withColumn("class", F.coalesce("label", "node"))
    )
    heads = tagged.groupBy("class").agg(F.min("best").alias("head"))
    classes = written(
        tagged.join(heads, "class").select(
            F.col("node").alias("digest"), "head", (F.col("members") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")
        ),
        "classes",
    )
    blank = F.col("digest").isNull()
    return rows.drop("signs", "size").join(classes, "digest", "left").select(
        "doc_id",
        F.when(blank, F.col("doc_id")).otherwise(F.col("head.doc_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        (blank | (F.col("row") == F.col("head.row"))).alias("kept"),
        "key_id",
        "key_text",
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents with one of each class of near copies, whole rows."""
    return apply_copies(docs, near_copies(docs).select("key_id", "key_text", F.col("kept").cast("int").alias("copies")))
