"""A trie of conversation prefixes: ternary search trees per range shard, merged where shards meet."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronotape.llm.rows import prefix_sums, shuffle_partitions
from chronotape.plans.shared import written

#: Turns of a conversation that are one path; a longer conversation goes on in the next band, below its node.
BAND = 4096
#: Turn ids, and conversations, of one tree.
TREE_TURNS = 200_000
TREE_ROWS = 32_768
#: Identifiers that one row of a list of members holds.
PART_IDS = 512

NO_IDS = hashlib.sha256(b"").hexdigest()

_SHAPE = pa.schema(
    [("kind", pa.int8()), ("key", pa.binary()), ("parent_key", pa.binary()), ("conv_id", pa.int64()), ("depth", pa.int64()),
     ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()),
     ("saved_tokens", pa.int64()), ("size", pa.int64()), ("spine", pa.int64()), ("first", pa.int64()), ("ids", pa.string())]
)
_COLUMNS = (
    "kind tinyint, key binary, parent_key binary, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, "
    "n_leaves bigint, saved_tokens bigint, size bigint, spine bigint, first bigint, ids string"
)
#: Rows of a shard: complete nodes, nodes of its two border paths, lists of members that end at a border node.
_NODE, _BORDER, _ENDS = 0, 1, 2


class Ternary:
    """A ternary search tree of id sequences; every node is one prefix.

    Parallel lists hold the nodes. A node is made after the node of its prefix, so a walk over the nodes from
    the last to the first meets all longer prefixes before a prefix: that is the whole traversal.
    """

    def __init__(self):
        self.key, self.low, self.high, self.down = [], [], [], []
        self.above, self.depth, self.size = [], [], []
        self.members, self.least = [], []
        self.top = -1

    def node(self, key: int, above: int, depth: int, size: int) -> int:
        at = len(self.key)
        for column, value in (
            (self.key, key), (self.low, -1), (self.high, -1), (self.down, -1), (self.above, above),
            (self.depth, depth), (self.size, size), (self.members, 0), (self.least, None),
        ):
            column.append(value)
        return at

    def step(self, above: int, key: int, depth: int, size: int) -> int:
        """The node of `key` below `above`, made if it is not there."""
        at = self.top if above < 0 else self.down[above]
        if at < 0:
            made = self.node(key, above, depth, size)
            if above < 0:
                self.top = made
            else:
                self.down[above] = made
            return made
        while True:
            here = self.key[at]
            if key == here:
                return at
            side = self.low if key < here else self.high
            if side[at] < 0:
                side[at] = made = self.node(key, above, depth, size)
                return made
            at = side[at]

    def insert(self, path: list[int], sizes: list[int], members: int, least: int) -> int:
        at = -1
        for depth, (key, size) in enumerate(zip(path, sizes, strict=True)):
            at = self.step(at, key, depth, size)
            self.members[at] += members
            if self.least[at] is None or least < self.least[at]:
                self.least[at] = least
        return at

    def walk(self, path: list[int]) -> list[int]:
        out, at = [], -1
        for depth, key in enumerate(path):
            at = self.step(at, key, depth, 0)
            out.append(at)
        return out


def medians(count: int) -> Iterator[int]:
    """0 to count - 1, the middle first, then the middles of both halves: sorted sequences make a balanced tree."""
    waiting = [(0, count)]
    for low, high in waiting:
        if low < high:
            middle = (low + high) // 2
            yield middle
            waiting += [(low, middle), (middle + 1, high)]


def tree_rows(paths: list[tuple], spine: int, named: bool) -> dict[str, list]:
    """Rows of one shard from its sorted paths (path, sizes, conv_id, ends, further).

    `ends` is false if the sequence goes on in the next band; `further` are children, leaves and savings there.

    A path begins with its root; `named` says that a root is the smallest member of the node it stands for.
    """
    groups: list[list] = []
    for path, sizes, conv_id, ends_here, *more in paths:
        if not groups or groups[-1][0] != path:
            groups.append([path, sizes, conv_id, 0, [], [0, 0, 0]])
        group = groups[-1]
        group[3] += 1
        if ends_here:
            group[4].append(conv_id)
        group[5] = [a + b for a, b in zip(group[5], more, strict=True)]
    tree = Ternary()
    ends: dict[int, list[int]] = {}
    further: dict[int, list[int]] = {}
    for i in medians(len(groups)):
        path, sizes, least, count, ids, more = groups[i]
        end = tree.insert(path, sizes, count, least)
        ends[end], further[end] = ids, more
    if named:
        tree.least = [key if above < 0 else least for key, above, least in zip(tree.key, tree.above, tree.least, strict=True)]
    left, right = tree.walk(groups[0][0]), tree.walk(groups[-1][0])
    border = {*left, *right}
    nodes = len(tree.key)
    children, leaves, saved = [0] * nodes, [0] * nodes, [0] * nodes
    for at in range(nodes - 1, -1, -1):
        more = further.get(at, (0, 0, 0))
        children[at] += more[0]
        leaves[at] += more[1]
        saved[at] += more[2]
        if at in border:
            continue  # counted when the shards are merged
        leaves[at] += not children[at]
        saved[at] += (tree.members[at] - 1) * tree.size[at]
        above = tree.above[at]
        if above < 0:
            continue
        children[above] += 1
        leaves[above] += leaves[at]
        saved[above] += saved[at]
    out: dict[str, list] = {n: [] for n in _SHAPE.names}

    def put(**row) -> None:
        for name, column in out.items():
            column.append(row.get(name))

    keys: dict[int, bytes] = {}
    for side, path in enumerate((left, right)):
        digest, before = hashlib.blake2b(digest_size=16), None
        for at in path:
            digest.update(tree.key[at].to_bytes(8, "little", signed=True))
            key = digest.copy().digest()
            # What both border paths share is counted on the left one.
            fresh = at not in keys
            keys[at] = key
            put(
                kind=_BORDER, key=key, parent_key=before, depth=tree.depth[at], size=tree.size[at], spine=spine + side,
                conv_id=tree.least[at] if fresh else None, n_convs=tree.members[at] if fresh else 0,
                n_children=children[at] if fresh else 0, n_leaves=leaves[at] if fresh else 0, saved_tokens=saved[at] if fresh else 0,
            )
            before = key
    for at in range(nodes):
        ids = ends.get(at, [])
        if at in border:
            for begin in range(0, len(ids), PART_IDS):
                part = ids[begin : begin + PART_IDS]
                put(kind=_ENDS, key=keys[at], first=part[0], ids=",".join(map(str, part)))
            continue
        above = tree.above[at]
        put(
            kind=_NODE, parent_key=keys.get(above), conv_id=tree.least[at], depth=tree.depth[at],
            parent_conv_id=None if above < 0 or above in border else tree.least[above], n_convs=tree.members[at], n_children=children[at],
            n_leaves=leaves[at], saved_tokens=saved[at], ids=hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
        )
    return out


def shards(paths: DataFrame, named: bool) -> DataFrame:
    """Trees over range shards of (root, path, sizes, conv_id, ends, further_children, further_leaves, further_saved)."""
    order = ["root", "path", "conv_id"]
    ranged = paths.repartitionByRange(shuffle_partitions(paths), *order).sortWithinPartitions(*order)
    ranged = ranged.select("*", F.spark_partition_id().alias("part"))

    def run(batches):
        held, turns, trees = [], 0, 0
        for batch in batches:
            part = batch.column("part")[0].as_py() if batch.num_rows else 0
            for row in batch.to_pylist():
                held.append(
                    ([row["root"], *row["path"]], [0, *row["sizes"]], row["conv_id"], row["ends"],
                     row["further_children"], row["further_leaves"], row["further_saved"])
                )
                turns += len(row["path"]) + 1
                if turns >= TREE_TURNS or len(held) >= TREE_ROWS:
                    yield pa.RecordBatch.from_pydict(tree_rows(held, (part << 33) + 2 * trees, named), schema=_SHAPE)
                    held, turns, trees = [], 0, trees + 1
        if held:
            yield pa.RecordBatch.from_pydict(tree_rows(held, (part << 33) + 2 * trees, named), schema=_SHAPE)

    return ranged.mapInArrow(run, _COLUMNS)


def hashed_members(parts: DataFrame) -> DataFrame:
    """key, ends_sha256: the parts of each node, in order, run through one digest; a task holds one part at a time."""
    ordered = parts.select("key", "first", "ids").repartition(shuffle_partitions(parts), "key").sortWithinPartitions("key", "first")

    def run(batches):
        key, digest = None, None
        for batch in batches:
            keys, digests = [], []
            for this, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if this != key:
                    if key is not None:
                        keys.append(key)
                        digests.append(digest.hexdigest())
                    key, digest = this, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            yield pa.RecordBatch.from_pydict({"key": pa.array(keys, pa.binary()), "ends_sha256": pa.array(digests, pa.string())})
        if key is not None:
            yield pa.RecordBatch.from_pydict({"key": pa.array([key], pa.binary()), "ends_sha256": pa.array([digest.hexdigest()], pa.string())})

    return ordered.mapInArrow(run, "key binary, ends_sha256 string")


def merged(rows: DataFrame) -> DataFrame:
    """The nodes of all shards: what lies on border paths is added up by node, and summed along the paths.

    Border nodes form a trie of their own, as many rows as shards times the depth. A node belongs to the
    first border path through it. Each path sums its own nodes from the deepest on; the sums of all paths
    through a node then make up everything below it.
    """
    border = rows.where(F.col("kind") == _BORDER)
    nodes = border.groupBy("key").agg(
        F.min("conv_id").alias("conv_id"),
        F.first("depth").alias("depth"),
        F.first("parent_key").alias("parent_key"),
        F.first("size").alias("size"),
        F.sum("n_convs").alias("n_convs"),
        F.sum("n_children").alias("inner_children"),
        F.sum("n_leaves").alias("inner_leaves"),
        F.sum("saved_tokens").alias("inner_saved"),
        F.min("spine").alias("owner"),
    )
    below = nodes.where("parent_key is not null").groupBy("parent_key").agg(F.count(F.lit(1)).alias("more"))
    nodes = nodes.join(below.withColumnRenamed("parent_key", "key"), "key", "left").select(
        "key", "conv_id", "depth", "parent_key", "n_convs", "owner",
        (F.col("inner_children") + F.coalesce("more", F.lit(0))).alias("n_children"),
        ((F.col("n_convs") - 1) * F.col("size") + F.col("inner_saved")).alias("own_saved"),
        (F.col("inner_leaves") + F.when(F.col("inner_children") + F.coalesce("more", F.lit(0)) == 0, 1).otherwise(0)).alias("own_leaves"),
    )
    nodes = written(nodes, "border")
    paths = border.select("key", "spine", "depth").join(nodes.select("key", "owner", "own_saved", "own_leaves"), "key")
    deeper = Window.partitionBy("spine").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    mine = F.col("owner") == F.col("spine")
    sums = paths.select(
        "key",
        F.sum(F.when(mine, F.col("own_saved")).otherwise(0)).over(deeper).alias("saved_tokens"),
        F.sum(F.when(mine, F.col("own_leaves")).otherwise(0)).over(deeper).alias("n_leaves"),
    )
    sums = sums.groupBy("key").agg(F.sum("saved_tokens").alias("saved_tokens"), F.sum("n_leaves").alias("n_leaves"))
    parents = nodes.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("border_parent"))
    found = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    whole = (
        nodes.join(sums, "key")
        .join(hashed_members(rows.where(F.col("kind") == _ENDS)), "key", "left")
        .join(parents, "parent_key", "left")
        .withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_IDS)))
        .withColumn("parent_conv_id", F.col("border_parent"))
        .select(*found)
    )
    inner = (
        rows.where(F.col("kind") == _NODE)
        .join(parents, "parent_key", "left")
        .withColumn("parent_conv_id", F.coalesce("parent_conv_id", "border_parent"))
        .withColumn("ends_sha256", F.col("ids"))
        .select(*found)
    )
    return whole.unionByName(inner)


def trie(turns: DataFrame, members: DataFrame) -> DataFrame:
    """One row per distinct prefix of the sequences: the nodes of their trie, the empty prefix included.

    `turns` has conv_id, place (from 0, gapless), id (of the turn) and size; `members` has every conv_id once,
    also of sequences without turns. Returns conv_id (the smallest member), depth, parent_conv_id (null at
    depth 0), n_convs, n_children, n_leaves, saved_tokens (sum over the subtree of (n_convs - 1) * size of
    the last turn) and ends_sha256 (of the members that end here, ascending, joined by commas). Empty tables
    give an empty result.

    Sequences are cut into bands of BAND turns, so no group is larger. A band hangs below the nodes where the
    band above it ends, and bands are worked off from the deepest, so that each hands up what it has below.
    """
    band = F.floor(F.col("place") / BAND).cast("int")
    packed = F.sort_array(F.collect_list(F.struct("place", "id", "size")))
    slices = turns.groupBy("conv_id", band.alias("band")).agg(packed.alias("turns"))
    slices = slices.select("conv_id", "band", F.col("turns.id").alias("path"), F.col("turns.size").alias("sizes"))
    none = F.array().cast("array<bigint>")
    whole = written(
        members.select("conv_id", F.lit(0).alias("band")).join(slices, ["conv_id", "band"], "full_outer").select(
            "conv_id", "band", F.coalesce("path", none).alias("path"), F.coalesce("sizes", none).alias("sizes")
        ),
        "paths",
    )
    last = whole.agg(F.max("band")).first()[0] or 0
    bands, roots = [], None
    for b in range(last + 1):
        these = whole.where(F.col("band") == b).drop("band")
        these = these.withColumn("root", F.lit(0).cast("bigint")) if roots is None else these.join(roots, "conv_id")
        bands.append(these)
        if b < last:
            full = these.where(F.size("path") == BAND)
            named = full.groupBy("root", "path").agg(F.min("conv_id").alias("next"))
            roots = written(full.join(named, ["root", "path"]).select("conv_id", F.col("next").alias("root")), "roots")
    out, below = [], None
    for b in range(last, -1, -1):
        these = bands[b].select("root", "path", "sizes", "conv_id")
        names = ["further_children", "further_leaves", "further_saved"]
        if below is not None:
            these = these.join(below, "conv_id", "left")
        else:
            these = these.select("*", *[F.lit(0).alias(n) for n in names])
        if b < last:
            these = these.join(bands[b + 1].select("conv_id", F.lit(False).alias("ends")), "conv_id", "left")
        else:
            these = these.withColumn("ends", F.lit(True))
        these = these.select(
            "root", "path", "sizes", "conv_id", F.coalesce("ends", F.lit(True)).alias("ends"),
            *[F.coalesce(F.col(n), F.lit(0)).cast("bigint").alias(n) for n in names],
        )
        nodes = written(merged(written(shards(these, b > 0), "shards")), "nodes")
        if b:
            # The root of a band is the node that the band above ends with, under the same smallest member.
            below = nodes.where(F.col("depth") == 0).select(
                "conv_id", F.col("n_children").alias(names[0]), F.col("n_leaves").alias(names[1]), F.col("saved_tokens").alias(names[2])
            )
            nodes = nodes.where(F.col("depth") > 0).withColumn("depth", F.col("depth") + b * BAND)
        out.append(nodes)
    found = out[0]
    for nodes in out[1:]:
        found = found.unionByName(nodes)
    return found


def dictionary(conversations: DataFrame) -> DataFrame:
    """role, text, id, size: every distinct turn once, numbered in the order of role, then text; nulls are empty."""
    distinct = conversations.select(_filled("role"), _filled("text")).groupBy("role", "text").agg(F.lit(1).cast("bigint").alias("one"))
    numbered, _ = prefix_sums(distinct, ["role", "text"], {"id": "one"})
    return numbered.select("role", "text", "id", F.length("text").cast("bigint").alias("size"))


def _filled(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")).alias(name)


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, place, id, size: the turns as numbers, in the order of turn (null first), role and text.

    Null roles and texts are empty. Rows without a conv_id belong to no conversation. Rows that are equal are
    turns of their own. Other columns are not read.
    """
    plain = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").isNotNull().alias("has_turn"), "turn", _filled("role"), _filled("text")
    )
    coded = plain.join(dictionary(plain), ["role", "text"]).select("conv_id", "has_turn", "turn", "id", "size", F.lit(1).cast("bigint").alias("one"))
    rows, _ = prefix_sums(coded, ["has_turn", "turn", "id"], {"place": "one"}, ("conv_id",))
    return rows.select("conv_id", "place", "id", "size")


def rebuilt(turns: DataFrame, every: int, most: int) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin like another one: (turns, members) for `trie`.

    Conversation c gets the first h turns of conversation c - c % every, all if it has fewer and none if it is
    not there, then its own turns after its first h; h is the CRC-32 of c in decimal, modulo `most`.
    """
    crc = F.crc32(F.col("conv_id").cast("string").cast("binary"))
    h = (crc % most).cast("bigint")
    members = written(turns.select("conv_id").distinct(), "members")
    # Fewer than `most` turns of each head.
    heads = (
        turns.where((F.col("conv_id") % every == 0) & (F.col("place") < most - 1))
        .groupBy(F.col("conv_id").alias("head_id"))
        .agg(F.sort_array(F.collect_list(F.struct("place", "id", "size"))).alias("head"))
    )
    taken = members.join(heads, F.col("conv_id") - F.col("conv_id") % every == F.col("head_id"), "left").select(
        "conv_id", F.slice(F.coalesce("head", F.array().cast("array<struct<place:bigint,id:bigint,size:bigint>>")), F.lit(1), h.cast("int")).alias("head")
    )
    taken = written(taken, "heads")
    begun = taken.select("conv_id", F.explode("head").alias("t")).select("conv_id", "t.place", "t.id", "t.size")
    own = (
        turns.where(F.col("place") >= h)
        .join(taken.select("conv_id", F.size("head").alias("n")), "conv_id")
        .select("conv_id", (F.col("place") - h + F.col("n")).alias("place"), "id", "size")
    )
    return begun.unionByName(own), members
