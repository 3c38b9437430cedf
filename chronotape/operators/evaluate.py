"""Metrics of predictions (y 0/1, score), exact under ties and any partitioning.

Rows are first counted per score, so the ordered passes run over distinct
scores. Sums of whole numbers stay decimals; only the last division is a double.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronotape.functions.hashing import DIGITS, SEPARATOR, uniform
from chronotape.plans.shared import written
from chronotape.plans.split import Measure, match, number_rows, plan_split, quantiles, running, target_rows

EPSILON = 2.220446049250313e-16  # float64 machine epsilon, the clip of the log-loss


def score_counts(rows: DataFrame, keys: Sequence[str] = (), weight: Column | None = None, score: str = "score") -> DataFrame:
    """Positives and negatives per key and distinct score, written: all metrics read this table."""
    w = F.lit(1).cast("bigint") if weight is None else weight
    y = F.col("y") == 1
    counts = rows.groupBy(*keys, F.col(score).alias("score")).agg(
        F.coalesce(F.sum(F.when(y, w)), F.lit(0)).alias("pos"),
        F.coalesce(F.sum(F.when(~y, w)), F.lit(0)).alias("neg"),
    )
    return written(counts, "scores")


def _totals(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    totals = counts.groupBy(*keys).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    if keys:
        return match(counts, totals, keys, "inner")
    return counts.select("*", *[totals.select(c).scalar().alias(c) for c in ("P", "N")])


def auc(counts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve per key; null when one class is missing."""
    keys = list(keys)
    ordered = running(
        counts, plan_split(counts, keys, "score"), [Measure("below", "sum", F.col("neg"))], then_by=[]
    )
    pairs = F.col("pos").cast("decimal(19,0)") * (2 * F.col("below") + F.col("neg")).cast("decimal(19,0)")
    sums = ordered.groupBy(*keys).agg(F.sum(pairs).alias("_pairs"), F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    area = F.col("_pairs").cast("double") / (2.0 * F.col("P") * F.col("N"))
    return sums.select(*keys, "P", "N", F.when((F.col("P") > 0) & (F.col("N") > 0), area).alias("auc"))


def _above(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts at or above every score, highest first."""
    turned = counts.withColumn("_neg_score", -F.col("score"))
    split = plan_split(turned, list(keys), "_neg_score")
    measures = [Measure("tp", "sum", F.col("pos")), Measure("fp", "sum", F.col("neg"))]
    return _totals(running(turned, split, measures, through=True, then_by=[]), keys)


def average_precision(counts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Area under the precision-recall curve as a sum of steps; ties are one step."""
    keys = list(keys)
    curve = _above(counts, keys)
    step = F.col("pos") / F.col("P") * (F.col("tp") / (F.col("tp") + F.col("fp")))
    return curve.groupBy(*keys).agg(F.when(F.max("P") > 0, F.sum(F.when(F.col("P") > 0, step))).alias("pr_auc"))


def log_loss(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    chance = F.least(F.lit(1 - EPSILON), F.greatest(F.lit(EPSILON), F.col("score")))
    loss = -F.when(F.col("y") == 1, F.ln(chance)).otherwise(F.ln(1 - chance))
    return rows.groupBy(*keys).agg(F.avg(loss).alias("log_loss"))


def at_threshold(rows: DataFrame, threshold: float | Column, keys: Sequence[str] = ()) -> DataFrame:
    """Confusion counts and precision, recall, F1 of `score >= threshold` (0 where undefined)."""
    said, y = F.col("score") >= threshold, F.col("y") == 1
    counts = rows.groupBy(*keys).agg(
        F.count_if(said & y).alias("tp"),
        F.count_if(said & ~y).alias("fp"),
        F.count_if(~said & y).alias("fn"),
        F.count_if(~said & ~y).alias("tn"),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")

    def ratio(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(F.lit(0.0))

    return counts.select(
        "*",
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def best_threshold(counts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The score with the largest F1 when it is the threshold; the lowest of equals."""
    curve = _above(counts, list(keys))
    f1 = 2 * F.col("tp") / (F.col("tp") + F.col("fp") + F.col("P"))
    ranked = curve.withColumn("_f1", f1)
    return ranked.groupBy(*keys).agg(
        F.max_by("score", F.struct("_f1", -F.col("score"))).alias("threshold"), F.max("_f1").alias("f1")
    )


def metrics(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """ROC-AUC, PR-AUC and log-loss per key, with the counts of both classes."""
    keys = list(keys)
    counts = score_counts(rows, keys)
    area, precision, loss = auc(counts, keys), average_precision(counts, keys), log_loss(rows, keys)
    if keys:
        return match(match(area, precision, keys), loss, keys)
    return area.select("*", precision.select("pr_auc").scalar().alias("pr_auc"), loss.select("log_loss").scalar().alias("log_loss"))


# Cumulative chances of the Poisson distribution with mean 1, for 0, 1, 2, ... copies of a row.
POISSON_ONE = (
    0.367879441171442, 0.735758882342885, 0.919698602928606, 0.981011843123846, 0.996340153172656,
    0.999405815182418, 0.999916758850712, 0.999989750803325, 0.999998874797402, 0.999999888574522,
)


#: Resamples of a paired comparison unless a caller asks for another number.
DRAWS = 1000


#: Rows whose copies in all draws are held as numbers at a time.
CHUNK_ROWS = 2048
#: Rows of a task that makes or adds up copies: each of them stands for a number per draw.
DRAWN_ROWS = 8192


def copy_counts(keys: Sequence[str], draws: int, seed: str) -> np.ndarray:
    """Copies of every row in every draw, rows x draws: a Poisson number by the hash uniform(seed, draw, row), never over 10."""
    begun = [hashlib.sha256(f"{seed}{SEPARATOR}{d}{SEPARATOR}".encode()) for d in range(draws)]
    digests = bytearray()
    for key in keys:
        tail = key.encode()
        for start in begun:
            h = start.copy()
            h.update(tail)
            digests += h.digest()[:8]
    bits = np.frombuffer(bytes(digests), ">u8").reshape(len(keys), draws) >> np.uint64(64 - 4 * DIGITS)
    return np.searchsorted(np.array(POISSON_ONE), bits / float(16**DIGITS), side="right").astype(np.uint8)


def _drawn_rows(rows: DataFrame, row: str, draws: int, seed: str, tasks: int) -> DataFrame:
    """Rows (key, y, score_a, score_b) with their copies in all draws, a byte per draw: hashed once per row and written."""
    scores = [F.col(f"score_{n}").cast("double").alias(f"score_{n}") for n in ("a", "b")]
    some = rows.select(F.col(row).cast("string").alias("key"), (F.col("y") == 1).alias("y"), *scores)
    some = some.filter("key is not null and y is not null and (score_a is not null or score_b is not null)")

    def counted(batches):
        for batch in batches:
            for begin in range(0, batch.num_rows, CHUNK_ROWS):
                part = batch.slice(begin, CHUNK_ROWS)
                copies = [x.tobytes() for x in copy_counts(part.column("key").to_pylist(), draws, seed)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(copies, pa.binary())], [*part.schema.names, "copies"])

    # A row costs a hash per draw: it is the number of rows, not of bytes, that makes the tasks.
    dealt = some.repartition(tasks, "key", "score_a", "score_b")
    return written(dealt.mapInArrow(counted, "key string, y boolean, score_a double, score_b double, copies binary"), "copies")


def _copies(group: pa.Table, draws: int) -> np.ndarray:
    """The copies of the rows of a group, rows x draws."""
    return np.frombuffer(b"".join(group.column("copies").to_pylist()), np.uint8).reshape(group.num_rows, draws).astype(np.int64)


def paired_draws(rows: DataFrame, row: str, draws: int = DRAWS, seed: str = "0") -> DataFrame:
    """ROC-AUC and PR-AUC of two scores (score_a, score_b) over the same bootstrap draws.

    Each draw gives a row a Poisson number of copies by a hash of (draw, row), made once per row: a byte per draw
    travels with the row. Rows are laid out in ranges of each score, as many as the rows ask for: a task adds up the
    copies of its rows as vectors over the draws and accumulates them from the highest score down. The first pass
    finds the totals of every range, the second starts from what the ranges above hold. What is shuffled besides the
    rows are vectors, one per range.
    """
    slices = max(1, -(-rows.count() // min(target_rows(rows), DRAWN_ROWS)))
    both = F.array(*[F.struct(F.lit(n).alias("which"), F.col(f"score_{n}").alias("score")) for n in ("a", "b")])
    one = _drawn_rows(rows, row, draws, seed, slices).select("key", "y", "copies", F.explode(both).alias("x"))
    one = one.select("key", "y", "copies", "x.*").filter("score is not null")
    ranged = one.repartitionByRange(2 * slices, "which", "score", "key")
    laid = written(ranged.withColumn("part", F.spark_partition_id()), "scores")
    # Scores that go on in the next range, two per range at most: each is an element of the order by itself.
    ends = laid.groupBy("which", "part").agg(F.array_distinct(F.array(F.min("score"), F.max("score"))).alias("ends"))
    shared = ends.select("which", F.explode("ends").alias("tie")).groupBy("which", "tie").agg(F.count(F.lit(1)).alias("n"))
    shared = written(shared.filter("n > 1").select(F.col("which").alias("tied"), "tie"), "ties")
    laid = laid.join(F.broadcast(shared), (laid["which"] == F.col("tied")) & (laid["score"] == F.col("tie")), "left").drop("tied")

    def totals(group: pa.Table) -> pa.Table:
        pos, neg = np.zeros(draws, np.int64), np.zeros(draws, np.int64)
        for begin in range(0, group.num_rows, CHUNK_ROWS):
            some = group.slice(begin, CHUNK_ROWS)
            weights, y = _copies(some, draws), some.column("y").to_numpy()
            pos, neg = pos + weights[y].sum(axis=0), neg + weights[~y].sum(axis=0)
        head = [group.column(c).slice(0, 1).combine_chunks() for c in ("which", "part", "tie")]
        top = pa.array([max(group.column("score").to_numpy())])
        return pa.table([*head, top, pa.array([pos.tolist()]), pa.array([neg.tolist()])], names=["which", "part", "tie", "top", "pos", "neg"])

    vector = "which string, part int, tie double, top double, pos array<bigint>, neg array<bigint>"
    sums = written(laid.groupBy("which", "part", "tie").applyInArrow(totals, vector), "totals")
    long = sums.select("which", F.when(F.col("tie").isNull(), F.col("part")).alias("part"), "top", F.posexplode(F.arrays_zip("pos", "neg")).alias("draw", "n"))
    long = long.groupBy("which", "part", "top", "draw").agg(F.sum("n.pos").alias("pos"), F.sum("n.neg").alias("neg"))
    above = Window.partitionBy("which", "draw").orderBy(F.desc("top")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("which", "draw")
    carried = long.select(
        "which", "part", "draw", "pos", "neg",
        *[F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"{c}_above") for c in ("pos", "neg")],
        *[F.sum(c).over(whole).alias(f"{c}_all") for c in ("pos", "neg")],
    )
    carried = written(carried, "carried")
    names = ["pos_above", "neg_above", "pos_all", "neg_all"]
    packed = F.array_sort(F.collect_list(F.struct("draw", *names)))
    # A list has one entry per draw.
    carry = carried.filter("part is not null").groupBy("which", "part").agg(packed.alias("d")).select("which", "part", *[F.col(f"d.{n}").alias(n) for n in names])

    def areas(group: pa.Table, start: pa.Table) -> pa.Table:
        group = group.sort_by([("score", "descending")])
        tp, fp, positives, negatives = (np.array(start.column(n)[0].as_py(), np.int64) for n in names)
        scores = group.column("score").to_numpy()
        pairs, steps = np.zeros(draws, np.int64), np.zeros(draws)
        open_pos, open_neg = np.zeros(draws, np.int64), np.zeros(draws, np.int64)
        for begin in range(0, len(scores), CHUNK_ROWS):
            some = group.slice(begin, CHUNK_ROWS)
            weights, y = _copies(some, draws), some.column("y").to_numpy()[:, None]
            mine = scores[begin : begin + CHUNK_ROWS]
            cuts = np.flatnonzero(np.concatenate([[True], mine[1:] != mine[:-1]]))
            pos, neg = np.add.reduceat(weights * y, cuts), np.add.reduceat(weights * ~y, cuts)
            pos[0], neg[0] = pos[0] + open_pos, neg[0] + open_neg
            # A score that goes on in the next rows is counted with them.
            after = begin + CHUNK_ROWS
            if after < len(scores) and scores[after] == mine[-1]:
                open_pos, open_neg, pos, neg = pos[-1], neg[-1], pos[:-1], neg[:-1]
            else:
                open_pos, open_neg = np.zeros(draws, np.int64), np.zeros(draws, np.int64)
            if len(pos):
                upto, false = tp + np.cumsum(pos, axis=0), fp + np.cumsum(neg, axis=0)
                pairs += (pos * (2 * (negatives - false) + neg)).sum(axis=0)
                steps += np.where(pos > 0, pos * (upto / np.maximum(upto + false, 1)), 0.0).sum(axis=0)
                tp, fp = upto[-1], false[-1]
        columns = [pa.array([x.tolist()]) for x in (pairs, steps, positives, negatives)]
        return pa.table([group.column("which").slice(0, 1).combine_chunks(), *columns], names=["which", "pairs", "steps", "positives", "negatives"])

    found = laid.filter("tie is null").drop("tie").groupBy("which", "part").cogroup(carry.groupBy("which", "part")).applyInArrow(
        areas, "which string, pairs array<bigint>, steps array<double>, positives array<bigint>, negatives array<bigint>"
    )
    cells = found.select("which", F.posexplode(F.arrays_zip("pairs", "steps", "positives", "negatives")).alias("draw", "n")).select("which", "draw", "n.*")
    false = F.col("neg_above") + F.col("neg")
    precision = (F.col("pos_above") + F.col("pos")) / F.greatest(F.col("pos_above") + F.col("pos") + false, F.lit(1))
    ties = carried.filter("part is null").select(
        "which", "draw", (F.col("pos") * (2 * (F.col("neg_all") - false) + F.col("neg"))).alias("pairs"), (F.col("pos") * precision).alias("steps"),
        F.col("pos_all").alias("positives"), F.col("neg_all").alias("negatives"),
    )
    cells = cells.unionByName(ties)
    measured = cells.groupBy("which", "draw").agg(
        F.sum(F.col("pairs").cast("decimal(19,0)")).cast("double").alias("pairs"), F.sum("steps").alias("steps"),
        F.max("positives").cast("double").alias("P"), F.max("negatives").cast("double").alias("N"),
    )
    both_classes = measured.filter((F.col("P") > 0) & (F.col("N") > 0)).select(
        "which", "draw", (F.col("pairs") / (2.0 * F.col("P") * F.col("N"))).alias("auc"), (F.col("steps") / F.col("P")).alias("pr_auc")
    )
    wide = both_classes.groupBy("draw").agg(
        *[F.max(F.when(F.col("which") == n, F.col(m))).alias(f"{m}_{n}") for m in ("auc", "pr_auc") for n in ("a", "b")]
    )
    # A draw without both classes measures nothing.
    return wide.filter("auc_a is not null and auc_b is not null")


def paired_summary(drawn: DataFrame, metric: str) -> DataFrame:
    """Mean difference b - a, its 2.5 and 97.5 %, and the share of draws where b is not better."""
    gaps = drawn.select((F.col(f"{metric}_b") - F.col(f"{metric}_a")).alias("gap"))
    edges = quantiles(gaps, [], "gap", {"low": 0.025, "high": 0.975})
    facts = gaps.agg(
        F.count(F.lit(1)).alias("draws"),
        F.avg("gap").alias("mean"),
        F.avg((F.col("gap") <= 0).cast("int")).alias("not_better"),
    )
    return facts.select("*", *[edges.select(c).scalar().alias(c) for c in ("low", "high")])


def holdout(rows: DataFrame, row: str, share: float, seed: str = "0") -> DataFrame:
    """Adds `held_out`: the same share of each label, by a hash order."""
    drawn = rows.withColumn("_u", uniform(seed, F.col(row)))
    placed = number_rows(drawn, plan_split(drawn, ["y"], "_u"), [row], "_place")
    totals = rows.groupBy("y").agg(F.count(F.lit(1)).alias("_n"))
    return placed.join(totals, "y").select(
        *rows.columns, (F.col("_place") < F.floor(F.col("_n") * F.lit(share))).alias("held_out")
    )


def folds(rows: DataFrame, row: str, k: int, seed: str = "0") -> DataFrame:
    """Adds `fold` 0..k-1 with every label spread evenly."""
    drawn = rows.withColumn("_u", uniform(seed, F.col(row)))
    placed = number_rows(drawn, plan_split(drawn, ["y"], "_u"), [row], "_place")
    return placed.select(*rows.columns, (F.col("_place") % k).cast("int").alias("fold"))


def hits(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Top-1 and top-5 hits and mean loss of rows (target, ranked ids, loss)."""
    place = F.array_position("ranked", F.col("target"))
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(place == 1).alias("top1"),
        F.count_if((place >= 1) & (place <= 5)).alias("top5"),
        F.avg("loss").alias("mean_loss"),
    )


def in_band(measured: DataFrame, targets: DataFrame) -> DataFrame:
    """Whether a metric lies in its declared band: value within a tolerance, or [low, high]."""
    joined = measured.join(targets, "metric", "left")
    low = F.coalesce(F.col("target") * (1 - F.col("tolerance")), F.col("low"))
    high = F.coalesce(F.col("target") * (1 + F.col("tolerance")), F.col("high"))
    return joined.select(
        "metric", "value", low.alias("band_low"), high.alias("band_high"), F.col("value").between(low, high).alias("ok")
    )


def feature_aucs(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """AUC of every single feature against y, nulls left out; constant features are dropped."""
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("score")) for f in features])
    long = rows.select("y", F.explode(cells).alias("c")).select("y", "c.*").filter("score is not null")
    counts = score_counts(long, ["feature"])
    varied = counts.groupBy("feature").agg(F.count(F.lit(1)).alias("n_scores")).filter("n_scores > 1")
    return auc(counts.join(varied.select("feature"), "feature", "left_semi"), ["feature"])


def aligned(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of two prediction sets that do not pair up: missing, repeated, or with different labels."""
    a = left.groupBy(key).agg(F.count(F.lit(1)).alias("left_rows"), F.min("y").alias("left_y"))
    b = right.groupBy(key).agg(F.count(F.lit(1)).alias("right_rows"), F.min("y").alias("right_y"))
    both = a.join(b, key, "full_outer").fillna(0, subset=["left_rows", "right_rows"])
    bad = (
        (F.col("left_rows") != 1)
        | (F.col("right_rows") != 1)
        | ~F.col("left_y").eqNullSafe(F.col("right_y"))
    )
    return both.filter(bad)


def with_support(rows: DataFrame, keys: Sequence[str], least: int = 10) -> DataFrame:
    """Metrics per segment and over all; null where a class has fewer than `least` rows."""
    keys = list(keys)
    every = rows.select(*[F.lit("all").alias(k) for k in keys], "y", "score")
    found = metrics(rows.select(*keys, "y", "score").unionByName(every), keys)
    enough = (F.col("P") >= least) & (F.col("N") >= least)
    return found.select(
        *keys, "P", "N", F.when(enough, F.col("auc")).alias("auc"), F.when(enough, F.col("pr_auc")).alias("pr_auc")
    )


def seed_noise(runs: DataFrame) -> DataFrame:
    """Mean, range and sample deviation over seeds of the difference b - a (seed, scenario, value)."""
    gaps = runs.groupBy("seed").agg(
        (F.max(F.when(F.col("scenario") == "b", F.col("value"))) - F.max(F.when(F.col("scenario") == "a", F.col("value")))).alias("gap")
    )
    return gaps.agg(
        F.count("gap").alias("seeds"),
        F.avg("gap").alias("mean"),
        (F.max("gap") - F.min("gap")).alias("spread"),
        F.stddev_samp("gap").alias("deviation"),
    )


def breakdown(rows: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Count, mean loss and hit rate by each dimension on its own, in one pass."""
    grouped = rows.groupingSets([[F.col(d)] for d in dims], *[F.col(d) for d in dims])
    return grouped.agg(
        F.grouping_id().alias("level"),
        F.count(F.lit(1)).alias("n"),
        F.avg("loss").alias("mean_loss"),
        F.avg(F.col("hit").cast("int")).alias("hit_rate"),
    )


def history_bin(n: Column, edges: Sequence[int]) -> Column:
    """Label of a history length, such as 10-49 or 50+."""
    label = F.lit(f"{edges[-1]}+")
    for low, high in reversed(list(zip([0, *edges[:-1]], edges))):
        label = F.when(n < high, F.lit(f"{low}-{high - 1}")).otherwise(label)
    return label
