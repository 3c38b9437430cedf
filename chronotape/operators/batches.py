"""Order and size of model batches, input ablations, and drift of vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronotape.functions.hashing import uniform
from chronotape.plans.shared import written
from chronotape.plans.split import Measure, number_rows, plan_split, quantiles, running


def batch_ends(costs: DataFrame, budget: int, place: str = "place") -> DataFrame:
    """Adds `next`: where the batch that starts at each sample ends, as the place of the sample after it.

    Costs laid end to end, a batch from a sample holds all samples that end within its budget. Ends and limits
    go through one ordered pass: the samples that end at or before a limit are counted. A sample over the
    budget is a batch alone.
    """
    laid = running(costs, plan_split(costs, [], place), [Measure("_before", "sum", F.col("cost").cast("bigint"))], then_by=[])
    laid = written(laid.select(place, "cost", "_before"), "laid")
    ends = laid.select((F.col("_before") + F.col("cost")).alias("_at"), F.lit(1).cast("bigint").alias("_ended"))
    limits = laid.select((F.col("_before") + F.lit(budget)).alias("_at"), F.lit(0).cast("bigint").alias("_ended"), place, "cost")
    both = ends.unionByName(limits, allowMissingColumns=True)
    counted = running(both, plan_split(both, [], "_at"), [Measure("_within", "sum", F.col("_ended"))], through=True)
    return counted.filter(F.col(place).isNotNull()).select(place, "cost", F.greatest(F.col(place) + 1, F.col("_within")).alias("next"))


def batch_starts(ends: DataFrame, place: str = "place") -> DataFrame:
    """Places where batches start: what is reached from the first sample by following `next`.

    Pointers are doubled: after k rounds a pointer leads 2^k batches on, and the starts that are known reach
    as many again. So n batches take log n rounds, each a join on the place.
    """
    last = ends.agg(F.max(place)).first()[0]
    # A pointer past the last sample leads nowhere and is left out, here and when pointers are joined.
    jumps = written(ends.filter(F.col("next") <= F.lit(last)).select(F.col(place).alias("_from"), F.col("next").alias("_to")), "jumps")
    reached = written(ends.filter(F.col(place) == 0).select(place), "starts")
    while True:
        further = written(reached.join(jumps, reached[place] == jumps["_from"]).select(F.col("_to").alias(place)), "starts")
        if further.isEmpty():
            return reached
        reached = reached.unionByName(further)
        onward = jumps.select(F.col("_from").alias("_to"), F.col("_to").alias("_next"))
        jumps = written(jumps.join(onward, "_to").select("_from", F.col("_next").alias("_to")), "jumps")


def packed(costs: DataFrame, budget: int, place: str = "place") -> DataFrame:
    """Greedy packing in order: a sample joins the batch while the budget holds, one too large stands alone.

    `costs` has a dense `place` from 0 and a `cost`. Batches are numbered from 0 over the whole order, which
    is never cut: the result is that of one loop over all samples. Returns place, cost and batch.
    """
    ends = written(batch_ends(costs, budget, place), "ends")
    starts = batch_starts(ends, place).withColumn("_start", F.lit(1).cast("bigint"))
    marked = ends.join(starts, place, "left").select(place, "cost", F.coalesce("_start", F.lit(0)).alias("_start"))
    numbered = running(marked, plan_split(marked, [], place), [Measure("batch", "sum", F.col("_start"))], through=True, then_by=[])
    return numbered.select(place, "cost", (F.col("batch") - 1).alias("batch"))


def packing_summary(batches: DataFrame, budget: int) -> DataFrame:
    """Batches, samples, oversize batches, and how full the batches are."""
    per = batches.groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.sum("cost").alias("cost"))
    return per.agg(
        F.count(F.lit(1)).alias("batches"),
        F.sum("n").alias("samples"),
        F.count_if(F.col("cost") > budget).alias("oversize"),
        F.max("n").alias("largest"),
        (F.sum("cost") / (F.count(F.lit(1)) * F.lit(budget))).alias("fill"),
    )


def shuffled(rows: DataFrame, seed: str, block: str, key: str) -> DataFrame:
    """Blocks in an order drawn from the seed, rows within a block likewise: adds block_place and row_place."""
    blocks = rows.select(block).distinct()
    blocks = blocks.withColumn("_u", uniform(seed, "block", F.col(block)))
    placed = number_rows(blocks, plan_split(blocks, [], "_u"), [block], "block_place").drop("_u")
    inner = rows.withColumn("_u", uniform(seed, "row", F.col(block), F.col(key)))
    numbered = number_rows(inner, plan_split(inner, [block], "_u"), [key], "row_place").drop("_u")
    return numbered.join(placed, block)


def last_share(events: DataFrame, percent: int) -> DataFrame:
    """The last `percent` of each client's events, at least one when it has any."""
    turned = events.withColumns({"_neg": -F.col("t"), "_negid": -F.col("id")})
    numbered = number_rows(turned, plan_split(turned, ["client"], "_neg"), ["_negid"], "_back")
    totals = events.groupBy("client").agg(F.count(F.lit(1)).alias("_n"))
    kept = numbered.join(totals, "client").filter(F.col("_back") < F.ceil(F.col("_n") * percent / 100))
    return kept.select(*events.columns)


def content_over_times(events: DataFrame, seed: str) -> DataFrame:
    """Each client's event contents in a drawn order, laid over the client's own moments.

    Rows: client, place (moment in order), t of the slot, content_id of the event put there.
    """
    slots = number_rows(events, plan_split(events, ["client"], "t"), ["id"], "place").select("client", "place", "t")
    drawn = events.select("client", "id", uniform(seed, F.col("client"), F.col("id")).alias("_u"))
    contents = number_rows(drawn, plan_split(drawn, ["client"], "_u"), ["id"], "place").select(
        "client", "place", F.col("id").alias("content_id")
    )
    return slots.join(contents, ["client", "place"])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def drift(left: DataFrame, right: DataFrame, key: str, vector: str) -> DataFrame:
    """Cosine and distance between two vectors of the same key."""
    b = right.select(key, F.col(vector).alias("_b"))
    joined = left.select(key, F.col(vector).alias("_a")).join(b, key)
    a, other = F.col("_a"), F.col("_b")
    gap = F.zip_with(a, other, lambda x, y: x.cast("double") - y.cast("double"))
    return joined.select(
        key,
        (dot(a, other) / (F.sqrt(dot(a, a)) * F.sqrt(dot(other, other)))).alias("cosine"),
        F.sqrt(dot(gap, gap)).alias("l2"),
    )


def drift_summary(found: DataFrame, measure: str) -> DataFrame:
    """Mean and 10, 50, 90 % of a measure."""
    points = quantiles(found, [], measure, {"p10": 0.1, "p50": 0.5, "p90": 0.9})
    mean = found.agg(F.avg(measure).alias("m")).scalar()
    return points.select(F.lit(measure).alias("measure"), mean.alias("mean"), "p10", "p50", "p90")
