"""Telemetry of training runs: records per run file, rewinds on resume, progress."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from chronotape.plans.shared import new_path
from chronotape.plans.split import Measure, plan_split, running
from chronotape.sources.growing import growing_lines
from chronotape.sources.raw import read_jsonl

RECORD = (
    "kind string, step bigint, epoch bigint, epochs bigint, planned_epochs bigint, total_steps bigint, "
    "max_steps bigint, resumed boolean, loss double, val_loss double, tokens bigint, seconds double"
)


def tail_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Complete lines of a folder of growing JSONL files as a stream; offsets live in the query's checkpoint."""
    return growing_lines(spark, folder).select("value")


def records(lines: DataFrame) -> DataFrame:
    """Parsed lines; a malformed one keeps its text, so it can be counted."""
    return read_jsonl(lines, RECORD)


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over everything that is there, into a table of the shared folder, and read the table."""
    return drained(stream, name, mode)[0]


def drained(stream: DataFrame, name: str, mode: str = "append") -> tuple[DataFrame, DataFrameReader]:
    """What a stateful stream has emitted at the end of the input, and a reader of the state that it still holds (key, value).

    Append mode emits a window or session when the watermark has passed it; the others are in the state.
    """
    spark = stream.sparkSession
    path, state = new_path(spark, name), new_path(spark, f"{name}-state")
    query = (
        stream.writeStream.format("parquet")
        .outputMode(mode)
        .option("path", path)
        .option("checkpointLocation", state)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path), spark.read.format("statestore").option("path", state)


def effective(rows: DataFrame, run: str, place: str) -> DataFrame:
    """Step and epoch records that survive later resumes, the last of each number.

    A `run` record takes back earlier steps above its step and earlier epochs
    from its epoch on. `place` numbers the records of a run file in order.
    """
    turned = rows.withColumn("_neg", -F.col(place))
    resumed = F.col("kind") == "run"
    later = running(
        turned,
        plan_split(turned, [run], "_neg"),
        [
            Measure("_step", "min", F.when(resumed, F.col("step"))),
            Measure("_epoch", "min", F.when(resumed, F.col("epoch"))),
        ],
    )
    kept_step = (F.col("kind") == "step") & (F.col("_step").isNull() | (F.col("step") <= F.col("_step")))
    kept_epoch = (F.col("kind") == "epoch") & (F.col("_epoch").isNull() | (F.col("epoch") < F.col("_epoch")))
    number = F.when(F.col("kind") == "step", F.col("step")).otherwise(F.col("epoch"))
    names = [c for c in rows.columns if c not in (run, "kind")]
    last = F.max_by(F.struct(*names), F.col(place)).alias("x")
    return (
        later.filter(kept_step | kept_epoch)
        .groupBy(run, "kind", number.alias("number"))
        .agg(last)
        .select(run, "kind", "x.*")
    )


def progress(rows: DataFrame, run: str, place: str) -> DataFrame:
    """Where each run is: last step, totals, completed epochs, last and best validation loss, resumes."""
    kept = effective(rows, run, place)
    runs = rows.filter("kind = 'run'").groupBy(run).agg(
        F.max_by(F.struct("step", "epoch", "epochs", "planned_epochs", "total_steps", "max_steps"), place).alias("r"),
        F.count_if(F.coalesce("resumed", F.lit(False))).alias("resumes"),
    )
    step, epoch = F.col("kind") == "step", F.col("kind") == "epoch"
    judged = epoch & F.col("val_loss").isNotNull()
    now = kept.groupBy(run).agg(
        F.max(F.when(step, F.col("step"))).alias("last_step"),
        F.max_by(F.when(step, F.col("epoch")), F.when(step, F.col("step"))).alias("step_epoch"),
        F.max_by(F.when(epoch, F.col("step")), F.when(epoch, F.col("epoch"))).alias("epoch_step"),
        F.count_if(epoch).alias("completed_epochs"),
        F.max_by(F.when(judged, F.col("val_loss")), F.when(judged, F.col("epoch"))).alias("val_loss"),
        F.min(F.when(judged, F.col("val_loss"))).alias("best_val_loss"),
    )
    longer = (F.col("r.epochs") > F.col("r.planned_epochs")) & (F.col("r.planned_epochs") > 0)
    total = F.when(
        longer, F.bround(F.col("r.total_steps") * F.col("r.epochs") / F.col("r.planned_epochs")).cast("bigint")
    ).otherwise(F.col("r.total_steps"))
    return runs.join(now, run, "full_outer").select(
        run,
        F.greatest("r.step", "last_step", "epoch_step").alias("step"),
        F.coalesce("step_epoch", "r.epoch").alias("epoch"),
        F.least(total, F.col("r.max_steps")).alias("total_steps"),
        F.coalesce(longer, F.lit(False)).alias("estimated"),
        F.coalesce("completed_epochs", F.lit(0)).alias("completed_epochs"),
        "val_loss",
        "best_val_loss",
        F.coalesce("resumes", F.lit(0)).alias("resumes"),
    )


CHANGES = "run string, action string, kind string, number bigint, place bigint"
HELD = "steps array<bigint>, epochs array<bigint>"


def rewinds(stream: DataFrame) -> DataFrame:
    """The rewind rule as a stream: every record as `put`, and a `drop` for each number a resume takes back.

    The state of a run is the numbers that stand, at most one per step and epoch of the run.
    """

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else ([], [])
        standing = {"step": set(held[0]), "epoch": set(held[1])}
        out: list[tuple] = []
        records = pd.concat(list(batches)).sort_values("place")
        for r in records.itertuples(index=False):
            if r.kind == "run":
                gone = [("step", n) for n in sorted(standing["step"]) if n > r.step]
                gone += [("epoch", n) for n in sorted(standing["epoch"]) if n >= r.epoch]
                for kind, number in gone:
                    standing[kind].discard(number)
                    out.append((key[0], "drop", kind, number, r.place))
            else:
                number = int(r.step if r.kind == "step" else r.epoch)
                standing[r.kind].add(number)
                out.append((key[0], "put", r.kind, number, r.place))
        state.update((sorted(standing["step"]), sorted(standing["epoch"])))
        yield pd.DataFrame(out, columns=["run", "action", "kind", "number", "place"])

    return stream.groupBy("run").applyInPandasWithState(follow, CHANGES, HELD, "append", GroupStateTimeout.NoTimeout)


def standing(changes: DataFrame) -> DataFrame:
    """Numbers that stand after all changes: the last change of each is a put."""
    order = F.struct("place", F.when(F.col("action") == "put", 1).otherwise(0))
    last = changes.groupBy("run", "kind", "number").agg(
        F.max_by("action", order).alias("action"), F.max_by("place", order).alias("place")
    )
    return last.filter("action = 'put'").select("run", "kind", "number", "place")
