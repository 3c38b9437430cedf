"""Stream twins of the point-in-time operators: rolling activity, sessions, silence, contract checks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from chronotape.functions.clock import DAY
from chronotape.functions.text import is_blank
from chronotape.plans.shared import new_path
from chronotape.sources.raw import event_type_of, parse_time
from chronotape.streaming.telemetry import drained


def event_stream(spark: SparkSession, folder: str, file: str, schema: str) -> DataFrame:
    """Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("pathGlobFilter", file).parquet(folder)


def timed(events: DataFrame, late: str) -> DataFrame:
    """Event time as a timestamp with a watermark: later rows than `late` are dropped by the state."""
    return events.withColumn("at", F.timestamp_micros("t")).withWatermark("at", late)


def rolling_activity(events: DataFrame, size: str, slide: str, late: str, amount: str = "amount") -> DataFrame:
    """Events and sums per client over sliding windows of event time."""
    return (
        timed(events, late)
        .groupBy(F.window("at", size, slide), "client")
        .agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(amount), F.lit(0)).alias("total"))
        .select(
            "client",
            F.unix_micros("window.start").alias("start"),
            F.unix_micros("window.end").alias("stop"),
            "n",
            "total",
        )
    )


def sessions(events: DataFrame, gap: str, late: str) -> DataFrame:
    """Sessions of a client: a pause of `gap` ends one."""
    return (
        timed(events, late)
        .groupBy(F.session_window("at", gap), "client")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("client", F.unix_micros("session_window.start").alias("start"), F.unix_micros("session_window.end").alias("stop"), "n")
    )


def all_activity(events: DataFrame, size: str, slide: str, late: str, amount: str = "amount") -> DataFrame:
    """Rolling activity at the end of the input: the windows that the watermark closed and those still open in the state."""
    closed, state = drained(rolling_activity(events, size, slide, late, amount), "rolling")
    still = state.load().select(
        "key.client",
        F.unix_micros("key.window.start").alias("start"),
        F.unix_micros("key.window.end").alias("stop"),
        F.col("value.count").alias("n"),
        F.coalesce("value.sum", F.lit(0)).alias("total"),
    )
    return closed.unionByName(still)


def all_sessions(events: DataFrame, gap: str, late: str) -> DataFrame:
    """Sessions at the end of the input: those that the watermark closed and those still open in the state."""
    closed, state = drained(sessions(events, gap, late), "sessions")
    window = "value.session_window"
    still = state.load().select(
        "value.client", F.unix_micros(f"{window}.start").alias("start"), F.unix_micros(f"{window}.end").alias("stop"), F.col("value.count").alias("n")
    )
    return closed.unionByName(still)


SILENCE = "client string, moment bigint, change string"


def silence(events: DataFrame, days: int, late: str) -> DataFrame:
    """A client quiet for `days` becomes churned when the watermark passes; the next action brings it back.

    The state of a client is its last action. Actions of one batch are walked in order of time.
    """
    span = days * DAY

    def watch(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        if state.hasTimedOut:
            last, quiet = state.get
            if not quiet:
                out.append((key[0], last + span, "churn"))
            state.update((last, True))
        else:
            last, quiet = state.get if state.exists else (None, False)
            for t in sorted(int(x) for rows in batches for x in rows["t"]):
                if last is not None and t - last >= span:
                    if not quiet:
                        out.append((key[0], last + span, "churn"))
                    out.append((key[0], t, "reactivated"))
                elif quiet:
                    out.append((key[0], t, "reactivated"))
                last, quiet = (t if last is None else max(last, t)), False
            state.update((last, quiet))
            due = (last + span) // 1000
            state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["client", "moment", "change"])

    return (
        timed(events, late)
        .select("client", "t", "at")
        .groupBy("client")
        .applyInPandasWithState(watch, SILENCE, "last bigint, quiet boolean", "append", GroupStateTimeout.EventTimeTimeout)
    )


def problem_of(known_sources: list[str]) -> Column:
    """The first broken rule of an envelope row; null for a good one."""
    return (
        F.when(is_blank(F.col("client_id")), "blank client")
        .when(parse_time(F.col("event_time")).isNull(), "unreadable time")
        .when(~F.coalesce(F.col("source").isin(*known_sources), F.lit(False)), "unknown source")
        .when(event_type_of(F.col("payload")).isNull(), "unreadable payload")
    )


def checked(raw: DataFrame, known_sources: list[str], name: str = "checked") -> tuple[DataFrame, DataFrame]:
    """Check every micro-batch: good rows go to one table, bad rows with their problem to another."""
    spark = raw.sparkSession
    good, bad, state = new_path(spark, f"{name}-good"), new_path(spark, f"{name}-bad"), new_path(spark, f"{name}-state")

    def route(batch: DataFrame, number: int) -> None:
        judged = batch.withColumn("problem", problem_of(known_sources))
        # A batch that runs again replaces its own folder, so nothing is written twice.
        judged.filter("problem is null").drop("problem").write.mode("overwrite").parquet(f"{good}/batch={number}")
        judged.filter("problem is not null").write.mode("overwrite").parquet(f"{bad}/batch={number}")

    query = raw.writeStream.foreachBatch(route).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(good).drop("batch"), spark.read.parquet(bad).drop("batch")


