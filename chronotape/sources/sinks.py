"""Writers: compressed Parquet, a folder per source, and small reports."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_table(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Parquet with zstd; an empty table keeps its schema."""
    df.write.mode(mode).option("compression", "zstd").parquet(path)


def write_by_source(df: DataFrame, path: str, column: str = "source") -> None:
    """A folder per source. Rows are rebalanced by source: adaptive execution cuts a source that holds most of
    the rows into tasks of even size, as many as it needs, and puts small ones together."""
    df.hint("rebalance", column).write.partitionBy(column).option("compression", "zstd").parquet(path)


def write_report(df: DataFrame, path: str, kind: str) -> None:
    """A report as JSON lines or CSV with a header."""
    writer = df.write.mode("errorifexists")
    writer.json(path) if kind == "json" else writer.option("header", True).csv(path)


def feature_list(registry: DataFrame, limit: int = 10_000) -> str:
    """Markdown table of a feature registry (one row per feature: name, description)."""
    rows = registry.orderBy("name").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"a feature registry has at most {limit} rows")
    return "\n".join(["| feature | description |", "| --- | --- |", *[f"| {r['name']} | {r['description']} |" for r in rows]])
