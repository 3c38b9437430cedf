"""Row keys, ordered prefix sums and whole-row decisions shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronotape.plans.shared import written

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that the table does not have, whatever it brings along."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def row_key(docs: DataFrame) -> tuple[Column, Column]:
    """Two non-null longs, 128 bits of all columns: equal for rows that are equal in every column, nulls included."""
    values: list[Column] = []
    for name, kind in docs.dtypes:
        column = F.col(f"`{name}`")
        # Maps have no hash.
        values += [F.to_json(F.struct(column)) if "map<" in kind else column, column.isNull()]
    return F.xxhash64(*values), F.xxhash64(F.lit(1), *values)


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def prefix_sums(df: DataFrame, order: list[str], sums: dict[str, str], groups: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Sums of `sums` (new name -> long column) over all rows before each row in the order of `groups`, then `order`.

    Rows are dealt to partitions by ranges of the whole order, so a hot group is spread over many of
    them. Each partition's totals are summed first; a row's sum is its partition's offset in the group
    plus the running sum inside the partition. Returns the rows (written once, so that partitions stay
    as they are) and the totals of each group. Nulls in the order come last.
    """
    part, = fresh(df, "part")
    by = [F.col(c).asc_nulls_last() for c in (*groups, *order)]
    ranged = df.repartitionByRange(shuffle_partitions(df), *by).withColumn(part, F.spark_partition_id())
    ranged = written(ranged, "ranged")
    # A window needs its keys as values: null groups are one group of their own.
    keys = [F.col(g).isNull() for g in groups] + [F.coalesce(F.col(g).cast("string"), F.lit("")) for g in groups]
    names = fresh(ranged, *[f"key{i}" for i in range(len(keys))])
    ranged = ranged.select("*", *[k.alias(n) for k, n in zip(keys, names, strict=True)])
    totals = ranged.groupBy(part, *names, *groups).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    earlier = Window.partitionBy(*names).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(part, *names, *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"{n}_offset") for n in sums])
    inside = Window.partitionBy(part, *names).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    rows = (
        ranged.join(offsets, [part, *names])
        .select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"{n}_inside") for n, c in sums.items()])
        .select(*[F.col(c) for c in df.columns], *[(F.col(f"{n}_offset") + F.col(f"{n}_inside")).alias(n) for n in sums])
    )
    whole = totals.groupBy(*names, *groups).agg(*[F.sum(n).alias(n) for n in sums]).drop(*names)
    return rows, whole


def apply_copies(docs: DataFrame, decisions: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """Whole rows of `docs`, each as often as `decisions` (key_id, key_text, copies; one per row of docs) says.

    Only rows that are equal in every column share a key; their copies are added up and given to one of them.
    Columns `more` of the decisions, which `docs` must not have, come along and keep their copies apart.
    """
    a, b, n, copies = fresh(docs, "key_id", "key_text", "key_rank", "key_copies")
    key_id, key_text = row_key(docs)
    wanted = (
        decisions.groupBy("key_id", "key_text", *more)
        .agg(F.sum("copies").cast("int").alias(copies))
        .where(F.col(copies) > 0)
        .select(F.col("key_id").alias(a), F.col("key_text").alias(b), *more, copies)
    )
    same = Window.partitionBy(a, b).orderBy(a)
    return (
        docs.select("*", key_id.alias(a), key_text.alias(b))
        .withColumn(n, F.row_number().over(same))
        .where(F.col(n) == 1)
        .join(wanted, [a, b])
        .withColumn(n, F.explode(F.array_repeat(F.lit(1), F.col(copies))))
        .select(*[F.col(f"`{c}`") for c in docs.columns], *more)
    )
