"""The raw export: envelope of four text columns, JSON payload, manifest, snapshot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronotape.functions.text import is_blank

ENVELOPE = T.StructType([T.StructField(n, T.StringType()) for n in ("client_id", "event_time", "source", "payload")])

MANIFEST = T.StructType(
    [
        T.StructField("schema_version", T.IntegerType()),
        T.StructField("period_start", T.StringType()),
        T.StructField("period_end", T.StringType()),
        T.StructField("events_rows", T.LongType()),
        T.StructField("profile_rows", T.LongType()),
    ]
)

# The four value types of a payload and how JSON spells them.
DTYPES = {"str": "string", "int": "bigint", "float": "double", "bool": "boolean"}

# dict: event type -> {field: (dtype, required)}
Catalogue = dict[str, dict[str, tuple[str, bool]]]


def read_envelope(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Scan the export under its declared schema; unnamed columns are not read."""
    rows = spark.read.schema(ENVELOPE).parquet(path)
    return rows.select(*columns) if columns else rows


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).json(path, multiLine=True)


def catalogue_table(spark: SparkSession, catalogue: Catalogue) -> DataFrame:
    rows = [
        (kind, field, dtype, required)
        for kind, fields in catalogue.items()
        for field, (dtype, required) in fields.items()
    ]
    return spark.createDataFrame(rows, "type string, field string, dtype string, required boolean")


def event_type_of(payload: Column) -> Column:
    """The type a payload names; null when it is not JSON, not an object, or names no text."""
    found = F.try_variant_get(F.try_parse_json(payload), "$.type", "variant")
    return F.when(F.schema_of_variant(found) == "STRING", F.try_variant_get(found, "$", "string"))


def payload_map(payload: Column) -> Column:
    """Keys of the payload with their values, each keeping its JSON type; null unless an object."""
    return F.from_json(payload, "map<string,variant>")


def reads_as(value: Column, dtype: str) -> Column:
    """Whether a JSON value has the declared type; true and false are no numbers."""
    spelled = F.schema_of_variant(value)
    if dtype == "str":
        return spelled == "STRING"
    if dtype == "bool":
        return spelled == "BOOLEAN"
    if dtype == "int":
        return spelled == "BIGINT"
    return spelled.isin("BIGINT", "DOUBLE", "FLOAT") | spelled.startswith("DECIMAL")


def reads_as_declared(value: Column, dtype: Column) -> Column:
    found = F.lit(False)
    for name in DTYPES:
        found = found | ((dtype == name) & reads_as(value, name))
    return found


def typed_payload(raw: DataFrame, catalogue: Catalogue) -> DataFrame:
    """One typed column per declared field; a value of the wrong type or of an undeclared field is null."""
    declared: dict[str, tuple[str, list[str]]] = {}
    for kind, fields in catalogue.items():
        for field, (dtype, _) in fields.items():
            known, kinds = declared.setdefault(field, (dtype, []))
            if known != dtype:
                raise ValueError(f"field {field} is declared both {known} and {dtype}")
            kinds.append(kind)
    rows = raw.withColumns({"_m": payload_map(F.col("payload"))})
    named = F.element_at("_m", F.lit("type"))
    rows = rows.withColumn("type", F.when(reads_as(named, "str"), F.try_variant_get(named, "$", "string")))
    columns = []
    for field, (dtype, kinds) in declared.items():
        value = F.element_at("_m", F.lit(field))
        typed = F.try_variant_get(value, "$", DTYPES[dtype])
        columns.append(F.when(F.col("type").isin(*kinds) & reads_as(value, dtype), typed).alias(field))
    return rows.select(*raw.columns, "type", *columns).drop("payload")


def pruned_payload(raw: DataFrame, schema: str) -> DataFrame:
    """Only the listed payload keys, parsed and typed; every other key is skipped."""
    parsed = raw.withColumn("_p", F.from_json("payload", schema))
    return parsed.select(*[c for c in raw.columns if c != "payload"], "_p.*")


def parse_time(text: Column) -> Column:
    """Microseconds of a strict ISO time with an offset; null when the text is anything else."""
    strict = text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,6})?([+-]\d{2}:\d{2}|Z)$")
    return F.when(strict, F.unix_micros(F.try_to_timestamp(text)))


def row_numbers(rows: DataFrame, order: str, name: str = "raw_row") -> DataFrame:
    """Number all rows from 0 by an id column; independent of files and partitions."""
    from chronotape.plans.split import number_rows, plan_split

    return number_rows(rows, plan_split(rows, [], order), [], name)


def client_blocks(events: DataFrame, partitions: int | None = None) -> DataFrame:
    """Rows of a client next to each other and in order. Range partitions cut a client that is
    larger than one partition, so no task gets more than its share."""
    order = ["client", "t", "id"]
    spread = events.repartitionByRange(partitions, *order) if partitions else events.repartitionByRange(*order)
    return spread.sortWithinPartitions(*order)


def split_at(tape: DataFrame, boundary: int, excluded: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The tape before a moment and from it on; excluded clients are left out of the future."""
    future = tape.filter(F.col("t") >= boundary)
    if excluded is not None:
        future = future.join(excluded.select("client"), "client", "left_anti")
    return tape.filter(F.col("t") < boundary), future


def shifted(rows: DataFrame, column: str, micros: int) -> DataFrame:
    """Move a moment column, such as UTC to local wall clock."""
    return rows.withColumn(column, F.col(column) + F.lit(micros))


def read_jsonl(lines: DataFrame, schema: str, column: str = "value") -> DataFrame:
    """Parse JSON lines; a line that does not parse keeps its text in `malformed`."""
    parsed = lines.withColumn(
        "_p", F.from_json(column, f"{schema}, malformed string", {"columnNameOfCorruptRecord": "malformed"})
    )
    rest = [c for c in lines.columns if c != column]
    return parsed.filter(~is_blank(F.col(column))).select(*rest, "_p.*")
