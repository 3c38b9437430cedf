"""Contract and integrity checks. A check returns its violations; `require_empty` stops on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronotape.functions.hashing import row_line, sha_hex, sha_number
from chronotape.functions.text import is_blank
from chronotape.plans.split import number_rows, plan_split, previous
from chronotape.sources.raw import event_type_of, parse_time, payload_map, reads_as_declared


class ContractError(ValueError):
    """Input breaks the contract; the message names the first rows."""


def require_empty(violations: DataFrame, what: str, shown: int = 5) -> None:
    found = violations.limit(shown).collect()
    if found:
        raise ContractError(f"{what}: {[r.asDict() for r in found]}")


# --- schema and manifest --------------------------------------------------------------


def schema_differences(df: DataFrame, expected: T.StructType) -> DataFrame:
    """Columns whose place, name or type is not the declared one."""
    want = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(expected.fields)]
    have = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]
    rows = []
    for place in range(max(len(want), len(have))):
        a = want[place] if place < len(want) else (place, None, None)
        b = have[place] if place < len(have) else (place, None, None)
        if a != b:
            rows.append((place, a[1], a[2], b[1], b[2]))
    return df.sparkSession.createDataFrame(
        rows, "place int, expected string, expected_type string, found string, found_type string"
    )


def manifest_problems(manifest: DataFrame, version: int) -> DataFrame:
    """Missing keys, an unsupported version, unreadable moments, an empty window."""
    required = ("schema_version", "period_start", "period_end", "events_rows", "profile_rows")
    start, end = parse_time(F.col("period_start")), parse_time(F.col("period_end"))
    problems = F.array(
        *[F.when(F.col(k).isNull(), F.lit(f"missing {k}")) for k in required],
        F.when(F.col("schema_version") != version, F.lit("unsupported version")),
        F.when(F.col("period_start").isNotNull() & start.isNull(), F.lit("unreadable period_start")),
        F.when(F.col("period_end").isNotNull() & end.isNull(), F.lit("unreadable period_end")),
        F.when(start >= end, F.lit("empty window")),
    )
    return manifest.select(F.explode(F.filter(problems, lambda p: p.isNotNull())).alias("problem"))


def row_count_mismatch(tables: dict[str, DataFrame], manifest: DataFrame) -> DataFrame:
    """Tables whose row count is not the one the manifest promises (column `<table>_rows`)."""
    promised = manifest.select(
        F.explode(
            F.array(*[F.struct(F.lit(n).alias("table"), F.col(f"{n}_rows").alias("promised")) for n in tables])
        ).alias("x")
    ).select("x.*")
    counted = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("found")).select(F.lit(name).alias("table"), "found")
        counted = one if counted is None else counted.unionByName(one)
    return promised.join(counted, "table").filter(~F.col("promised").eqNullSafe(F.col("found")))


# --- the envelope -----------------------------------------------------------------------


def blank_client(raw: DataFrame, column: str = "client_id") -> DataFrame:
    """Rows whose client is null or only white space."""
    return raw.filter(is_blank(F.col(column)))


def missing_envelope(raw: DataFrame, required: Sequence[str], row: str = "id") -> DataFrame:
    """Rows and required fields that are null."""
    missing = F.filter(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in required]), lambda c: c.isNotNull())
    return raw.select(row, F.explode(missing).alias("field"))


def outside_domain(rows: DataFrame, column: str, domain: DataFrame, row: str = "id") -> DataFrame:
    """Values outside their domain, how often and where first."""
    found = rows.groupBy(column).agg(F.count(F.lit(1)).alias("n_rows"), F.min(row).alias("first_row"))
    return found.join(domain.select(column), column, "left_anti")


def unreadable_payloads(raw: DataFrame, row: str = "id") -> DataFrame:
    """Rows whose payload names no event type, with the reason."""
    parsed = F.try_parse_json(F.col("payload"))
    shape = F.schema_of_variant(parsed)
    blank = is_blank(F.col("payload"))
    reason = (
        F.when(blank, "empty")
        .when(parsed.isNull(), "not json")
        .when(~shape.startswith("OBJECT"), "not an object")
        .otherwise("no type")
    )
    return raw.select(row, "payload", event_type_of(F.col("payload")).alias("_type")).filter("_type is null").select(
        row, reason.alias("reason")
    )


def first_bad_payload(raw: DataFrame, row: str = "id") -> DataFrame:
    bad = unreadable_payloads(raw, row)
    return bad.groupBy("reason").agg(F.count(F.lit(1)).alias("n_rows"), F.min(row).alias("first_row"))


def unreadable_times(raw: DataFrame, column: str = "event_time", row: str = "id") -> DataFrame:
    """Rows whose time is not a strict ISO moment with an offset."""
    return raw.filter(parse_time(F.col(column)).isNull()).select(row, column)


# --- payload contract -------------------------------------------------------------------


def payload_violations(raw: DataFrame, catalogue: DataFrame, row: str = "id") -> DataFrame:
    """Every violation of the payload contract as (row, kind, field).

    A value of the wrong type is a type mismatch and not also missing; a key
    that is absent and one that is null are the same.
    """
    specs = catalogue.groupBy("type").agg(
        F.map_from_entries(F.collect_list(F.struct("field", "dtype"))).alias("_dtypes"),
        F.collect_list(F.when(F.col("required"), F.col("field"))).alias("_required"),
    )
    parsed = F.try_parse_json(F.col("payload"))
    rows = raw.select(
        F.col(row),
        "payload",
        payload_map(F.col("payload")).alias("_m"),
        F.when(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(True)).otherwise(F.lit(False)).alias("_object"),
        event_type_of(F.col("payload")).alias("type"),
    )
    # One row per event type: the specs are a small dimension and join without a hint.
    rows = rows.join(specs, "type", "left")

    def violation(kind: str, field: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), field.cast("string").alias("field"))

    nothing = F.array().cast("array<struct<kind:string,field:string>>")
    pairs = F.filter(F.map_entries("_m"), lambda e: e["key"] != "type")
    dtype = lambda e: F.element_at("_dtypes", e["key"])
    unexpected = F.transform(
        F.filter(pairs, lambda e: dtype(e).isNull()), lambda e: violation("unexpected_key", e["key"])
    )
    present = lambda e: F.schema_of_variant(e["value"]) != "VOID"
    wrong = lambda e: dtype(e).isNotNull() & present(e) & ~reads_as_declared(e["value"], dtype(e))
    mismatched = F.transform(F.filter(pairs, wrong), lambda e: violation("type_mismatch", e["key"]))
    absent = F.filter(
        "_required",
        lambda f: F.coalesce(F.schema_of_variant(F.element_at("_m", f)), F.lit("VOID")) == "VOID",
    )
    missing = F.transform(absent, lambda f: violation("missing_required", f))
    found = (
        F.when(F.col("payload").isNull(), F.array(violation("null_payload", F.lit(None))))
        .when(~F.col("_object"), F.array(violation("unparseable", F.lit(None))))
        .when(F.col("_dtypes").isNull(), nothing)
        .otherwise(F.concat(unexpected, mismatched, missing))
    )
    return rows.select(row, F.explode(found).alias("v")).select(row, "v.kind", "v.field")


def violation_counts(violations: DataFrame) -> DataFrame:
    return violations.groupBy("kind", "field").agg(F.count(F.lit(1)).alias("n"))


def violation_samples(violations: DataFrame, row: str = "id", shown: int = 20) -> DataFrame:
    """The first rows of each kind; each task keeps only `shown` rows of a kind before the exchange."""
    order = Window.partitionBy("kind").orderBy(row, F.col("field").asc_nulls_first())
    return violations.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= shown).drop("_rn")


def payload_key_profile(raw: DataFrame) -> DataFrame:
    """How often each payload key is present and not null, by event type and source."""
    entries = F.filter(F.map_entries(payload_map(F.col("payload"))), lambda e: F.schema_of_variant(e["value"]) != "VOID")
    keys = raw.select(
        event_type_of(F.col("payload")).alias("type"), "source", F.explode(F.transform(entries, lambda e: e["key"])).alias("key")
    )
    return keys.groupBy("type", "source", "key").agg(F.count(F.lit(1)).alias("n"))


# --- the snapshot -----------------------------------------------------------------------


def duplicate_clients(snapshot: DataFrame, column: str = "client") -> DataFrame:
    return snapshot.groupBy(column).agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1")


def milestone_problems(snapshot: DataFrame, period_end: int, kinds: Sequence[str], with_source: Sequence[str]) -> DataFrame:
    """Snapshots not taken at the window's end, and milestones that are unknown, undated, from the
    future, repeated, out of order, or with a source id where the kind has none (and the reverse)."""
    places = F.create_map(*[x for i, k in enumerate(kinds) for x in (F.lit(k), F.lit(i))])
    items = F.col("lifelong")
    order = F.transform(items, lambda x: F.struct(x["t"].alias("t"), F.element_at(places, x["type"]).alias("i")))
    types = F.transform(items, lambda x: x["type"])
    sourced = lambda x: x["type"].isin(*with_source)
    checks = {
        "moment": ~F.col("as_of").eqNullSafe(F.lit(period_end)),
        "kind": F.exists(items, lambda x: ~x["type"].isin(*kinds)),
        "undated": F.exists(items, lambda x: x["t"].isNull()),
        "future": F.exists(items, lambda x: x["t"] >= F.col("as_of")),
        "source": F.exists(items, lambda x: x["source_id"].isNull() == sourced(x)),
        "repeated": F.size(F.array_distinct(types)) != F.size(types),
        "order": F.array_sort(order) != order,
    }
    return _named(snapshot, checks)


def employment_problems(snapshot: DataFrame, local_day) -> DataFrame:
    """Employment recorded at or after the snapshot, out of order, or starting after its own record."""
    items = F.col("employment")
    moments = F.transform(items, lambda x: x["recorded"])
    checks = {
        "future": F.exists(items, lambda x: x["recorded"].isNull() | (x["recorded"] >= F.col("as_of"))),
        "start_after_record": F.exists(items, lambda x: x["start_day"] > local_day(x["recorded"])),
        "order": F.array_sort(moments) != moments,
    }
    return _named(snapshot, checks)


def _named(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    hits = F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items()])
    return rows.select("client", F.explode(F.filter(hits, lambda h: h.isNotNull())).alias("problem"))


def split_clients(rows: DataFrame, row: str = "id") -> DataFrame:
    """Clients whose rows are not contiguous in the source order, with the number of pieces."""
    ordered = rows.select("client", F.col(row).alias("_row"))
    split = plan_split(ordered, [], "_row")
    starts = previous(ordered, split, {"_before": "client"}, []).filter(~F.col("_before").eqNullSafe(F.col("client")))
    return starts.groupBy("client").agg(F.count(F.lit(1)).alias("pieces")).filter("pieces > 1")


def milestone_links(snapshot: DataFrame, events: DataFrame, period_start: int) -> DataFrame:
    """Milestones and the event each names as its source: (client, kind, source_id, problem).

    Events carry (client, kind, source_id, t, id). The moments must agree, an
    event may be the source of one milestone only, and a milestone inside the
    window must have its event.
    """
    wanted = snapshot.select("client", F.explode("lifelong").alias("x")).select(
        "client", F.col("x.type").alias("kind"), F.col("x.source_id").alias("source_id"), F.col("x.t").alias("moment")
    ).filter("source_id is not null")
    keys = ["client", "kind", "source_id"]
    pairs = wanted.join(events.select(*keys, F.col("t").alias("_t"), F.col("id").alias("_id")), keys, "left")
    linked = pairs.groupBy(*keys, "moment").agg(
        F.count("_id").alias("found"), F.count_if(F.col("_t") != F.col("moment")).alias("moved")
    )
    problem = (
        F.when((F.col("found") == 0) & (F.col("moment") >= period_start), "missing")
        .when(F.col("moved") > 0, "moved")
        .when(F.col("found") > 1, "repeated")
    )
    own = linked.select(*keys, problem.alias("problem")).filter("problem is not null")
    shared = (
        pairs.filter("_id is not null")
        .groupBy("_id")
        .agg(F.count(F.lit(1)).alias("n"), F.min("client").alias("client"), F.min("kind").alias("kind"), F.min("source_id").alias("source_id"))
        .filter("n > 1")
    )
    return own.unionByName(shared.select(*keys, F.lit("shared source").alias("problem")))


def strangers(events: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Clients of the tape that have no snapshot."""
    return events.select("client").distinct().join(snapshot.select("client"), "client", "left_anti")


def overlapping_groups(rows: DataFrame, key: str, group: str) -> DataFrame:
    """Keys that stand in two groups, or twice in one."""
    return (
        rows.groupBy(key)
        .agg(F.count_distinct(group).alias("n_groups"), F.count(F.lit(1)).alias("n_rows"))
        .filter("n_groups > 1 or n_rows > 1")
    )


# --- ledger -----------------------------------------------------------------------------


def broken_balances(rows: DataFrame) -> DataFrame:
    """Approved rows whose balance is not the previous one of the account plus or minus the amount.

    Rows carry account_id, t, id, sign (+1 credit, -1 debit, 0 snapshot), amount and balance_after.
    """
    known = rows.filter("account_id is not null and balance_after is not null")
    split = plan_split(known, ["account_id"], "t")
    chained = previous(known, split, {"before": "balance_after"}, ["id"])
    expected = F.col("before") + F.col("sign") * F.coalesce(F.col("amount"), F.lit(0))
    return chained.filter(F.col("before").isNotNull() & (F.col("balance_after") != expected)).select(
        "id", "account_id", "before", "balance_after", expected.alias("expected")
    )


def unpaired_transfers(rows: DataFrame, outgoing: str, incoming: str) -> DataFrame:
    """Transfers without exactly one leg on each side, or whose legs differ in amount."""
    out, inn = F.col("type") == outgoing, F.col("type") == incoming
    legs = rows.filter(out | inn).groupBy("transfer_id").agg(
        F.count_if(out).alias("n_out"),
        F.count_if(inn).alias("n_in"),
        F.sum(F.when(out, F.col("amount"))).alias("sum_out"),
        F.sum(F.when(inn, F.col("amount"))).alias("sum_in"),
    )
    return legs.filter((F.col("n_out") != 1) | (F.col("n_in") != 1) | (F.col("sum_out") != F.col("sum_in")))


def used_after_close(uses: DataFrame, closures: DataFrame, key: str) -> DataFrame:
    """Uses of an instrument at or after its first closure."""
    closed = closures.groupBy(key).agg(F.min("t").alias("closed_at"))
    return uses.join(closed, key).filter(F.col("t") >= F.col("closed_at")).select("id", key, "t", "closed_at")


# --- digests and comparisons ------------------------------------------------------------

FAN_OUT = 4096


def client_digests(rows: DataFrame, fields: Sequence[str], at: str = "t", row: str = "id", fan_out: int = FAN_OUT, levels: int = 4) -> DataFrame:
    """An order-sensitive digest of each client's rows.

    Lines are numbered in order and hashed; `fan_out` neighbours are joined and
    hashed again, `levels` times, so no task holds more than `fan_out` hashes of a
    client; fan_out ** levels rows of one client fit (over 10 ** 14 by default).
    """
    split = plan_split(rows, ["client"], at)
    numbered = number_rows(rows.select("client", at, row, row_line(fields).alias("_line")), split, [row], "_n")
    hashed = numbered.select("client", F.col("_n").alias("_n"), sha_hex(F.col("_line")).alias("_h"))
    counts = rows.groupBy("client").agg(F.count(F.lit(1)).alias("n_rows"))
    for _ in range(levels):
        grouped = hashed.groupBy("client", F.floor(F.col("_n") / fan_out).cast("bigint").alias("_n")).agg(
            F.array_sort(F.collect_list(F.struct("_n", "_h"))).alias("_l")
        )
        hashed = grouped.select(
            "client", "_n", sha_hex(F.array_join(F.transform("_l", lambda x: x["_h"]), "\x1e")).alias("_h")
        )
    return counts.join(hashed.select("client", F.col("_h").alias("digest")), "client")


def compare_exports(left: DataFrame, right: DataFrame, fields: Sequence[str], at: str = "t", row: str = "id") -> DataFrame:
    """Clients whose rows differ: row counts, the first differing ordinal and its time."""

    def lines(rows: DataFrame, name: str) -> DataFrame:
        numbered = number_rows(rows, plan_split(rows, ["client"], at), [row], "_n")
        return numbered.select("client", "_n", F.col(at).alias(f"_{name}_t"), row_line(fields).alias(f"_{name}"))

    both = lines(left, "l").join(lines(right, "r"), ["client", "_n"], "full_outer")
    differ = ~F.col("_l").eqNullSafe(F.col("_r"))
    first = F.min(F.when(differ, F.struct("_n", F.coalesce("_l_t", "_r_t").alias("t"))))
    return (
        both.groupBy("client")
        .agg(F.count("_l").alias("left_rows"), F.count("_r").alias("right_rows"), first.alias("_f"))
        .filter("_f is not null")
        .select("client", "left_rows", "right_rows", F.col("_f._n").alias("first_difference"), F.col("_f.t").alias("moment"))
    )


def diverged_share(differences: DataFrame, clients: DataFrame, limit: float) -> DataFrame:
    """Share of diverged clients and whether it stays within the limit."""
    n = differences.agg(F.count(F.lit(1)).alias("diverged"))
    total = clients.select("client").distinct().agg(F.count(F.lit(1)).alias("clients")).scalar()
    return n.select("diverged", total.alias("clients")).withColumn(
        "within", F.col("diverged") <= F.lit(limit) * F.col("clients")
    )


def fingerprint(rows: DataFrame, fields: Sequence[str]) -> DataFrame:
    """A digest of a table that does not depend on the order of its rows: count and exact sum of row hashes."""
    number = sha_number(row_line(fields)).cast("decimal(18,0)")
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(number).cast("string").alias("checksum"))


def lineage_problems(have: DataFrame, want: DataFrame) -> DataFrame:
    """Declared facts (name, value) that differ between an artifact and what its reader expects."""
    a = have.select("name", F.col("value").alias("found"))
    b = want.select("name", F.col("value").alias("expected"))
    return a.join(b, "name", "full_outer").filter(~F.col("found").eqNullSafe(F.col("expected")))


# --- dimensions -------------------------------------------------------------------------


def field_coverage(fields: DataFrame, allowed: DataFrame, internal: DataFrame) -> DataFrame:
    """Fields that are not named exactly once as allowed or internal, and names of no field."""
    named = allowed.select("field", F.lit(1).alias("a"), F.lit(0).alias("i")).unionByName(
        internal.select("field", F.lit(0).alias("a"), F.lit(1).alias("i"))
    )
    sums = named.groupBy("field").agg(F.sum("a").alias("n_allowed"), F.sum("i").alias("n_internal"))
    known = fields.select("field").distinct().withColumn("known", F.lit(True))
    return (
        known.join(sums, "field", "full_outer")
        .select(
            "field",
            F.coalesce("known", F.lit(False)).alias("known"),
            F.coalesce("n_allowed", F.lit(0)).alias("n_allowed"),
            F.coalesce("n_internal", F.lit(0)).alias("n_internal"),
        )
        .filter(~F.col("known") | (F.col("n_allowed") + F.col("n_internal") != 1))
    )


def mixed_kinds(values: DataFrame, key: str = "key", kind: str = "vtype") -> DataFrame:
    """Keys that appear with more than one value type."""
    return (
        values.select(key, kind)
        .distinct()
        .groupBy(key)
        .agg(F.array_join(F.array_sort(F.collect_list(kind)), ",").alias("kinds"), F.count(F.lit(1)).alias("n_kinds"))
        .filter("n_kinds > 1")
    )


def id_space(vocab: DataFrame) -> DataFrame:
    """Whether ids are unique and dense from 0, and names unique."""
    return vocab.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("id").alias("n_ids"),
        F.count_distinct("token").alias("n_tokens"),
        F.min("id").alias("first_id"),
        F.max("id").alias("last_id"),
    ).withColumn(
        "dense",
        (F.col("n") == F.col("n_ids"))
        & (F.col("n") == F.col("n_tokens"))
        & (F.col("first_id") == 0)
        & (F.col("last_id") == F.col("n") - 1),
    )


def not_reproduced(full: DataFrame, cut: DataFrame) -> DataFrame:
    """Rows of a computation on the whole tape, known by M, that differ from one on the tape cut at M."""
    missing = full.exceptAll(cut).withColumn("side", F.lit("only full"))
    return missing.unionByName(cut.exceptAll(full).withColumn("side", F.lit("only cut")))


