"""Long values and corpus statistics (P1-P5, A15-A29, A40, A41, A43, A45, J13, Q28) and their SQL."""

from pyspark.sql import functions as F

from chronotape.functions.hashing import uniform
from chronotape.functions.text import normalized
from chronotape.operators import corpus as cx
from chronotape.operators import registry as rx
from chronotape.plans.shared import written
from chronotape.plans.split import quantiles
from queries.registry import query
from queries.tables import CUTOFF, DAY, SNAPSHOT, read, snapshot, tape, with_tape

# Semantic keys of the derived tape: field, its source (None: any), key, kind.
REGISTRY: list[rx.Entry] = [
    ("type", None, "event_type", "categorical"),
    ("channel", "crm", "contact_channel", "categorical"),
    ("channel", None, "payment_channel", "categorical"),
    ("status", None, "status", "categorical"),
    ("reason", "registry", "product_reason", "categorical"),
    ("reason", "ledger", "payment_reason", "categorical"),
    ("operation", None, "operation", "categorical"),
    ("mcc", None, "mcc", "categorical"),
    ("merchant_country", None, "merchant_country", "categorical"),
    ("is_online", None, "is_online", "categorical"),
    ("product_id", None, "product", "categorical"),
    ("delivered", None, "delivered", "categorical"),
    ("amount", None, "transaction_amount", "numeric"),
    ("balance_after", None, "balance_after", "numeric"),
    ("days_past_due", None, "days_past_due", "numeric"),
    ("merchant_name", None, "merchant_name", "text"),
    ("counterparty", None, "counterparty", "text"),
    ("note", None, "note", "text"),
]
# `template` has no entry: its cells are found as unknown.
FIELDS = [*dict.fromkeys(f for f, _, _, _ in REGISTRY), "template"]
VTYPE = {"is_online": "bool", "delivered": "bool", "amount": "int", "balance_after": "int", "days_past_due": "int"}


def _quote(x):
    return "null" if x is None else f"'{x}'"


REGISTRY_CTE = "registry(field, source, key, kind) as (values " + ", ".join(
    f"({_quote(f)}, {_quote(s)}, {_quote(k)}, {_quote(c)})" for f, s, k, c in REGISTRY
) + ")"
CELLS = "cells as (" + " union all ".join(
    f"select id, client, t, type, source, '{f}' as field, '{VTYPE.get(f, 'str')}' as vtype, cast({f} as varchar) as value from tape where {f} is not null"
    for f in FIELDS
) + ")"
VALUES = """vals as (select c.*, coalesce(o.key, a.key) as key, coalesce(o.kind, a.kind) as kind from cells c
 left join registry o on o.field = c.field and o.source = c.source left join registry a on a.field = c.field and a.source is null)"""
LONG = (REGISTRY_CTE, CELLS, VALUES)


def cells(spark, sf, rows=None):
    return rx.stacked(tape(spark, sf) if rows is None else rows, FIELDS, ["id", "client", "t", "type", "source"])


def values(spark, sf, rows=None):
    """Long values of the tape, or of the stored tape `rows`."""
    found = rx.resolved(cells(spark, sf, rows), rx.registry_table(spark, REGISTRY))
    return found.filter("key is not null")


# The events before T are the training group.
TRAIN = f"train as (select * from vals where key is not null and t < {CUTOFF})"


def train(spark, sf, rows=None):
    return values(spark, sf, rows).filter(F.col("t") < CUTOFF)


@query("P1_allow_list", with_tape("select id, client, t, type, " + ", ".join(f for f in FIELDS if f != "type") + " from tape"))
def p1(spark, sf):
    return tape(spark, sf).select("id", "client", "t", "type", *[f for f in FIELDS if f != "type"])


@query("P2_key_for_field", with_tape("select field, source, key, count(*) as n from vals where key is not null group by 1, 2, 3", *LONG))
def p2(spark, sf):
    return values(spark, sf).groupBy("field", "source", "key").agg(F.count(F.lit(1)).alias("n"))


@query("P2_unknown_pairs", with_tape("select field, source, count(*) as n from vals where key is null group by 1, 2", *LONG))
def p2_unknown(spark, sf):
    return rx.unknown_pairs(cells(spark, sf), rx.registry_table(spark, REGISTRY))


CHANGE_SIDES = """sides as (select id, field_name, 'profile_' || field_name || '_old' as key, old_value as text from tape where type='profile_change' and old_value is not null
 union all select id, field_name, 'profile_' || field_name || '_new', new_value from tape where type='profile_change' and new_value is not null)"""


@query(
    "P3_profile_change_keys",
    with_tape(
        """select id, key, case when field_name in ('declared_income','city') then 'int' else 'str' end as vtype,
 case when field_name in ('declared_income','city') then cast(try_cast(text as bigint) as varchar) else text end as value,
 case when field_name in ('declared_income','city') and try_cast(text as bigint) is null then 'unreadable: ' || text end as note from sides""",
        CHANGE_SIDES,
    ),
)
def p3(spark, sf):
    # `city` is declared a number here on purpose: its texts do not read and become notes.
    return rx.profile_change_values(tape(spark, sf), ["declared_income", "city"], ["id"])


@query("P4_wide_to_long", with_tape("select id, field, vtype, value from cells", CELLS))
def p4(spark, sf):
    return cells(spark, sf).select("id", "field", "vtype", "value")


@query(
    "P5_key_registry",
    with_tape(
        """select key, min(kind) as kind, case min(kind) when 'text' then 'per_client' else 'per_event' end as weight_rule,
 string_agg(distinct concat_ws('.', coalesce(source, '*'), field), ',' order by concat_ws('.', coalesce(source, '*'), field)) as fields
 from (select distinct field, source, key, kind from (select r.* from registry r join (select distinct field from cells) c on c.field = r.field)) group by key""",
        REGISTRY_CTE, CELLS,
    ),
)
def p5(spark, sf):
    used = rx.registry_table(spark, REGISTRY).join(cells(spark, sf).select("field").distinct(), "field", "left_semi")
    return rx.key_registry(used, {"categorical": "per_event", "numeric": "per_event", "text": "per_client"})


@query(
    "A15_value_counts",
    with_tape("select key, vtype, value, count(*) as occurrences, count(distinct client) as clients from train group by 1, 2, 3", *LONG, TRAIN),
)
def a15(spark, sf):
    return cx.value_counts(train(spark, sf))


@query(
    "A16_key_counts",
    with_tape("select key, count(*) as occurrences, count(distinct client) as clients, count(distinct type) as types from train group by key", *LONG, TRAIN),
)
def a16(spark, sf):
    return cx.key_counts(train(spark, sf))


# Numbers: amounts by flow, balances, days past due, and the raw value with a few non-numbers by rule.
FLOW = "case when type in ('salary_credit','cash_deposit','transfer_in') then 'credit' when type = 'loan_payment' then null else 'debit' end"
SCORE = "case when k = 13 then cast('NaN' as double) when k = 14 then cast('Infinity' as double) when k = 15 then 0.0 when k % 10 = 6 then -v else v end"
NUMBERS = f"""numbers as (select id, client, 'amount' as key, {FLOW} as cond, amount::double as number from tape where amount is not null and t < {CUTOFF}
 union all select id, client, 'balance', null, balance_after::double from tape where balance_after is not null and t < {CUTOFF}
 union all select id, client, 'days', null, days_past_due::double from tape where days_past_due is not null and t < {CUTOFF}
 union all select id, client, 'score', null, {SCORE} from tape where t < {CUTOFF})"""


def numbers(spark, sf):
    rows = tape(spark, sf).filter(F.col("t") < CUTOFF)

    def part(key, cond, number):
        number = F.expr(f"cast({number} as double)")
        cell = F.struct(F.lit(key).alias("key"), F.expr(cond).cast("string").alias("cond"), number.alias("number"))
        return F.when(number.isNotNull(), cell)

    parts = F.array(
        part("amount", FLOW, "amount"), part("balance", "null", "balance_after"),
        part("days", "null", "days_past_due"), part("score", "null", SCORE),
    )
    return rows.select("id", "client", F.explode(F.filter(parts, lambda p: p.isNotNull())).alias("n")).select(
        "id", "client", "n.*"
    )


GOOD = "not isnan(number) and not isinf(number)"
SUMMARY = f"""count(*) filter (where {GOOD}) as n, count(*) filter (where number = 0) as n_zero, count(*) filter (where {GOOD} and number < 0) as n_negative,
 count(*) filter (where not ({GOOD})) as n_invalid, min(number) filter (where {GOOD}) as minimum, max(number) filter (where {GOOD}) as maximum,
 count(distinct number) filter (where {GOOD}) as distinct_values, count(distinct client) as clients"""


@query("A17_numeric_summary", with_tape(f"select key, {SUMMARY} from numbers group by key", NUMBERS))
def a17(spark, sf):
    return cx.numeric_summary(numbers(spark, sf))


@query("A18_split_summary", with_tape(f"select key, cond, {SUMMARY} from numbers group by key, cond", NUMBERS))
def a18(spark, sf):
    return cx.numeric_summary(numbers(spark, sf), ("key", "cond"))


NORMAL = r"nullif(trim(lower(regexp_replace(value, '[\x09-\x0D\x1C-\x20]+', ' ', 'g'))), '')"
TEXTS = f"texts as (select key, client, id, value, {NORMAL} as normalized from train where kind = 'text')"


def texts(spark, sf):
    return normalized(train(spark, sf).filter("kind = 'text'"), "value")


@query(
    "A19_text_corpus",
    with_tape(
        "select key, normalized, count(*) as occurrences, count(distinct client) as clients, max(octet_length(encode(value))) as max_bytes from texts group by 1, 2",
        *LONG, TRAIN, TEXTS,
    ),
)
def a19(spark, sf):
    return cx.text_corpus(texts(spark, sf))


DECLARED = "declared as (select distinct type, key from vals where key is not null)"


@query(
    "A20_declared_missing",
    with_tape(
        """select d.type, d.key, n.events - coalesce(p.present, 0) as missing from declared d join (select type, count(*) as events from tape group by type) n on n.type = d.type
 left join (select type, key, count(distinct id) as present from vals group by 1, 2) p on p.type = d.type and p.key = d.key where n.events > coalesce(p.present, 0)""",
        *LONG, DECLARED,
    ),
)
def a20(spark, sf):
    found = values(spark, sf)
    return cx.declared_missing(found, tape(spark, sf), found.select("type", "key").distinct())


DRAW = "cast('0x' || substr(sha256(concat_ws(chr(31), client, cast(id as varchar), key)), 1, 13) as bigint) / 4503599627370496.0"


@query(
    "A21_bottom_k_sample",
    with_tape(f"select id, key, number from (select *, row_number() over (partition by key order by {DRAW}, id) as rn from numbers) where rn <= 200", NUMBERS),
)
def a21(spark, sf):
    draw = uniform(F.col("client"), F.col("id"), F.col("key"))
    return cx.bottom_k(numbers(spark, sf), "key", draw, "id", 200).select("id", "key", "number")


EDGES = f"""edges as (select key, cond, list_sort(list_distinct(list_filter(qs, lambda e: e > lo))) as edges from
 (select key, cond, quantile_disc(number, [{", ".join(f"{i}/16.0" for i in range(1, 16))}]) as qs, min(number) as lo from numbers where {GOOD} group by key, cond))"""


@query(
    "A22_quantile_edges",
    with_tape("select key, cond, unnest(edges) as edge, unnest(range(len(edges))) as place from edges", NUMBERS, EDGES),
)
def a22(spark, sf):
    good = numbers(spark, sf).filter(cx.is_number(F.col("number")))
    edges = cx.quantile_edges(good, ["key", "cond"], 16)
    return edges.select("key", "cond", F.posexplode("edges").alias("place", "edge")).select(
        "key", "cond", F.col("place").cast("bigint").alias("place"), "edge"
    )


SCALES = [
    cx.Scale("amount", "quantile", bins=8, fallback=(1000, 5000, 20000), negative_invalid=True),
    cx.Scale("balance", "quantile", bins=8, fallback=(0,), negative_bins=4),
    cx.Scale("days", "fixed", boundaries=(5, 10, 20, 30), zero_separate=True),
    cx.Scale("score", "unfitted"),
]


def _disc(bins, where, name):
    return (
        f"{name} as (select key, cond, list_sort(list_distinct(list_filter(qs, lambda e: e > lo))) as edges, n, clients from (select key, cond, "
        f"quantile_disc(number, [{', '.join(f'{i}/{bins}.0' for i in range(1, bins))}]) as qs, min(number) as lo, count(*) as n, count(distinct client) as clients "
        f"from numbers where {where} group by key, cond))"
    )


SCALE_CTES = (
    _disc(8, "key='amount' and number >= 0", "amount_scale"),
    _disc(8, "key='balance' and number >= 0", "rest_scale"),
    _disc(4, "key='balance' and number < 0", "minus_scale"),
    """scales as (select key, cond, case when n >= 50 and clients >= 5 and len(edges) > 0 then edges else [1000.0, 5000.0, 20000.0]::double[] end as edges,
 case when n >= 50 and clients >= 5 and len(edges) > 0 then 'train' else 'fallback' end as origin, false as zero from amount_scale
 union all select r.key, r.cond, list_sort(list_distinct(list_concat(r.edges, case when m.n >= 50 then list_concat(m.edges, [0.0]::double[]) when m.n > 0 then [0.0]::double[] else []::double[] end))), 'train', false
 from rest_scale r left join minus_scale m on m.key = r.key
 union all select 'days', null, [5.0, 10.0, 20.0, 30.0]::double[], 'config', true
 union all select 'score', null, []::double[], 'none', false)""",
)


def scales(spark, sf):
    # Fitted once and frozen; every user reads the written table.
    return written(cx.fit_scales(numbers(spark, sf), SCALES), "scales")


@query(
    "A23_bucket_scales",
    with_tape("select key, cond, origin, zero, array_to_string(edges, ',') as edges, len(edges) as n_edges from (select * replace(list_transform(edges, lambda e: cast(e as decimal(18,2))) as edges) from scales)", NUMBERS, *SCALE_CTES),
)
def a23(spark, sf):
    text = F.array_join(F.transform("edges", lambda e: e.cast("decimal(18,2)").cast("string")), ",")
    return scales(spark, sf).select(
        "key", "cond", "origin", "zero", text.alias("edges"), F.size("edges").cast("bigint").alias("n_edges")
    )


PLACED = f"""placed as (select n.id, n.key, n.cond, number, case when s.origin is null or s.origin = 'none' then null when s.zero and number = 0 then 0
 else len(list_filter(s.edges, lambda e: e <= number)) + s.zero::int end::int as place from numbers n
 left join scales s on s.key = n.key and s.cond is not distinct from n.cond where {GOOD})"""


def placed(spark, sf):
    good = numbers(spark, sf).filter(cx.is_number(F.col("number")))
    return cx.bucket_place(good, scales(spark, sf))


@query("V5_bucket_lookup", with_tape("select id, key, cond, number, place from placed", NUMBERS, *SCALE_CTES, PLACED))
def v5(spark, sf):
    return placed(spark, sf).select("id", "key", "cond", "number", "place")


@query(
    "A24_bucket_occupancy",
    with_tape(
        """select b.key, b.cond, b.place, count(p.id) as n from (select key, cond, unnest(range(len(edges) + 1 + zero::int))::int as place from scales where origin <> 'none') b
 left join placed p on p.key = b.key and p.cond is not distinct from b.cond and p.place = b.place group by 1, 2, 3""",
        NUMBERS, *SCALE_CTES, PLACED,
    ),
)
def a24(spark, sf):
    good = numbers(spark, sf).filter(cx.is_number(F.col("number")))
    return cx.occupancy(good, scales(spark, sf))


COUNTS = "counts as (select key, vtype, value, count(*) as occurrences from train where kind = 'categorical' group by 1, 2, 3)"
ENTROPY = """entropies as (select key, sum(occurrences)::bigint as total, count(*) as distinct_values, -sum(p * ln(p)) as entropy from
 (select *, occurrences / sum(occurrences) over (partition by key) as p from counts) group by key)"""
WEIGHTS = """weights as (select c.*, e.entropy, case when e.distinct_values < 2 then 0.0 else e.entropy / ln(e.distinct_values) end as key_weight,
 least(3.0, greatest(0.25, (-ln(c.occurrences / e.total) + 1) / (e.entropy + 1))) as value_weight from counts c join entropies e on e.key = c.key)"""


def counts(spark, sf):
    return cx.value_counts(train(spark, sf).filter("kind = 'categorical'")).drop("clients")


@query(
    "A25_key_entropy",
    with_tape(
        "select key, total, distinct_values, round(entropy, 9) as entropy, round(case when distinct_values < 2 then 0.0 else entropy / ln(distinct_values) end, 9) as key_weight from entropies",
        *LONG, TRAIN, COUNTS, ENTROPY,
    ),
)
def a25(spark, sf):
    found = cx.key_entropy(counts(spark, sf))
    return found.select(
        "key", "total", "distinct_values", (F.round("entropy", 9) + 0.0).alias("entropy"), (F.round("key_weight", 9) + 0.0).alias("key_weight")
    )


@query(
    "A26_value_weights",
    with_tape(
        "select key, value, round(value_weight, 8) as value_weight, (select round(sum(occurrences) / sum(occurrences * key_weight * value_weight), 8) from weights) as scale from weights",
        *LONG, TRAIN, COUNTS, ENTROPY, WEIGHTS,
    ),
)
def a26(spark, sf):
    # One row per value: written once, read by the weights and their scale.
    weights = written(cx.value_weights(written(counts(spark, sf), "counts")), "weights")
    scale = cx.weight_scale(weights).scalar()
    return weights.select("key", "value", F.round("value_weight", 8).alias("value_weight"), F.round(scale, 8).alias("scale"))


SIDES = f"""before_t as (select key, value, count(*) as n from vals where kind = 'categorical' and t < {CUTOFF} group by 1, 2),
after_t as (select key, value, count(*) as n from vals where kind = 'categorical' and t >= {CUTOFF} group by 1, 2),
both_t as (select coalesce(a.key, b.key) as key, coalesce(a.n, 0) as an, coalesce(b.n, 0) as bn from before_t a full outer join after_t b on a.key = b.key and a.value = b.value)"""


def side_counts(spark, sf):
    rows = values(spark, sf).filter("kind = 'categorical'")
    before = rows.filter(F.col("t") < CUTOFF).groupBy("key", "value").agg(F.count(F.lit(1)).alias("n"))
    after = rows.filter(F.col("t") >= CUTOFF).groupBy("key", "value").agg(F.count(F.lit(1)).alias("n"))
    return before, after


@query(
    "A27_total_variation",
    with_tape(
        "select key, round(0.5 * sum(abs(an / ta - bn / tb)), 9) as tv from (select *, sum(an) over (partition by key) as ta, sum(bn) over (partition by key) as tb from both_t) group by key",
        *LONG, SIDES,
    ),
)
def a27(spark, sf):
    before, after = side_counts(spark, sf)
    return cx.total_variation(before, after, ["key"], "value").select("key", F.round("tv", 9).alias("tv"))


PAIRS = """one_value as (select id, key, max(value) as value from train where kind = 'categorical' group by 1, 2),
joint as (select a.key as a, b.key as b, a.value as av, b.value as bv, count(*) as n from one_value a join one_value b on a.id = b.id and a.key <> b.key group by 1, 2, 3, 4)"""


@query(
    "J13_pairs_inside_event",
    with_tape("select a, b, sum(n)::bigint as events from joint group by a, b", *LONG, TRAIN, PAIRS),
)
def j13(spark, sf):
    one = train(spark, sf).filter("kind = 'categorical'").select("id", "key").distinct()
    pairs = cx.paired(one).groupBy("a", "b").agg(F.count(F.lit(1)).alias("events"))
    # Every pair is counted once and read both ways.
    both = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("p")
    return pairs.select(both, "events").select("p.a", "p.b", "events")


@query(
    "A28_dependent_pairs",
    with_tape(
        """select b, a, events, round(greatest(0.0, hab - ha) / hb, 8) as ratio from (select a, b, sum(n)::bigint as events,
 -sum(n / t * ln(n / t)) as hab from (select *, sum(n) over (partition by a, b) as t from joint) group by a, b) x
 join (select a, b, -sum(n / t * ln(n / t)) as ha, count(*) as na from (select a, b, av, sum(n) as n, sum(sum(n)) over (partition by a, b) as t from joint group by a, b, av) group by a, b) y using (a, b)
 join (select a, b, -sum(n / t * ln(n / t)) as hb, count(*) as nb from (select a, b, bv, sum(n) as n, sum(sum(n)) over (partition by a, b) as t from joint group by a, b, bv) group by a, b) z using (a, b)
 where nb >= 2 and events >= 20 * na""",
        *LONG, TRAIN, PAIRS,
    ),
)
def a28(spark, sf):
    found = cx.dependent_pairs(train(spark, sf).filter("kind = 'categorical'"))
    return found.select("b", "a", "events", F.round("ratio", 8).alias("ratio"))


@query(
    "A29_mode_with_share",
    with_tape(
        "select key, value as top, n / total as share from (select *, sum(n) over (partition by key) as total, row_number() over (partition by key order by n desc, value) as rn from before_t) where rn = 1",
        *LONG, SIDES,
    ),
)
def a29(spark, sf):
    return cx.mode(side_counts(spark, sf)[0], ["key"], "value")


@query(
    "A41_amount_by_type",
    with_tape(
        "select type, median(amount) as median, avg((amount >= 20000)::int) as share_top, count(*) as n from tape where amount is not null group by type",
    ),
)
def a41(spark, sf):
    rows = tape(spark, sf).filter("amount is not null")
    medians = quantiles(rows, ["type"], "amount", {"median": 0.5})
    shares = rows.groupBy("type").agg(
        F.avg((F.col("amount") >= 20000).cast("int")).alias("share_top"), F.count(F.lit(1)).alias("n")
    )
    return medians.join(shares, "type")


FLOWSUM = f"""mids as (select p.id, t.client, p.number, case when place = 0 then s.edges[1] when place >= len(s.edges) then s.edges[len(s.edges)] else (s.edges[place] + s.edges[place + 1]) / 2 end as mid
 from placed p join scales s on s.key = 'amount' and s.cond = 'debit' join tape t on t.id = p.id where p.key = 'amount' and p.cond = 'debit'),
sums as (select client, sum(number) as exact, sum(mid) as approx from mids group by client),
ranked as (select rank() over (order by exact) + (count(*) over (partition by exact) - 1) / 2.0 as re, rank() over (order by approx) + (count(*) over (partition by approx) - 1) / 2.0 as ra from sums)"""


@query("A40_bucket_precision", with_tape("select count(*) as clients, round(corr(re, ra), 9) as rank_correlation from ranked", NUMBERS, *SCALE_CTES, PLACED, FLOWSUM))
def a40(spark, sf):
    amounts = numbers(spark, sf).filter("key = 'amount' and cond = 'debit'")
    fitted = written(cx.fit_scales(amounts, SCALES[:1]), "scales")
    return cx.bucket_precision(amounts, fitted, "client").select(
        F.col("n").alias("clients"), F.round("rank_correlation", 9).alias("rank_correlation")
    )


COINCIDE = f"stamps as (select client, id, type, t // {DAY} as t from tape)"


@query(
    "A43_same_instant_pairs",
    with_tape("select a.type, b.type as other, count(*) as pairs from stamps a join stamps b on a.client = b.client and a.t = b.t and a.id <> b.id group by 1, 2", COINCIDE),
)
def a43(spark, sf):
    rows = tape(spark, sf).select("client", "id", "type", F.floor(F.col("t") / F.lit(DAY)).cast("bigint").alias("t"))
    return cx.coincident_pairs(rows)


@query(
    "A43_pairs_sharing_a_value",
    with_tape(
        """select a.key, a.type, b.type as other, count(*) as pairs from (select v.*, v.t // 86400000000 as day from vals v where key in ('mcc','status','payment_channel')) a
 join (select v.*, v.t // 86400000000 as day from vals v) b on a.client = b.client and a.day = b.day and a.key = b.key and a.value = b.value and a.id <> b.id group by 1, 2, 3""",
        *LONG,
    ),
)
def a43_shared(spark, sf):
    rows = values(spark, sf).filter("key in ('mcc', 'status', 'payment_channel')").withColumn(
        "t", F.floor(F.col("t") / F.lit(DAY)).cast("bigint")
    )
    return cx.coincident_pairs(rows, ("client", "t", "key", "value"), ("key",))


@query(
    "A45_milestone_coincidence",
    with_tape(
        """select kind, type, count(*) as n from (select client, 'bank_registered' as kind, bank_registered // 86400000000 as t from snap union all
 select client, 'app_registered', app_registered // 86400000000 from snap where app_registered is not null union all
 select client, 'first_loan_opened', first_loan_opened // 86400000000 from snap where first_loan_opened is not null) m
 join (select client, type, t // 86400000000 as t from tape) e using (client, t) group by 1, 2""",
        SNAPSHOT,
    ),
)
def a45(spark, sf):
    day = lambda c: F.floor(c / F.lit(DAY)).cast("bigint")
    items = snapshot(spark, sf).select("client", F.explode("lifelong").alias("x")).select(
        "client", F.col("x.type").alias("kind"), day(F.col("x.t")).alias("t")
    )
    return cx.coincident_milestones(items, tape(spark, sf).select("client", "type", day(F.col("t")).alias("t")))


@query(
    "Q28_unknown_rates",
    with_tape(
        f"""select v.key, grp, count(*) as n, count(*) filter (where s.key is null) as unseen, count(*) filter (where s.key is null) / count(*) as rate from
 (select *, case when t < {CUTOFF + 30 * DAY} then 'val' else 'test' end as grp from vals where key is not null and kind <> 'numeric' and t >= {CUTOFF}) v
 left join (select distinct key, value from train where kind <> 'numeric') s on s.key = v.key and s.value = v.value group by 1, 2""",
        *LONG, TRAIN,
    ),
)
def q28(spark, sf):
    rows = values(spark, sf).filter("kind <> 'numeric'")
    later = rows.filter(F.col("t") >= CUTOFF).withColumn(
        "grp", F.when(F.col("t") < CUTOFF + 30 * DAY, "val").otherwise("test")
    )
    return cx.unknown_rates(rows.filter(F.col("t") < CUTOFF), later)


@query(
    "F1_normalize_notes",
    with_tape(f"select id, {NORMAL.replace('value', 'note')} as normalized from tape where note is not null"),
)
def f1(spark, sf):
    return normalized(tape(spark, sf).filter("note is not null").select("id", "note"), "note").select("id", "normalized")


@query("F1_normalize_documents")
def f1_documents(spark, sf):
    # Four languages: beyond ASCII the rule runs in Arrow batches, checked in the tests.
    return normalized(read(spark, sf, "documents").select("doc_id", "text"), "text").select(
        "doc_id", F.sha2("normalized", 256).alias("digest"), F.length("normalized").alias("n_chars")
    )

