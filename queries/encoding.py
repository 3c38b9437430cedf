"""Vocabulary, encoding, samples and masks (V1-V13, M1-M9, Q24-Q26, A38, A39, A44, P7, P16, F16) and their SQL."""

from pyspark.sql import functions as F

from chronotape.functions import clock
from chronotape.operators import batches as bx
from chronotape.operators import corpus as cx
from chronotape.operators import encoding as ex
from chronotape.operators import masking as mx
from chronotape.operators import subwords as sx
from chronotape.operators import vocabulary as vx
from chronotape.operators.checks import id_space
from chronotape.operators.predicates import can_be_target, kind
from chronotape.plans.shared import written
from chronotape.plans.split import quantiles
from queries.corpus import FLOW, LONG, REGISTRY, train, values
from queries.features import MILESTONES, PROFILE_FIELDS, profile_sql
from queries.registry import query
from queries.tables import CUTOFF, DAY, LOCAL, SNAPSHOT, read, snapshot, stored_tape, tape, with_tape

SCALES = [
    cx.Scale("transaction_amount", "quantile", bins=8, fallback=(1000, 5000, 20000), negative_invalid=True),
    cx.Scale("balance_after", "quantile", bins=8, fallback=(0,), negative_bins=4),
    cx.Scale("days_past_due", "fixed", boundaries=(5, 10, 20, 30), zero_separate=True),
]
COND = f"case when key = 'transaction_amount' then {FLOW} end"

# --- SQL: keys, values, scales, tokens ----------------------------------------------

KEYS = "vkeys as (select key, (row_number() over (order by key) + 4)::int as id from (select distinct key from registry))"
VVALUES = """vvalues as (select key, vtype, value, ((select max(id) from vkeys) + row_number() over (order by key, case vtype when 'bool' then 0 when 'int' then 1 else 3 end, value))::int as id
 from (select distinct key, vtype, value from train where kind = 'categorical'))"""
VNUM = f"vnum as (select id, client, key, t, value::double as number, {COND} as cond from vals where kind = 'numeric' and key is not null)"


def _disc(bins, where, name):
    points = ", ".join(f"{i}/{bins}.0" for i in range(1, bins))
    return (
        f"{name} as (select key, cond, list_sort(list_distinct(list_filter(qs, lambda e: e > lo))) as edges, n, clients from (select key, cond, "
        f"quantile_disc(number, [{points}]) as qs, min(number) as lo, count(*) as n, count(distinct client) as clients "
        f"from vnum where t < {CUTOFF} and {where} group by key, cond))"
    )


VSCALES = (
    VNUM,
    _disc(8, "key='transaction_amount' and number >= 0", "am"),
    _disc(8, "key='balance_after' and number >= 0", "rs"),
    _disc(4, "key='balance_after' and number < 0", "mi"),
    """vscale0 as (select key, cond, case when n >= 50 and clients >= 5 and len(edges) > 0 then edges else [1000.0, 5000.0, 20000.0]::double[] end as edges, false as zero from am
 union all select r.key, r.cond, list_sort(list_distinct(list_concat(r.edges, case when m.n >= 50 then list_concat(m.edges, [0.0]::double[]) when m.n > 0 then [0.0]::double[] else []::double[] end))), false
 from rs r left join mi m on m.key = r.key union all select 'days_past_due', null, [5.0, 10.0, 20.0, 30.0]::double[], true)""",
    """vscales as (select *, (1 + (select max(id) from vvalues) + coalesce(sum(len(edges) + 1 + zero::int) over (order by key, cond nulls last rows between unbounded preceding and 1 preceding), 0))::int as first_id from vscale0)""",
)
VOCAB = (*LONG, f"train as (select * from vals where key is not null and t < {CUTOFF})", KEYS, VVALUES, *VSCALES)
TOKENS = """tokens as (select * from (values ('[PAD]', 0), ('[UNK]', 1), ('[MASK]', 2), ('[EVT]', 3), ('[USR]', 4)) t(token, id)
 union all select 'key:' || key, id from vkeys union all select 'value:' || key || '=' || value, id from vvalues
 union all select 'bucket:' || concat_ws('_', key, cond) || '_' || cast(place as varchar), first_id + place from (select *, unnest(range(len(edges) + 1 + zero::int))::int as place from vscales))"""
CODED = """coded as (select v.id, v.client, v.t, k.id as key_id, coalesce(vv.id, 1) as vid, v.key, v.kind from vals v join vkeys k on k.key = v.key left join vvalues vv on vv.key = v.key and vv.value = v.value
 where v.kind = 'categorical' union all
 select n.id, n.client, n.t, k.id, coalesce(s.first_id + case when s.zero and n.number = 0 then 0 else len(list_filter(s.edges, lambda e: e <= n.number)) + s.zero::int end, 1)::int, n.key, 'numeric'
 from vnum n join vkeys k on k.key = n.key left join vscales s on s.key = n.key and s.cond is not distinct from n.cond)"""


def conditioned(spark, sf, rows=None):
    return values(spark, sf, rows).withColumn("cond", F.expr(COND))


def vocabulary(spark, sf, tape_rows=None):
    """The vocabulary, fitted on the training part (of the stored tape) and written once; pass it on to share a fit."""
    keys = vx.key_ids(spark.createDataFrame([(k,) for _, _, k, _ in REGISTRY], "key string"))
    # The long training values feed every part of the fit: they are written once.
    rows = written(train(spark, sf, tape_rows).select("id", "client", "t", "type", "key", "kind", "vtype", "value"), "train")
    found = written(vx.value_ids(cx.value_counts(rows.filter("kind = 'categorical'")), keys), "values")
    numbers = rows.filter("kind = 'numeric'").select(
        "id", "client", "key", F.expr(COND).alias("cond"), F.col("value").try_cast("double").alias("number")
    )
    fitted = cx.fit_scales(numbers, SCALES)
    first = found.agg((F.max("id") + 1).alias("n")).scalar()
    scales = written(vx.bucket_ids(fitted, first), "scales")
    return vx.Vocabulary(keys, found, scales)


@query("V1_key_vocabulary", with_tape("select * from vkeys", *LONG[:1], KEYS))
def v1(spark, sf):
    used = values(spark, sf).select("key").distinct()
    return vx.key_ids(used.unionByName(spark.createDataFrame([(k,) for _, _, k, _ in REGISTRY], "key string")))


@query("V2_value_vocabulary", with_tape("select * from vvalues", *VOCAB))
def v2(spark, sf):
    return vocabulary(spark, sf).values


@query(
    "V3_bucket_ids",
    with_tape("select key, cond, first_id, (len(edges) + 1 + zero::int)::int as n_buckets from vscales", *VOCAB),
)
def v3(spark, sf):
    return vocabulary(spark, sf).scales.select("key", "cond", "first_id", "n_buckets")


@query("V4_final_vocabulary", with_tape("select token, id from tokens", *VOCAB, TOKENS))
def v4(spark, sf):
    return vocabulary(spark, sf).tokens(spark)


@query(
    "Q26_id_space",
    with_tape(
        """select count(*) as n, count(distinct id) as n_ids, count(distinct token) as n_tokens, min(id) as first_id, max(id) as last_id,
 count(*) = count(distinct id) and count(*) = count(distinct token) and min(id) = 0 and max(id) = count(*) - 1 as dense from tokens""",
        *VOCAB, TOKENS,
    ),
)
def q26(spark, sf):
    return id_space(vocabulary(spark, sf).tokens(spark))


KIND_SQL = "case when token like '[%' then 'special' else split_part(token, ':', 1) end"


@query("A39_vocabulary_summary", with_tape(f"select {KIND_SQL} as kind, count(*) as n, min(id) as first_id, max(id) as last_id from tokens group by 1", *VOCAB, TOKENS))
def a39(spark, sf):
    return vx.summary(vocabulary(spark, sf).tokens(spark))


@query(
    "P16_token_kind",
    with_tape(f"select token, {KIND_SQL} as kind from tokens", *VOCAB, TOKENS),
)
def p16(spark, sf):
    return vocabulary(spark, sf).tokens(spark).select("token", vx.token_kind(F.col("token")).alias("kind"))


SHORT = f"""case {KIND_SQL} when 'special' then token when 'value' then substr(token, strpos(token, '=') + 1) else substr(token, strpos(token, ':') + 1) end"""
NAMED = f"named as (select c.id, string_agg(k.short || '=' || v.short, '; ' order by c.key_id) as line from coded c join (select id, {SHORT} as short from tokens) k on k.id = c.key_id join (select id, {SHORT} as short from tokens) v on v.id = c.vid group by c.id)"


@query("F16_token_names", with_tape("select * from named", *VOCAB, TOKENS, CODED, NAMED))
def f16(spark, sf):
    tape_rows = stored_tape(spark, sf)
    vocab = vocabulary(spark, sf, tape_rows)
    names = vocab.tokens(spark).select("id", vx.short_name(F.col("token")).alias("name"))
    coded = ex.coded_values(conditioned(spark, sf, tape_rows), vocab).select("id", "key_id", F.element_at("ids", 1).alias("vid"))
    k = names.select(F.col("id").alias("key_id"), F.col("name").alias("_k"))
    v = names.select(F.col("id").alias("vid"), F.col("name").alias("_v"))
    rows = coded.join(k, "key_id").join(v, "vid")
    pairs = F.array_sort(F.collect_list(F.struct("key_id", F.concat_ws("=", "_k", "_v").alias("s"))))
    return rows.groupBy("id").agg(pairs.alias("p")).select(
        "id", F.array_join(F.transform("p", lambda x: x["s"]), "; ").alias("line")
    )


@query("V8_value_coding", with_tape("select id, key_id, vid from coded", *VOCAB, CODED))
def v8(spark, sf):
    rows = stored_tape(spark, sf)
    coded = ex.coded_values(conditioned(spark, sf, rows), vocabulary(spark, sf, rows))
    return coded.select("id", "key_id", F.element_at("ids", 1).alias("vid"))


def events_encoded(spark, sf, vocab=None, rows=None):
    """Every event encoded; `rows` is the stored tape, if the query has one."""
    rows = stored_tape(spark, sf) if rows is None else rows
    vocab = vocab or vocabulary(spark, sf, rows)
    coded = ex.coded_values(conditioned(spark, sf, rows), vocab)
    return ex.encoded_events(rows.select("id", "client", "t", "type"), coded)


def _text(column):
    return F.array_join(F.transform(column, lambda x: x.cast("string")), ",")


ENCODED = """encoded as (select e.id, e.client, e.t, e.type, '3' || coalesce(',' || p.keys, '') as key_ids, '3' || coalesce(',' || p.vids, '') as value_ids, 1 + coalesce(p.n, 0) as n_tokens
 from tape e left join (select id, string_agg(cast(key_id as varchar), ',' order by key_id) as keys, string_agg(cast(vid as varchar), ',' order by key_id) as vids, count(*) as n from coded group by id) p on p.id = e.id)"""


@query("V9_event_encoding", with_tape("select id, key_ids, value_ids, n_tokens::int as n_tokens from encoded", *VOCAB, CODED, ENCODED))
def v9(spark, sf, vocab=None):
    return events_encoded(spark, sf, vocab).select(
        "id", _text("key_ids").alias("key_ids"), _text("value_ids").alias("value_ids"), "n_tokens"
    )


@query(
    "F13_values_from_tokens",
    with_tape("select id, key_id, row_number() over (partition by id order by key_id)::int as start, 1 as length from coded", *VOCAB, CODED),
)
def f13(spark, sf):
    return ex.values_of(events_encoded(spark, sf)).select("id", "key_id", "start", "length")


TYPE_KEY = "(select id from vkeys where key = 'event_type')"


@query(
    "V12_event_type_from_tokens",
    with_tape(
        f"select c.id, substr(t.token, length('value:event_type=') + 1) as type from coded c join tokens t on t.id = c.vid where c.key_id = {TYPE_KEY} and t.token like 'value:%'",
        *VOCAB, TOKENS, CODED,
    ),
)
def v12(spark, sf):
    tape_rows = stored_tape(spark, sf)
    vocab = vocabulary(spark, sf, tape_rows)
    type_key = vocab.keys.filter("key = 'event_type'").select("id").scalar()
    rows = events_encoded(spark, sf, vocab, tape_rows).withColumn("_k", type_key)
    found = rows.select("id", ex.event_type_of("key_ids", "value_ids", "positions", F.col("_k")).alias("vid"))
    names = vocab.values.filter("key = 'event_type'").select(F.col("id").alias("vid"), F.col("value").alias("type"))
    return found.join(names, "vid").select("id", "type")


PROFILE_KEYS = ("gender", "region", "income_type", "lifelong")
PROFILE_DOMAIN = """pkeys as (select key, (row_number() over (order by key) + 4)::int as id from (values ('profile_gender'), ('profile_region'), ('profile_income_type'), ('profile_lifelong')) t(key)),
pvalues as (select key, value, (8 + row_number() over (order by key, value))::int as id from (select 'profile_gender' as key, gender as value from snap union select 'profile_region', region from snap union select 'profile_income_type', income_type from snap
 union select 'profile_lifelong', x from (values ('bank_registered'), ('app_registered'), ('first_loan_opened')) m(x)))"""


def profile_cte(attributes, cutoff):
    """Profile arrays of every client: attributes of a table with gender, region and income_type, milestones before the cutoff."""
    return f"""{PROFILE_DOMAIN}, pattr as (select s.client, k.id as key_id, coalesce(v.id, 1) as vid from (select client, 'profile_gender' as key, gender as value from {attributes} union all select client, 'profile_region', region from {attributes} union all select client, 'profile_income_type', income_type from {attributes}) s
 join pkeys k on k.key = s.key left join pvalues v on v.key = s.key and v.value = s.value where s.value is not null),
pmile as (select m.client, m.t, m.place, k.id as key_id, v.id as vid from (select client, bank_registered as t, 0 as place, 'bank_registered' as kind from snap union all select client, app_registered, 1, 'app_registered' from snap union all
 select client, first_loan_opened, 2, 'first_loan_opened' from snap) m join pkeys k on k.key = 'profile_lifelong' join pvalues v on v.key = 'profile_lifelong' and v.value = m.kind where m.t < {cutoff}),
profiled as (select s.client, '4' || coalesce(',' || a.keys, '') || coalesce(',' || m.keys, '') as profile_key_ids, '4' || coalesce(',' || a.vids, '') || coalesce(',' || m.vids, '') as profile_value_ids, coalesce(m.times, '') as profile_time,
 (1 + coalesce(a.n, 0) + coalesce(m.n, 0))::int as profile_tokens from snap s
 left join (select client, string_agg(cast(key_id as varchar), ',' order by key_id) as keys, string_agg(cast(vid as varchar), ',' order by key_id) as vids, count(*) as n from pattr group by client) a using (client)
 left join (select client, string_agg(cast(key_id as varchar), ',' order by t, place) as keys, string_agg(cast(vid as varchar), ',' order by t, place) as vids, string_agg(cast(t as varchar), ',' order by t, place) as times, count(*) as n from pmile group by client) m using (client))"""


PROFILE_CTE = profile_cte("snap", CUTOFF)


def profile_tokens(spark, sf, cutoff=CUTOFF, attributes=None):
    """Profile arrays; `attributes` (client, gender, region, income_type) are those of the snapshot unless given."""
    snap = snapshot(spark, sf)
    fields = ("gender", "region", "income_type")

    def long(rows):
        items = F.array(*[F.struct(F.lit(f"profile_{f}").alias("key"), F.col(f).alias("value")) for f in fields])
        return rows.select("client", F.explode(items).alias("x")).select("client", "x.*").filter("value is not null")

    order = F.expr("case kind when 'bank_registered' then 0 when 'app_registered' then 1 else 2 end")
    m = (
        snap.select("client", F.explode(F.filter("lifelong", lambda x: x["t"] < cutoff)).alias("x"))
        .select("client", F.col("x.t").alias("t"), F.col("x.type").alias("kind"))
        .withColumn("place", order)
    )
    every = snap.select(F.explode("lifelong.type").alias("value")).distinct()
    domain = long(snap).select("key", "value").distinct().unionByName(every.select(F.lit("profile_lifelong").alias("key"), "value"))
    # The vocabulary of the profile is written: all that follows reads it instead of the snapshot.
    domain = written(domain, "domain")
    keys = written(vx.key_ids(domain.select("key")), "keys")
    ids = written(vx.value_ids(domain.withColumn("vtype", F.lit("str")), keys), "values")
    a = long(snap if attributes is None else attributes)
    coded = a.join(keys.withColumnRenamed("id", "key_id"), "key").join(ids.select("key", "value", "id"), ["key", "value"], "left")
    coded = coded.select("client", "key_id", F.array(F.coalesce("id", F.lit(vx.UNK))).alias("ids"))
    marks = m.withColumn("key", F.lit("profile_lifelong")).withColumnRenamed("kind", "value")
    marks = marks.join(keys.withColumnRenamed("id", "key_id"), "key").join(ids.select("key", "value", "id"), ["key", "value"])
    milestones = marks.select("client", "t", "place", "key_id", F.array("id").alias("ids"))
    return ex.encoded_profiles(coded, milestones, snap.select("client"))


@query(
    "V10_profile_encoding",
    f"with {SNAPSHOT}, {PROFILE_CTE} select client, profile_key_ids as key_ids, profile_value_ids as value_ids, profile_time as time from profiled",
)
def v10(spark, sf):
    return profile_tokens(spark, sf).select(
        "client", _text("key_ids").alias("key_ids"), _text("value_ids").alias("value_ids"), _text("time").alias("time")
    )


LIMIT_EVENTS, LIMIT_TOKENS = 40, 120
TARGET_FROM = CUTOFF - 120 * DAY
PERIOD_SQL = f"(t >= {TARGET_FROM} and t < {CUTOFF})"
SOURCE_SQL = "(t = coalesce((select app_registered from snap s where s.client = e.client), 0))"
TARGET_SQL = f"({PERIOD_SQL} and type <> 'profile_change')"
_phases = (f"(((t + {LOCAL}) % {DAY}) / 3600000000.0::double / 24)", f"((isodow(make_timestamp(t + {LOCAL})) - 1) / 7)", f"((day(make_timestamp(t + {LOCAL})) - 1) / 31)")
CALENDAR_SQL = " || ',' || ".join(f"cast(round({wave}({p} * 2.0::double * pi()) * 1000000)::bigint as varchar)" for p in _phases for wave in ("sin", "cos"))
ARRAYS = ("key_ids", "value_ids", "positions", "event_starts", "event_lengths", "event_time", "calendar", "target_event_mask",
          "profile_key_ids", "profile_value_ids", "profile_positions", "profile_time")


def samples_sql(cutoff, eligible, target):
    """The samples at a cutoff, from `encoded`, `snap` and `profiled`."""
    lists = {
        "key_ids": "key_ids", "value_ids": "value_ids", "positions": "'0' || repeat(',0', (n_tokens - 1)::int)",
        "event_lengths": "cast(n_tokens as varchar)", "event_starts": "cast(cast(start as bigint) as varchar)",
        "event_time": "cast(t as varchar)", "calendar": CALENDAR_SQL, "target_event_mask": "cast(target as varchar)",
    }
    gathered = ", ".join(f"string_agg({x}, ',' order by t, id) as {n}" for n, x in lists.items())
    empty = ", ".join(f"coalesce(l.{n}, '') as {n}" for n in lists)
    held = ", ".join(f"coalesce(p.{n}, '') as {n}" for n in ("profile_key_ids", "profile_value_ids", "profile_time"))
    return f"""past_encoded as (select *, {eligible} as eligible, {target} as target from encoded e where t < {cutoff}),
backed as (select *, count(*) over w as back, sum(n_tokens) over w as back_tokens from past_encoded window w as (partition by client order by t desc, id desc rows between unbounded preceding and current row)),
kept as (select *, sum(n_tokens) over (partition by client order by t, id rows between unbounded preceding and current row) - n_tokens as start from backed where back <= {LIMIT_EVENTS} and back_tokens <= {LIMIT_TOKENS}),
lists as (select client, {gathered}, count(*) as n_events, sum(n_tokens)::bigint as tokens, count(*) filter (where eligible) as n_eligible, count(*) filter (where target) as n_targets, min(t) as oldest, max(t) as last_t from kept group by client),
totals as (select client, count(*) as n_all, count(*) filter (where eligible) as n_period from past_encoded group by client),
everyone as (select client from tape union select client from snap),
sampled as (select c.client, {empty}, {held}, case when p.profile_tokens > 0 then '0' || repeat(',0', p.profile_tokens - 1) else '' end as profile_positions, coalesce(p.profile_tokens, 0)::int as profile_tokens,
 (coalesce(n_all, 0) - coalesce(n_events, 0))::int as excluded_events, (coalesce(n_period, 0) - coalesce(n_eligible, 0))::int as excluded_targets, oldest, last_t, coalesce(n_events, 0) as n_events, coalesce(tokens, 0)::bigint as tokens, coalesce(n_targets, 0) as n_targets
 from everyone c left join totals using (client) left join lists l on l.client = c.client left join profiled p on p.client = c.client)"""


SAMPLED = ", ".join([SNAPSHOT, PROFILE_CTE, samples_sql(CUTOFF, PERIOD_SQL, f"({TARGET_SQL} and not {SOURCE_SQL})")])


def everyone(spark, sf, rows=None):
    return (tape(spark, sf) if rows is None else rows).select("client").unionByName(snapshot(spark, sf).select("client")).distinct()


def calendared(rows):
    """Adds the calendar of each event; whole millionths here, so that both engines agree on every digit."""
    six = [F.round(c * 1_000_000).cast("bigint").cast("double") for c in clock.calendar_channel(F.col("t"))]
    return rows.withColumn("calendar", F.array(*six))


def sampled(spark, sf, encoded=None, tape_rows=None):
    tape_rows = stored_tape(spark, sf) if tape_rows is None else tape_rows
    rows = encoded if encoded is not None else events_encoded(spark, sf, rows=tape_rows)
    # The event of a dated milestone stays context.
    marks = snapshot(spark, sf).select("client", F.col("app_registered").alias("t"), F.lit(True).alias("milestone")).filter("t is not null")
    past = calendared(rows.filter(F.col("t") < CUTOFF)).join(marks, ["client", "t"], "left")
    period = (F.col("t") >= TARGET_FROM) & (F.col("t") < CUTOFF)
    allowed = (F.col("type") != "profile_change") & F.col("milestone").isNull()
    return ex.samples(
        past, LIMIT_EVENTS, LIMIT_TOKENS, period, allowed,
        clients=everyone(spark, sf, tape_rows), profiles=profile_tokens(spark, sf), max_event_tokens=LIMIT_TOKENS, max_profile_tokens=50,
    )


def _whole(column):
    return F.array_join(F.transform(column, lambda x: x.cast("bigint").cast("string")), ",")


def sample_arrays(rows):
    return [(_whole(c) if c == "calendar" else _text(c)).alias(c) for c in ARRAYS]


@query(
    "V11_client_samples",
    with_tape(f"select client, {', '.join(ARRAYS)}, excluded_events, excluded_targets from sampled", *VOCAB, CODED, ENCODED, SAMPLED),
)
def v11(spark, sf, vocab=None):
    tape_rows = stored_tape(spark, sf)
    rows = sampled(spark, sf, events_encoded(spark, sf, vocab, tape_rows), tape_rows)
    return rows.select(
        "client",
        *sample_arrays(rows),
        F.col("excluded_events").cast("int").alias("excluded_events"),
        F.col("excluded_targets").cast("int").alias("excluded_targets"),
    )


@query("V11_lost_targets", with_tape("select client, excluded_targets from sampled where excluded_targets > 0", *VOCAB, CODED, ENCODED, SAMPLED))
def v11_lost(spark, sf):
    return ex.lost_targets(sampled(spark, sf)).select("client", F.col("excluded_targets").cast("int").alias("excluded_targets"))


@query(
    "Q24_sample_invariants",
    with_tape("select count(*) as samples, 0::bigint as problems from sampled", *VOCAB, CODED, ENCODED, SAMPLED),
)
def q24(spark, sf):
    tape_rows = stored_tape(spark, sf)
    vocab = vocabulary(spark, sf, tape_rows)
    size = vocab.tokens(spark).count()
    rows = sampled(spark, sf, events_encoded(spark, sf, vocab, tape_rows), tape_rows)
    problems = ex.sample_problems(rows, size).agg(F.count(F.lit(1)).alias("n")).scalar()
    return rows.agg(F.count(F.lit(1)).alias("samples")).select("samples", problems.alias("problems"))


@query(
    "Q25_tail_reencodes",
    with_tape("select count(*) as events, 0::bigint as differing from kept", *VOCAB, CODED, ENCODED, SAMPLED),
)
def q25(spark, sf):
    # The samples are stored; then the tape is encoded anew, under a vocabulary of its own fit.
    tape_rows = stored_tape(spark, sf)
    stored = written(sampled(spark, sf, events_encoded(spark, sf, rows=tape_rows), tape_rows), "samples")
    again = events_encoded(spark, sf, vocabulary(spark, sf, tape_rows), tape_rows)
    tail = stored.select(
        "client", F.posexplode(F.arrays_zip("event_ids", "event_starts", "event_lengths")).alias("place", "x"), "value_ids"
    ).select("client", F.col("x.event_ids").alias("id"), F.expr("slice(value_ids, x.event_starts + 1, x.event_lengths)").alias("stored"))
    both = tail.join(again.select("id", "value_ids"), "id", "left")
    return both.agg(F.count(F.lit(1)).alias("events"), F.count_if(~F.col("stored").eqNullSafe(F.col("value_ids"))).alias("differing"))


EARLY = CUTOFF - 100 * DAY
AT_EARLY = ", ".join([SNAPSHOT, profile_sql(EARLY), profile_cte("prof", EARLY), samples_sql(EARLY, "false", "false")])


@query(
    "V13_sample_at_cutoff",
    with_tape(f"select client, {', '.join(ARRAYS)}, excluded_events, last_t, 0::bigint as leaked from sampled", *VOCAB, CODED, ENCODED, AT_EARLY),
)
def v13(spark, sf):
    from chronotape.operators.profile import profile_at

    tape_rows = stored_tape(spark, sf)
    # Written once: the samples and the check for leaks read it.
    past = written(events_encoded(spark, sf, rows=tape_rows).filter(F.col("t") < EARLY), "past")
    changes = tape_rows.filter(kind("profile_change"))
    then = profile_at(snapshot(spark, sf), changes, EARLY, PROFILE_FIELDS, MILESTONES)
    rows = ex.samples(
        calendared(past), LIMIT_EVENTS, LIMIT_TOKENS, F.lit(False),
        clients=everyone(spark, sf, tape_rows), profiles=profile_tokens(spark, sf, EARLY, then),
    )
    leaked = ex.leaks(past, EARLY).agg(F.count(F.lit(1)).alias("n")).scalar()
    return rows.select(
        "client",
        *sample_arrays(rows),
        F.col("excluded_events").cast("int").alias("excluded_events"),
        F.array_max("event_time").alias("last_t"),
        leaked.alias("leaked"),
    )


@query(
    "A38_encoding_counters",
    with_tape(
        """select * from (select count(*) as events, sum(n_tokens)::bigint as tokens, (select count(*) from coded) as value_count, (select count(*) from coded where vid = 1) as unknown from encoded),
 (select count(*) as samples, count(*) filter (where excluded_events > 0) as truncated, sum(n_events)::bigint as kept_events, sum(tokens)::bigint as kept_tokens, sum(n_targets)::bigint as targets, count(*) filter (where n_targets > 0) as with_targets,
 count(*) filter (where n_events = 0) as silent, sum(profile_tokens)::bigint as profile_tokens, count(*) filter (where profile_tokens <= 1) as empty_profiles from sampled)""",
        *VOCAB, CODED, ENCODED, SAMPLED,
    ),
)
def a38(spark, sf):
    tape_rows = stored_tape(spark, sf)
    encoded = written(events_encoded(spark, sf, rows=tape_rows), "encoded")
    return ex.counters(encoded, sampled(spark, sf, encoded, tape_rows))


@query(
    "A44_truncation_impact",
    with_tape(
        f"""select count(*) as truncated, min(age) as least, quantile_cont(age, 0.1) as p10, quantile_cont(age, 0.5) as median, count(*) filter (where age < 90) as under_90, count(*) filter (where age < 365) as under_365
 from (select ({CUTOFF} - oldest) / {float(DAY)!r} as age from sampled where excluded_events > 0 and n_events > 0)""",
        *VOCAB, CODED, ENCODED, SAMPLED,
    ),
)
def a44(spark, sf):
    cut = sampled(spark, sf).filter("excluded_events > 0 and size(event_time) > 0").select(
        ((F.lit(CUTOFF) - F.get("event_time", F.lit(0))) / F.lit(float(DAY))).alias("age")
    )
    cut = written(cut, "ages")
    points = quantiles(cut, [], "age", {"p10": 0.1, "median": 0.5})
    facts = cut.agg(
        F.count(F.lit(1)).alias("truncated"),
        F.min("age").alias("least"),
        F.count_if(F.col("age") < 90).alias("under_90"),
        F.count_if(F.col("age") < 365).alias("under_365"),
    )
    return facts.select("*", *[points.select(c).scalar().alias(c) for c in ("p10", "median")])


@query(
    "P7_target_eligibility",
    with_tape(
        f"select id, {TARGET_SQL} and (t <> coalesce((select app_registered from snap s where s.client = e.client), 0)) as eligible from tape e", SNAPSHOT,
    ),
)
def p7(spark, sf):
    marks = snapshot(spark, sf).select("client", F.col("app_registered").alias("t"), F.lit("app_registered").alias("milestone"))
    rows = tape(spark, sf).join(marks.filter("t is not null"), ["client", "t"], "left")
    return rows.select("id", can_be_target(TARGET_FROM, CUTOFF).alias("eligible"))


# --- subword pieces -------------------------------------------------------------------


def corpus_texts(spark, sf, tape_rows=None):
    from chronotape.functions.text import normalized

    rows = train(spark, sf, tape_rows).filter("kind = 'text'")
    return cx.text_corpus(normalized(rows, "value")).filter("normalized is not null")


# Pieces of the model, letters and bytes included; learning ends before when no pair occurs twice.
PIECES = 4096


@query("V6_subword_merges")
def v6(spark, sf):
    words = written(sx.word_counts(corpus_texts(spark, sf)), "words")
    learned = sx.learn_merges(words, sx.merges_for(words, PIECES))
    rows = [(i, a, b, n) for i, (a, b, n) in enumerate(learned)]
    return spark.createDataFrame(rows, "rank int, left string, right string, n bigint")


@query("V7_text_pieces")
def v7(spark, sf):
    texts = written(corpus_texts(spark, sf), "texts")
    words = written(sx.word_counts(texts), "words")
    model = sx.freeze(words, sx.learn_merges(words, sx.merges_for(words, PIECES)))
    encoded = sx.encoded_texts(texts, model)
    return encoded.select(
        "normalized", F.array_join("pieces", "|").alias("pieces"), (sx.decoded(F.col("pieces")) == F.col("normalized")).alias("round_trip")
    )


@query("V9_events_with_texts")
def v9_texts(spark, sf):
    from chronotape.functions.text import normalized

    tape_rows = stored_tape(spark, sf)
    texts = written(corpus_texts(spark, sf, tape_rows), "texts")
    words = written(sx.word_counts(texts), "words")
    model = sx.freeze(words, sx.learn_merges(words, sx.merges_for(words, PIECES)))
    vocab = vocabulary(spark, sf, tape_rows)
    first = vocab.scales.agg(F.max(F.col("first_id") + F.col("n_buckets")).alias("n")).first()["n"]
    rows = normalized(conditioned(spark, sf, tape_rows), "value")
    encoded = sx.encoded_texts(rows.filter("kind = 'text'"), model, first=first)
    coded = ex.coded_values(rows, vocab, encoded)
    return ex.encoded_events(tape_rows.select("id", "client", "t", "type"), coded).select(
        "id", _text("key_ids").alias("key_ids"), _text("value_ids").alias("value_ids"), _text("positions").alias("positions")
    )


# --- masks ----------------------------------------------------------------------------

U = "cast('0x' || substr(sha256(concat_ws(chr(31), {parts})), 1, 13) as bigint) / 4503599627370496.0"


def _u(stream, *parts):
    return "(" + U.format(parts=", ".join(["'42'", f"'{stream}'", *[f"cast({p} as varchar)" for p in parts]])) + ")"


MASK_WEIGHTS = """mcounts as (select key_id, vid, count(*) as n from coded where t < CUT group by 1, 2),
mkeys as (select key_id, sum(n)::bigint as total, count(*) as d, -sum(p * ln(p)) as h from (select *, n / sum(n) over (partition by key_id) as p from mcounts) group by key_id),
mweights as (select c.key_id, c.vid, c.n, case when d < 2 then 0.0 else h / ln(d) end as kw, least(3.0, greatest(0.25, (-ln(n / total) + 1) / (h + 1))) as vw from mcounts c join mkeys k using (key_id)),
mscale as (select round(sum(n) / sum(n * kw * vw), 9) as scale from mweights)""".replace("CUT", str(CUTOFF))
# Chances are rounded before they are compared with a draw, so both engines decide alike.
MASKED = f"""mrows as (select c.id, c.client, c.t, c.key_id, c.vid, {TARGET_SQL} as target, round(case when kk.kw is null then 0.15 else
 least(0.35, greatest(0.05, 0.15 * (select scale from mscale) * kk.kw * coalesce(w.vw, 3.0))) end, 9) as chance from (select c.*, e.type from coded c join tape e on e.id = c.id) c
 left join (select distinct key_id, kw from mweights) kk on kk.key_id = c.key_id left join mweights w on w.key_id = c.key_id and w.vid = c.vid),
mdrawn as (select distinct client, key_id from mrows where target and {_u('key', 'client', 'key_id')} < 0.10),
mreason as (select r.*, d.key_id is not null as drawn, case when not target then 0 when {_u('event', 'r.client', 'r.id')} < 0.10 then 1 when d.key_id is not null then 2
 when {_u('value', 'r.client', 'r.id', 'r.key_id', '0')} < chance then 3 else 0 end as first_reason from mrows r left join mdrawn d on d.client = r.client and d.key_id = r.key_id),
mkept as (select *, case when key_id = {TYPE_KEY} and first_reason <> 1 then 0 else first_reason end as reason0,
 not target and drawn and key_id <> {TYPE_KEY} and {_u('context', 'client', 'id', 'key_id', '0')} < 0.5 as spoiled from mreason),
munk as (select *, reason0 > 0 and {_u('unknown', 'client', 'id', 'key_id', '0')} < 0.10 as unknown,
 case when key_id in (select id from vkeys where key in ('status','payment_reason')) then 1 when key_id in (select id from vkeys where key in ('mcc','merchant_country','is_online')) then 2 end as grp from mkept),
masked as (select * replace (case when reason0 = 0 and target and grp is not null and strongest is not null then strongest else reason0 end as reason0) from
 (select *, min(case when reason0 in (2, 3) and not unknown then reason0 end) over (partition by client, id, grp) as strongest from munk))"""
MASKS = (*VOCAB, CODED, MASK_WEIGHTS, MASKED)


def masked(spark, sf, vocab=None):
    tape_rows = stored_tape(spark, sf)
    vocab = vocab or vocabulary(spark, sf, tape_rows)
    coded = written(ex.coded_values(conditioned(spark, sf, tape_rows), vocab).select("id", "client", "t", "type", "key_id", "ids"), "coded")
    target = (F.col("t") >= TARGET_FROM) & (F.col("t") < CUTOFF) & ~kind("profile_change")
    rows = coded.withColumns({"target": target, "place": F.lit(0)})
    counts = coded.filter(F.col("t") < CUTOFF).groupBy(F.col("key_id").alias("key"), "ids").agg(
        F.count(F.lit(1)).alias("occurrences")
    )
    weights = written(cx.value_weights(counts).withColumnRenamed("key", "key_id"), "weights")
    scale = weights.select(F.col("key_id").alias("key"), "occurrences", "key_weight", "value_weight")
    factor = round(cx.weight_scale(scale).first()["scale"], 9)
    ids = {r["key"]: r["id"] for r in vocab.keys.collect()}
    config = mx.Masking(
        groups=(
            (ids["status"], ids["payment_reason"]),
            (ids["mcc"], ids["merchant_country"], ids["is_online"]),
        ),
        event_only_key=ids["event_type"],
    )
    chanced = mx.probability(rows, weights, factor, config).withColumn("chance", F.round("chance", 9))
    return mx.choose(chanced, config)


@query("M3_weighted_chance", with_tape("select id, key_id, chance from mrows", *MASKS))
def m3(spark, sf):
    return masked(spark, sf).select("id", "key_id", "chance")


@query("M1_mask_choice", with_tape("select id, key_id, reason0::int as reason, unknown, spoiled from masked", *MASKS))
def m1(spark, sf):
    return masked(spark, sf).select("id", "key_id", "reason", "unknown", "spoiled")


@query(
    "M2_group_closure",
    with_tape("select id, key_id, reason0::int as reason, first_reason::int as drawn from masked where reason0 <> first_reason and key_id <> " + TYPE_KEY, *MASKS),
)
def m2(spark, sf):
    config = mx.Masking()
    rows = masked(spark, sf)
    by_event = mx.draw(config, "event", "client", "id") < config.event_probability
    by_value = mx.draw(config, "value", "client", "id", "key_id", "place") < F.col("chance")
    by_key = mx.draw(config, "key", "client", "key_id") < config.key_probability
    drawn = F.when(~F.col("target"), 0).when(by_event, 1).when(by_key, 2).when(by_value, 3).otherwise(0)
    type_key = vx.key_ids(spark.createDataFrame([(k,) for _, _, k, _ in REGISTRY], "key string")).filter("key = 'event_type'")
    closed = rows.withColumn("drawn", drawn).filter(F.col("reason") != F.col("drawn"))
    return closed.join(type_key.select(F.col("id").alias("key_id")), "key_id", "left_anti").select(
        "id", "key_id", "reason", "drawn"
    )


APPLIED = """applied as (select id, client, '3,' || string_agg(cast(case when reason0 > 0 and not unknown then 2 when unknown or spoiled then 1 else vid end as varchar), ',' order by key_id) as input_ids,
 '-100,' || string_agg(cast(case when reason0 > 0 and not unknown then vid else -100 end as varchar), ',' order by key_id) as labels,
 '0,' || string_agg(cast(case when reason0 > 0 and not unknown then reason0 else 0 end as varchar), ',' order by key_id) as reasons from masked group by id, client)"""


@query("M4_apply_mask", with_tape("select * from applied", *MASKS, APPLIED))
def m4(spark, sf, vocab=None):
    rows = mx.masked_events(masked(spark, sf, vocab), vx.EVT)
    return rows.select("id", "client", *[_text(c).alias(c) for c in ("input_ids", "labels", "reasons")])


MREPORT = """mhit as (select *, reason0 > 0 and not unknown as hit from masked where target),
mdata as (select key_id, vid, count(*) as n, count(*) filter (where hit) as h from mhit group by 1, 2),
mtop as (select *, sum(n) over (partition by key_id) as kn, sum(h) over (partition by key_id) as kh, row_number() over (partition by key_id order by n desc, cast(vid as varchar)) as rn from mdata)"""


@query(
    "M5_mask_report",
    with_tape(
        """select k.key_id, n_values, n_values / (select count(*) from mhit) as data_share, targets, targets / (select count(*) from mhit where hit) as target_share, by_event, by_key, by_value, k.unknown,
 cast(t.vid as varchar) as top_value, t.n / t.kn as top_data_share, case when t.kh > 0 then t.h / t.kh end as top_target_share, round(mean_chance, 9) as mean_chance, round(v.tv, 9) as value_tv from
 (select key_id, count(*) as n_values, count(*) filter (where hit) as targets, count(*) filter (where hit and reason0 = 1) as by_event, count(*) filter (where hit and reason0 = 2) as by_key,
 count(*) filter (where hit and reason0 = 3) as by_value, count(*) filter (where unknown) as unknown, avg(chance) as mean_chance from mhit group by key_id) k
 join mtop t on t.key_id = k.key_id and t.rn = 1 left join (select key_id, 0.5 * sum(abs(h / kh - n / kn)) as tv from mtop where kh > 0 group by key_id) v on v.key_id = k.key_id""",
        *MASKS, MREPORT,
    ),
)
def m5(spark, sf):
    report = mx.report(written(masked(spark, sf), "masked"))
    return report.withColumns({"mean_chance": F.round("mean_chance", 9), "value_tv": F.round("value_tv", 9)})


@query(
    "M5_visible_partners",
    with_tape(
        """select count(*) as targets, count(*) filter (where seen) as with_visible_partner, count(*) filter (where seen) / count(*) as share from
 (select m.*, exists (select 1 from mhit o where o.id = m.id and o.reason0 = 0 and ((m.key_id = (select id from vkeys where key='status') and o.key_id = (select id from vkeys where key='event_type'))
 or (m.key_id = (select id from vkeys where key='mcc') and o.key_id = (select id from vkeys where key='is_online')))) as seen from mhit m where hit)""",
        *MASKS, MREPORT,
    ),
)
def m5_partners(spark, sf):
    keys = vx.key_ids(spark.createDataFrame([(k,) for _, _, k, _ in REGISTRY], "key string"))
    wanted = spark.createDataFrame([("status", "event_type"), ("mcc", "is_online")], "key string, partner string")
    a = keys.select("key", F.col("id").alias("key_id"))
    b = keys.select(F.col("key").alias("partner"), F.col("id").alias("partner_id"))
    pairs = wanted.join(a, "key").join(b, "partner").select("key_id", "partner_id")
    return mx.visible_partners(written(masked(spark, sf), "masked"), pairs)


# --- batches, order, ablations, drift ---------------------------------------------------

BUDGET = 500
SAMPLE_COST = "(case when key_ids = '' then 0 else len(key_ids) - len(replace(key_ids, ',', '')) + 1 end + profile_tokens + 1)::bigint"
COSTS = f"costs as (select client, row_number() over (order by client) - 1 as place, {SAMPLE_COST} as cost from sampled)"
PACK = f"""pack as (select place, cost, 0::bigint as batch, cost as spent from costs where place = 0
 union all select c.place, c.cost, case when p.spent + c.cost > {BUDGET} then p.batch + 1 else p.batch end, case when p.spent + c.cost > {BUDGET} then c.cost else p.spent + c.cost end
 from pack p join costs c on c.place = p.place + 1)"""
PACKED = (*VOCAB, CODED, ENCODED, SAMPLED, COSTS.replace("costs as (", "costs as materialized (", 1), PACK)


def packed(spark, sf):
    """The samples of V11 in the order of their clients, by event and profile tokens and one more."""
    from chronotape.plans.split import number_rows, plan_split

    cost = (F.size("key_ids") + F.col("profile_tokens") + 1).cast("bigint")
    rows = written(sampled(spark, sf).select("client", cost.alias("cost"), F.lit(0).alias("same")), "costs")
    costs = number_rows(rows, plan_split(rows, [], "same"), ["client"], "place")
    return bx.packed(costs, BUDGET)


@query("M6_token_batches", with_tape("select place, cost, batch from pack", *PACKED).replace("with ", "with recursive ", 1))
def m6(spark, sf):
    return packed(spark, sf)


@query(
    "M6_batching_summary",
    with_tape(
        f"""select count(*) as batches, sum(n)::bigint as samples, count(*) filter (where c > {BUDGET}) as oversize, max(n) as largest, sum(c) / (count(*) * {BUDGET}) as fill
 from (select batch, count(*) as n, sum(cost) as c from pack group by 1)""",
        *PACKED,
    ).replace("with ", "with recursive ", 1),
)
def m6_summary(spark, sf):
    return bx.packing_summary(packed(spark, sf), BUDGET)


def _hash(*parts):
    return "cast('0x' || substr(sha256(concat_ws(chr(31), " + ", ".join(parts) + ")), 1, 13) as bigint)"


@query(
    "M7_seeded_order",
    f"""select doc_id, source, row_number() over (partition by source order by {_hash("'7'", "'row'", "source", "cast(doc_id as varchar)")}, doc_id) - 1 as row_place, b.block_place from documents
 join (select source, row_number() over (order by {_hash("'7'", "'block'", "source")}, source) - 1 as block_place from (select distinct source from documents)) b using (source)""",
)
def m7(spark, sf):
    return bx.shuffled(read(spark, sf, "documents").select("doc_id", "source"), "7", "source", "doc_id")


@query(
    "M8_last_quarter",
    with_tape(
        "select id, client from (select *, row_number() over (partition by client order by t desc, id desc) as back, count(*) over (partition by client) as n from tape) where back <= ceil(n * 25 / 100.0)"
    ),
)
def m8_last(spark, sf):
    return bx.last_share(tape(spark, sf).select("id", "client", "t"), 25)[["id", "client"]]


@query(
    "M8_content_over_times",
    with_tape(
        f"""select a.client, a.place, a.t, b.id as content_id from (select client, t, row_number() over (partition by client order by t, id) - 1 as place from tape) a
 join (select client, id, row_number() over (partition by client order by {_hash("'9'", "client", "cast(id as varchar)")}, id) - 1 as place from tape) b using (client, place)"""
    ),
)
def m8_content(spark, sf):
    return bx.content_over_times(tape(spark, sf).select("id", "client", "t"), "9")


OTHER = "other as (select vec_id, list_transform(embedding, lambda x: (x::double * 0.75::double + 0.125::double)::float) as embedding from embeddings)"
DRIFT = f"""with {OTHER}, drift as (select vec_id, list_dot_product(e.embedding::double[], o.embedding::double[]) / (sqrt(list_dot_product(e.embedding::double[], e.embedding::double[])) * sqrt(list_dot_product(o.embedding::double[], o.embedding::double[]))) as cosine,
 list_distance(e.embedding::double[], o.embedding::double[]) as l2 from embeddings e join other o using (vec_id))"""


def drift(spark, sf):
    rows = read(spark, sf, "embeddings").select("vec_id", "embedding")
    other = rows.select("vec_id", F.transform("embedding", lambda x: (x * F.lit(0.75) + F.lit(0.125)).cast("float")).alias("embedding"))
    return bx.drift(rows, other, "vec_id", "embedding")


@query("M9_vector_drift", f"{DRIFT} select vec_id, round(cosine, 9) as cosine, round(l2, 9) as l2 from drift")
def m9(spark, sf):
    return drift(spark, sf).select("vec_id", F.round("cosine", 9).alias("cosine"), F.round("l2", 9).alias("l2"))


@query(
    "M9_drift_summary",
    f"{DRIFT} select 'cosine' as measure, round(avg(cosine), 9) as mean, round(quantile_cont(cosine, 0.1), 9) as p10, round(quantile_cont(cosine, 0.5), 9) as p50, round(quantile_cont(cosine, 0.9), 9) as p90 from drift",
)
def m9_summary(spark, sf):
    found = bx.drift_summary(written(drift(spark, sf), "drift"), "cosine")
    return found.select("measure", *[F.round(c, 9).alias(c) for c in ("mean", "p10", "p50", "p90")])


