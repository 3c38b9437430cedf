"""Streams over the events (R1-R7) and their SQL: each runs to the end of the files, into a table."""

from pyspark.sql import functions as F

from chronotape.operators.features import with_actions
from chronotape.plans.shared import new_path
from chronotape.plans.split import number_rows, plan_split
from chronotape.streaming import activity as ax
from chronotape.streaming import telemetry as tx
from queries.features import ACTS
from queries.registry import query
from queries.tables import DAY, HOUR, RAW, raw, tape, with_tape

SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def stream(spark, sf):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return ax.event_stream(spark, sf, "events.parquet", SCHEMA)


# Telemetry lines: one run file per user; steps repeat and runs resume by rule.
LINE = """case when k = 3 then '{"kind":"step","st' when k = 4 then '[]' else '{"kind":"' || kind || '","step":' || cast(step as string) || ',"epoch":' || cast(epoch as string)
 || case when kind = 'run' then ',"epochs":' || cast(3 + k % 3 as string) || ',"planned_epochs":4,"total_steps":' || cast(100 + k as string) || ',"resumed":' || case when k % 2 = 0 then 'true' else 'false' end else '' end
 || case when kind = 'epoch' and k % 3 <> 0 then ',"val_loss":' || cast(k as string) else '' end || ',"place":' || cast(place as string) || ',"run":"' || client || '"}' end"""
KIND = "case when k % 20 = 0 then 'run' when k % 5 = 2 then 'epoch' else 'step' end"
NUMBERED = f"""numbered as (select *, {KIND} as kind, (place * 7) % 40 as step, (place * 3) % 9 as epoch from (select *, row_number() over (partition by client order by t, id) - 1 as place from tape)),
tlines as (select client, place, k, {LINE} as value from numbered),
recs as (select value->>'$.run' as run, value->>'$.kind' as kind, (value->>'$.step')::bigint as step, (value->>'$.epoch')::bigint as epoch, (value->>'$.place')::bigint as place,
 (value->>'$.epochs')::bigint as epochs, (value->>'$.planned_epochs')::bigint as planned_epochs, (value->>'$.total_steps')::bigint as total_steps, (value->>'$.resumed')::boolean as resumed,
 (value->>'$.val_loss')::double as val_loss from tlines where k not in (3, 4))"""


def telemetry_lines(spark, sf):
    rows = tape(spark, sf)
    numbered = number_rows(rows, plan_split(rows, ["client"], "t"), ["id"], "place").selectExpr(
        "*", f"{KIND} as kind", "(place * 7) % 40 as step", "(place * 3) % 9 as epoch"
    )
    return numbered.selectExpr(f"{LINE} as value")


FIELDS = tx.RECORD + ", place bigint, run string"


def telemetry(spark, sf):
    from chronotape.sources.raw import read_jsonl

    return read_jsonl(telemetry_lines(spark, sf), FIELDS).filter("malformed is null").drop("malformed")


def line_folder(spark, sf):
    folder = new_path(spark, "lines")
    telemetry_lines(spark, sf).write.text(folder)
    return folder


@query(
    "R1_jsonl_stream",
    with_tape(
        "select count(*) filter (where k not in (3, 4)) as records, count(*) filter (where k in (3, 4)) as malformed, (sum(case when k not in (3, 4) then step end))::bigint as steps from numbered",
        NUMBERED,
    ),
)
def r1(spark, sf):
    rows = tx.drain(tx.records(tx.tail_lines(spark, line_folder(spark, sf))), "telemetry")
    return rows.agg(
        F.count_if(F.col("malformed").isNull()).alias("records"),
        F.count_if(F.col("malformed").isNotNull()).alias("malformed"),
        F.sum("step").alias("steps"),
    )


CUT = """cutrecs as (select *, min(case when kind='run' then step end) over w as cut_step, min(case when kind='run' then epoch end) over w as cut_epoch from recs
 window w as (partition by run order by place rows between 1 following and unbounded following)),
keptrecs as (select *, case when kind='step' then step else epoch end as number from cutrecs where (kind='step' and (cut_step is null or step <= cut_step)) or (kind='epoch' and (cut_epoch is null or epoch < cut_epoch))),
effective as (select * from keptrecs qualify row_number() over (partition by run, kind, number order by place desc) = 1)"""


@query("R2_resume_rewind", with_tape("select run, kind, step, epoch, place from effective", NUMBERED, CUT))
def r2(spark, sf):
    return tx.effective(telemetry(spark, sf), "run", "place").select("run", "kind", "step", "epoch", "place")


@query("R2_rewind_stream", with_tape("select run, kind, number, place from effective", NUMBERED, CUT))
def r2_stream(spark, sf):
    from chronotape.sources.raw import read_jsonl

    rows = read_jsonl(tx.tail_lines(spark, line_folder(spark, sf)), FIELDS).filter("malformed is null")
    changes = tx.drain(tx.rewinds(rows.select("run", "kind", "step", "epoch", "place")), "rewinds")
    return tx.standing(changes)


@query(
    "R3_progress",
    with_tape(
        """select coalesce(r.run, e.run) as run, greatest(r.step, e.last_step, e.epoch_step) as step, coalesce(e.step_epoch, r.epoch) as epoch,
 case when r.epochs > r.planned_epochs then cast(round_even(r.total_steps * r.epochs / r.planned_epochs, 0) as bigint) else r.total_steps end as total_steps,
 coalesce(r.epochs > r.planned_epochs, false) as estimated, coalesce(e.completed_epochs, 0) as completed_epochs, e.val_loss, e.best_val_loss, coalesce(r.resumes, 0) as resumes
 from (select run, arg_max(step, place) as step, arg_max(epoch, place) as epoch, arg_max(epochs, place) as epochs, arg_max(planned_epochs, place) as planned_epochs, arg_max(total_steps, place) as total_steps,
 count(*) filter (where resumed) as resumes from recs where kind='run' group by run) r full outer join
 (select run, max(step) filter (where kind='step') as last_step, arg_max(epoch, step) filter (where kind='step') as step_epoch, arg_max(step, epoch) filter (where kind='epoch') as epoch_step,
 count(*) filter (where kind='epoch') as completed_epochs, arg_max(val_loss, epoch) filter (where kind='epoch' and val_loss is not null) as val_loss, min(val_loss) filter (where kind='epoch') as best_val_loss
 from effective group by run) e on e.run = r.run""",
        NUMBERED, CUT,
    ),
)
def r3(spark, sf):
    return tx.progress(telemetry(spark, sf), "run", "place")


@query(
    "R4_rolling_stream",
    with_tape(
        f"""select client, start, start + {7 * DAY} as stop, count(*) as n, coalesce(sum(amount), 0)::bigint as total from
 (select *, unnest([t // {DAY} * {DAY} - i * {DAY} for i in range(7)]) as start from tape) group by 1, 2"""
    ),
)
def r4(spark, sf):
    rows = tape(spark, sf, stream(spark, sf)).select("client", "t", "amount")
    return ax.all_activity(rows, "7 days", "1 day", "1 day")


@query(
    "R5_session_stream",
    with_tape(
        f"""select client, min(t) as start, max(t) + {2 * DAY} as stop, count(*) as n from (select *, sum(pause) over (partition by client order by t, id) as s from
 (select client, id, t, case when t - lag(t) over (partition by client order by t, id) >= {2 * DAY} then 1 else 0 end as pause from tape)) group by client, s"""
    ),
)
def r5(spark, sf):
    rows = tape(spark, sf, stream(spark, sf)).select("client", "t")
    return ax.all_sessions(rows, "2 days", "1 day")


QUIET = 20


@query(
    "R6_silence_stream",
    with_tape(
        f"""select client, t + {QUIET * DAY} as moment, 'churn' as change from nexts where n - t >= {QUIET * DAY} or (n is null and (t + {QUIET * DAY}) // 1000 < (select max(t) from acts where action) // 1000 - {HOUR // 1000})
 union all select client, n, 'reactivated' from nexts where n - t >= {QUIET * DAY}""",
        ACTS, "nexts as (select client, t, lead(t) over (partition by client order by t) as n from acts where action)",
    ),
)
def r6(spark, sf):
    rows = with_actions(tape(spark, sf, stream(spark, sf)))
    # The watermark follows the actions: the filter stands before it.
    return tx.drain(ax.silence(rows.filter("action"), QUIET, "1 hour"), "silence")


@query(
    "R7_checked_batches",
    with_tape(
        """select coalesce(problem, 'good') as problem, count(*) as n from (select case when client_id is null or regexp_full_match(client_id, '[\\s\\x{0B}\\x{85}\\p{Z}]*') then 'blank client'
 when not coalesce(regexp_full_match(event_time, '\\d{4}-\\d{2}-\\d{2}T\\d{2}:\\d{2}:\\d{2}(\\.\\d{1,6})?([+-]\\d{2}:\\d{2}|Z)') and try_cast(left(event_time, 10) as date) is not null, false) then 'unreadable time'
 when source = 'unknown_system' then 'unknown source' when payload is null or k in (92, 93, 94) then 'unreadable payload' end as problem from raw join (select id, k from tape) using (id)) group by 1""",
        RAW,
    ),
)
def r7(spark, sf):
    sources = ["app", "loans", "crm", "registry", "ledger"]
    good, bad = ax.checked(raw(spark, sf, stream(spark, sf)), sources)
    return bad.groupBy("problem").agg(F.count(F.lit(1)).alias("n")).unionByName(
        good.agg(F.count(F.lit(1)).alias("n")).select(F.lit("good").alias("problem"), "n")
    )


