"""The stage walk against a plain day-by-day reading of the rules on random clients."""

import datetime
import random

from pyspark.sql import functions as F

from chronotape.functions.clock import DAY, LOCAL_OFFSET
from chronotape.operators import lifecycle as lx

FAMILY = {"D": "debit_card", "C": "credit_card", "T": "debit_card", "S": "service"}
PREMIUM = {"T"}
START = 19_723 * DAY - LOCAL_OFFSET  # local midnight of 2024-01-01
RULES = lx.Rules(high_visits=4, low_visits=1, high_run=2)


def day_of(t):
    return (t + LOCAL_OFFSET) // DAY


def as_date(day):
    return datetime.date(1970, 1, 1) + datetime.timedelta(days=day)


def month_of(day):
    d = as_date(day)
    return d.year * 12 + d.month - 1


def expected(events, reg, until):
    """Stages from the events alone: every fact is counted again on every day."""
    rows = [(reg, "new", None, "registered")]
    stage, reason, anchor, grew, risk = "new", "registered", None, False, reg
    for day in range(day_of(reg), day_of(until)):
        end = (day + 1) * DAY - LOCAL_OFFSET
        seen = [e for e in events if e["t"] < end]
        after = [e for e in seen if e["t"] >= reg]
        own = {}
        closed_today = False
        for e in seen:
            if e["type"] == "product_opened" and FAMILY.get(e["product"]) not in (None, "service"):
                own[e["contract"]] = e["product"]
            if e["type"] == "product_closed":
                gone = own.pop(e["contract"], None)
                closed_today |= gone in PREMIUM and e["t"] >= reg and day_of(e["t"]) == day
        actions = [e["t"] for e in after if e["type"] in ("app_screen", "app_operation")]
        visits = [e["t"] for e in after if e["type"] == "app_operation"]
        first = min(actions, default=None)
        last_action, last_visit = max([reg, *actions]), max(visits, default=-1)
        if first is not None and anchor is None:
            anchor = month_of(day_of(first))
        visit_months = {month_of(day_of(v)) for v in visits}
        sundays = [d for d in range(day_of(reg), day + 1) if as_date(d).weekday() == 6]
        weekly = [sum(d - 6 <= day_of(v) <= d for v in visits) for d in sundays]
        high = [i + 1 >= RULES.high_weeks and sum(weekly[i + 1 - RULES.high_weeks : i + 1]) >= RULES.high_visits for i in range(len(weekly))]
        low = [i + 1 >= RULES.low_weeks and sum(weekly[i + 1 - RULES.low_weeks : i + 1]) <= RULES.low_visits for i in range(len(weekly))]

        def run(flags, at):
            n = 0
            while at - n >= 0 and flags[at - n]:
                n += 1
            return n

        now = len(weekly) - 1
        high_run = run(high, now) if now >= 0 else 0
        run_start = now - high_run + 1
        reached = [i - RULES.high_run + 1 for i in range(len(weekly)) if run(high, i) == RULES.high_run]
        sunday = bool(sundays) and sundays[-1] == day
        low_run = run(low, now) if now >= 0 else 0
        declined = sunday and low_run == RULES.low_run and bool(reached) and now - low_run + 1 > reached[-1]
        calm = sunday and not low[now]
        premium = any(p in PREMIUM for p in own.values())
        core = high_run >= RULES.high_run and len(own) >= 2 and any(FAMILY[p] == "debit_card" for p in own.values())
        month_over = month_of(day + 1) != month_of(day) and month_of(day) not in visit_months

        def again(since):
            nonlocal anchor
            if first is None:
                return "new"
            if not (grew and last_visit >= since):
                anchor = max(anchor, month_of(day_of(since)))
                return "activated"
            monday = day_of(reg) - as_date(day_of(reg)).weekday()
            week = (day_of(since) - as_date(day_of(since)).weekday() - monday) // 7
            if core and run_start >= week:
                return "loyal" if premium else "core"
            return "growing"

        new, why = stage, reason
        if end - last_action >= 60 * DAY:
            if stage != "churn":
                new, why = "churn", "no_action_60d"
        elif stage == "churn":
            new, why = again(last_action), "reactivated"
        elif stage == "at_risk":
            cured = {
                "new_no_target_action_7d": first is not None,
                "activated_no_action_14d": last_action >= risk,
                "growing_not_in_mau": last_visit >= risk,
                "core_wau_decline": calm,
                "loyal_premium_closed": premium,
            }[reason]
            if cured:
                new, why = again(risk), "recovered"
        elif stage == "new" and first is None and end >= reg + 7 * DAY:
            new, why = "at_risk", "new_no_target_action_7d"
        elif stage == "activated" and last_action == first and first < reg + 14 * DAY <= end:
            new, why = "at_risk", "activated_no_action_14d"
        elif stage == "loyal" and closed_today and not premium:
            new, why = "at_risk", "loyal_premium_closed"
        elif stage in ("core", "loyal") and declined:
            new, why = "at_risk", "core_wau_decline"
        elif stage == "growing" and month_over:
            new, why = "at_risk", "growing_not_in_mau"
        else:
            if new == "new" and first is not None:
                new = "activated"
            if new == "activated" and anchor + 1 in visit_months:
                new = "growing"
            if new == "growing" and core:
                new = "core"
            if new == "core" and premium:
                new = "loyal"
            why = "promoted" if new != stage else reason
        grew |= new == "growing"
        if new == "at_risk" and stage != "at_risk":
            risk = end
        if new != stage:
            rows.append((end, new, stage, why))
            stage, reason = new, why
    return rows


def random_client(draw, busy):
    events, contracts = [], [f"k{i}" for i in range(3)]
    t = START - 5 * DAY
    while t < START + 260 * DAY:
        t += int(draw.expovariate(busy) * DAY) + 1
        if draw.random() < 0.04:
            t += 70 * DAY
        kind = draw.choices(["app_operation", "app_screen", "product_opened", "product_closed"], [6, 2, 1.5, 0.4])[0]
        events.append({"t": t, "type": kind, "contract": draw.choice(contracts), "product": draw.choice("DCTSX")})
    return events


def test_walk_equals_the_plain_reading(spark, tape):
    draw = random.Random(17)
    until = START + 250 * DAY + 7 * 3_600_000_000
    clients, rows, registered = {}, [], []
    for number in range(14):
        name = f"c{number}"
        events = random_client(draw, draw.choice([0.15, 0.5, 1.2, 2.0]))
        reg = START + draw.randrange(0, 40 * DAY)
        clients[name] = (events, reg)
        registered.append((name, reg))
        for e in events:
            rows.append({
                "client": name, "t": e["t"], "exact": True, "type": e["type"],
                "operation": "login", "status": "success",
                "contract_id": e["contract"] if e["type"].startswith("product") else None,
                "product_id": e["product"] if e["type"].startswith("product") else None,
            })
    registered.append(("quiet", START))
    registered.append(("late", until - 1))
    families = spark.createDataFrame([(p, f, p in PREMIUM) for p, f in FAMILY.items()], "product_id string, family string, premium boolean")
    known = spark.createDataFrame(registered, "client string, registered bigint")
    found = lx.transitions(tape(*rows), known, families, until, RULES).collect()
    got = {}
    for r in sorted(found, key=lambda r: (r["client"], r["started_at"])):
        got.setdefault(r["client"], []).append((r["started_at"], r["stage"], r["previous_stage"], r["reason"]))
    want = {name: expected(events, reg, until) for name, (events, reg) in clients.items()}
    want["quiet"] = expected([], START, until)
    want["late"] = [(until - 1, "new", None, "registered")]
    stages = {s for rows_ in want.values() for _, s, _, _ in rows_}
    assert {"new", "activated", "growing", "core", "loyal", "at_risk", "churn"} <= stages
    assert got == want


def test_cutting_the_tape_changes_no_earlier_stage(spark, tape):
    draw = random.Random(4)
    events = random_client(draw, 1.0)
    rows = [{"t": e["t"], "exact": True, "type": e["type"], "operation": "login", "status": "success"} for e in events]
    families = spark.createDataFrame([("D", "debit_card", False)], "product_id string, family string, premium boolean")
    known = spark.createDataFrame([("a", START)], "client string, registered bigint")
    until, cut = START + 250 * DAY, START + 120 * DAY
    whole = lx.transitions(tape(*rows), known, families, until, RULES).filter(F.col("started_at") <= cut)
    part = lx.transitions(tape(*[r for r in rows if r["t"] < cut]), known, families, cut, RULES)
    assert sorted(map(str, whole.collect())) == sorted(map(str, part.collect()))
