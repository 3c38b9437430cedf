"""Ordered work on heavy keys, laid out in slices, equals the plain window."""

import random

from pyspark.sql import functions as F

from chronotape.plans import split as sp


def rows(spark, seed=3, n=400):
    draw = random.Random(seed)
    data = [("hot" if draw.random() < 0.5 else f"c{draw.randrange(12)}", draw.randrange(60), i, draw.randrange(-5, 9)) for i in range(n)]
    return data, spark.createDataFrame(data, "client string, t bigint, id bigint, x bigint")


def brute(data, window):
    return {
        i: (sum(x2 for c2, t2, _, x2 in data if c2 == c and t - window <= t2 < t), sum(c2 == c and t - window <= t2 < t for c2, t2, _, _ in data))
        for c, t, i, _ in data
    }


def test_rolling_sums_of_a_heavy_key(splitting):
    data, df = rows(splitting)
    split = sp.plan_split(df, ["client"], "t")
    assert split.rows > 0 and split.heavy.count() > 0
    got = sp.rolling_sums(df, split, {"w": 7}, {"x": F.col("x"), "n": F.lit(1)}).collect()
    want = brute(data, 7)
    assert len(got) == len(data)
    assert {r["id"]: (r["x_w"], r["n_w"]) for r in got} == want


def test_plain_and_heavy_agree_on_every_measure(spark):
    data, df = rows(spark, 5)
    measures = [
        sp.Measure("total", "sum", F.col("x")),
        sp.Measure("top", "max", F.struct("t", "id", "x")),
        sp.Measure("low", "min", F.col("x")),
    ]
    found = {}
    for limit in ("1000000", "20"):
        spark.conf.set(sp.TARGET_CONF, limit)
        split = sp.plan_split(df, ["client"], "t")
        assert (split.rows > 0) == (limit == "20")
        for through in (False, True):
            for then_by in (None, ["id"]):
                out = sp.running(df, split, measures, through=through, then_by=then_by).collect()
                found.setdefault((through, then_by is None), []).append(sorted(map(tuple, out)))
    spark.conf.unset(sp.TARGET_CONF)
    for plain, heavy in found.values():
        assert plain == heavy


def layouts(monkeypatch):
    """The stored layouts that operators make, as they make them."""
    made = []

    def keep(df, name="step"):
        out = real(df, name)
        if name == "layout":
            made.append(out)
        return out

    real = sp.written
    monkeypatch.setattr(sp, "written", keep)
    return made


def test_one_instant_is_cut_by_the_tie(splitting, monkeypatch):
    made = layouts(monkeypatch)
    df = splitting.createDataFrame([("a", 5, i, 1) for i in range(800)], "client string, t bigint, id bigint, x bigint")
    split = sp.plan_split(df, ["client"], "t")
    out = sp.running(df, split, [sp.Measure("n", "sum", F.col("x"))], then_by=["id"])
    assert {(r["id"], r["n"]) for r in out.collect()} == {(i, i) for i in range(800)}
    assert made[0].groupBy("_slice").count().agg(F.max("count")).first()[0] < 100
    out = sp.running(df, split, [sp.Measure("n", "sum", F.col("x"))])
    assert {r["n"] for r in out.collect()} == {0}
    assert made[1].count() == 1


def test_slices_grow_with_the_rows(spark, monkeypatch):
    made = layouts(monkeypatch)
    df = spark.range(60_000).selectExpr("'a' as client", "id * id as t", "id")
    for target in (30_000, 1000, 20):
        spark.conf.set(sp.TARGET_CONF, str(target))
        sp.number_rows(df, sp.plan_split(df, ["client"], "t"), ["id"])
        sizes = [r["count"] for r in made[-1].groupBy("_slice").count().collect()]
        assert len(sizes) > 0.8 * 60_000 / target and max(sizes) <= 3 * target
    spark.conf.unset(sp.TARGET_CONF)


def test_light_keys_stay_in_a_plain_window(spark, monkeypatch):
    made = layouts(monkeypatch)
    _, df = rows(spark)
    split = sp.plan_split(df, ["client"], "t")
    assert split.rows == 0 and split.heavy is None
    sp.running(df, split, [sp.Measure("n", "sum", F.col("x"))]).collect()
    assert not made
    # A table that is counted is not counted again for what comes from it.
    assert sp.plan_split(df, ["client", "id"], "t", like=split) == sp.Split(("client", "id"), "t")
    assert sp.plan_split(df, ["client"], "id", like=split) == sp.Split(("client",), "id")


def test_null_keys_and_global_order(splitting):
    data = [(None if i % 3 else "a", i % 7, i) for i in range(200)]
    df = splitting.createDataFrame(data, "client string, t bigint, id bigint")
    for keys in (["client"], []):
        got = sp.number_rows(df, sp.plan_split(df, keys, "t"), ["id"]).collect()
        for key in {r["client"] for r in got} if keys else {0}:
            mine = sorted((r["t"], r["id"], r["ordinal"]) for r in got if not keys or r["client"] == key)
            assert [n for _, _, n in mine] == list(range(len(mine)))


def test_a_client_inside_one_window_is_not_quadratic(spark):
    df = spark.range(200_000).selectExpr("'a' as client", "id as t", "1L as x")
    out = sp.rolling_sums(df, sp.plan_split(df, ["client"], "t"), {"w": 10**9}, {"x": F.col("x")})
    assert out.agg(F.sum("x_w")).first()[0] == 200_000 * 199_999 // 2


def test_quantiles_match_numpy(splitting):
    import numpy as np

    data, df = rows(splitting, 9)
    p = {"a": 0.1, "b": 0.5, "c": 0.93}
    for interpolate, method in ((True, "linear"), (False, "inverted_cdf")):
        got = sp.quantiles(df, ["client"], "x", p, interpolate=interpolate).collect()
        for r in got:
            xs = [x for c, _, _, x in data if c == r["client"]]
            for name, q in p.items():
                assert abs(r[name] - np.quantile(xs, q, method=method)) < 1e-9


def test_lead_is_the_next_row(splitting):
    data, df = rows(splitting, 11)
    out = sp.following(df, "t", ["client"], {"next_id": "id"}, ["id"]).collect()
    for r in out:
        later = sorted((t, i) for c, t, i, _ in data if c == r["client"] and (t, i) > (r["t"], r["id"]))
        assert r["next_id"] == (later[0][1] if later else None)
