"""Metrics against direct pair counting, with ties and single classes."""

import random

from chronotape.operators import evaluate as ev


def rows(spark, data):
    return spark.createDataFrame([(i, g, y, s) for i, (g, y, s) in enumerate(data)], "id bigint, grp string, y int, score double")


def sample():
    draw = random.Random(8)
    return [(draw.choice("ab"), int(draw.random() < 0.3), draw.randrange(12) / 12) for _ in range(300)] + [("one", 1, 0.5), ("one", 1, 0.2)]


def pair_auc(data):
    pos, neg = [s for _, y, s in data if y], [s for _, y, s in data if not y]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def step_precision(data):
    total, out, tp, n = sum(y for _, y, _ in data), 0.0, 0, 0
    for s in sorted({s for _, _, s in data}, reverse=True):
        here = [y for _, y, s2 in data if s2 == s]
        tp, n = tp + sum(here), n + len(here)
        out += sum(here) / total * tp / n
    return out


def test_auc_and_precision_per_group(splitting):
    data = sample()
    counts = ev.score_counts(rows(splitting, data), ["grp"])
    areas = {r["grp"]: r["auc"] for r in ev.auc(counts, ["grp"]).collect()}
    precisions = {r["grp"]: r["pr_auc"] for r in ev.average_precision(counts, ["grp"]).collect()}
    for g in "ab":
        part = [d for d in data if d[0] == g]
        assert abs(areas[g] - pair_auc(part)) < 1e-12
        assert abs(precisions[g] - step_precision(part)) < 1e-12
    assert areas["one"] is None and precisions["one"] == 1.0


def test_best_threshold_is_the_lowest_of_equals(spark):
    data = [("a", 1, 0.9), ("a", 0, 0.8), ("a", 0, 0.7), ("a", 1, 0.6), ("a", 0, 0.1)]
    best = ev.best_threshold(ev.score_counts(rows(spark, data))).first()
    f1 = {t: 2 * sum(y for _, y, s in data if s >= t) / (sum(s >= t for _, _, s in data) + 2) for _, _, t in data}
    top = max(f1.values())
    assert best["threshold"] == min(t for t, v in f1.items() if v == top)


def test_holdout_is_stratified_and_stable(spark):
    df = rows(spark, sample())
    a = {r["id"]: r["held_out"] for r in ev.holdout(df, "id", 0.2).collect()}
    b = {r["id"]: r["held_out"] for r in ev.holdout(df.repartition(5), "id", 0.2).collect()}
    assert a == b
    for y in (0, 1):
        ids = [r["id"] for r in df.collect() if r["y"] == y]
        assert sum(a[i] for i in ids) == int(len(ids) * 0.2)


def test_bootstrap_skips_draws_with_one_class(spark):
    df = spark.createDataFrame([(i, int(i == 0), 0.1 * i, 0.2) for i in range(4)], "id bigint, y int, score_a double, score_b double")
    drawn = ev.paired_draws(df, "id", 30).collect()
    assert 0 < len(drawn) < 30


def test_bootstrap_hashes_every_row_once_in_many_tasks(spark, monkeypatch):
    """Draws equal plain counting; a row is hashed once for both scores and passes, and tasks grow with the rows."""
    draw = random.Random(5)
    data = [(i, int(draw.random() < 0.4), draw.randrange(9) / 9, draw.random() if i % 7 else None) for i in range(300)]
    df = spark.createDataFrame(data, "id bigint, y int, score_a double, score_b double")
    hashed, tasks, plain = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0), ev.copy_counts

    def counting(keys, draws, seed):
        hashed.add(len(keys))
        tasks.add(1)
        return plain(keys, draws, seed)

    monkeypatch.setattr(ev, "copy_counts", counting)
    monkeypatch.setattr(ev, "DRAWN_ROWS", 50)
    found = {r["draw"]: r for r in ev.paired_draws(df, "id", 20).collect()}
    assert hashed.value == len(data) and 4 <= tasks.value <= 6
    copies = plain([str(i) for i, *_ in data], 20, "0")
    assert copies.max() < 255
    for d in range(20):
        for name, place in (("a", 2), ("b", 3)):
            some = [(None, r[1], r[place]) for r in data for _ in range(copies[r[0], d]) if r[place] is not None]
            assert abs(found[d][f"auc_{name}"] - pair_auc(some)) < 1e-9
            assert abs(found[d][f"pr_auc_{name}"] - step_precision(some)) < 1e-9
