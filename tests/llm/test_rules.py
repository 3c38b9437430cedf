"""Quality rules and the classifier."""

import re
import random
import zlib
from collections import Counter

from pyspark.sql import functions as F

from chronotape.llm import quality_classifier, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {p for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for p in range(i, i + 3)}
    n, repeated = len(words), len(covered)
    return (
        n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), repeated,
        n < 50 or 100 * repeated > 50 * n,
    )


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def rule_rows():
    rng = random.Random(2)
    rows = []
    for i in range(400):
        words = [rng.choice(["the", "of", "anion", "mere", "stone", "üben", "zu", "x#y"]) + rng.choice("abcdefghij") * rng.randrange(4) for _ in range(rng.randrange(30, 160))]
        if i % 10 == 0:
            words = [w + "***" for w in words]
        rows.append((i, "".join(w + rng.choice(["\n", " ", "  "]) for w in words), "en" if i % 2 else "de", f"s{i % 3}"))
    rows.append((900, "\n".join(["one line that repeats itself"] * 20), "en", "s1"))
    return rows


def test_base_counts(table, odd_rows):
    rows = odd_rows + rule_rows()
    got = Counter((r["doc_id"], *[r[c] for c in COUNTS]) for r in quality_rules.judged(table(rows)).collect())
    assert got == Counter((i, *base(t)) for i, t, *_ in rows)


def test_adaptive_verdicts(table):
    rows = rule_rows()
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.judged(table(rows)).collect()}
    for i, t, *_ in rows:
        if base(t)[-1]:
            assert not kept[i]
        else:
            assert kept[i] == (i % 10 != 0), i


def test_sketch_quartiles_are_close(spark):
    values = [random.Random(4).lognormvariate(1, 1) for _ in range(3000)]
    rows = spark.createDataFrame([("en", f"s{i % 7}", 1, v) for i, v in enumerate(values)], "lang string, source string, n_words int, v double")
    cells = rows.selectExpr("lang", "source", "'m' as metric", f"cast(ceil(ln(v) / ln({quality_rules.GAMMA})) as int) as bucket").groupBy("lang", "source", "metric", "bucket").agg(F.count("*").alias("n"))
    got = quality_rules.quartiles(cells, "lang").first()
    want = sorted(values)
    assert got["n"] == 3000
    assert abs(got["q1"] / want[749] - 1) < 0.02
    assert abs(got["q3"] / want[2249] - 1) < 0.02


def prose_rows(start, n, lang, source, junk=lambda i: False, rate=1.0):
    """Clean texts of 60 to 120 invented words; those that `junk` names have symbols behind a share of their words."""
    rng = random.Random(start)
    rows = []
    for i in range(n):
        words = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 8))) for _ in range(rng.randrange(60, 120))]
        if junk(i):
            words = [w + "#" if rng.random() < rate else w for w in words]
        rows.append((start + i, " ".join(words), lang, source))
    return rows


def test_rare_language_has_bounds(table):
    rare = prose_rows(5000, 8, "de", "s9", junk=lambda i: i % 4 == 0)
    alone = prose_rows(6000, 1, None, None, junk=lambda i: True, rate=0.6)
    rows = prose_rows(0, 150, "en", "s1") + rare + alone
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.judged(table(rows)).collect()}
    assert {i for i, k in kept.items() if not k} == {5000, 5004, 6000}


def test_junk_of_copies_or_of_distinct_texts_sets_no_bounds(table):
    clean = prose_rows(0, 240, "en", "s1") + prose_rows(10_000, 240, "en", "s2") + prose_rows(20_000, 240, "en", "s3")
    milder = prose_rows(30_000, 12, "en", "s1", junk=lambda i: True, rate=0.6)
    copied = [(40_000 + i, prose_rows(7, 1, "en", "s1", junk=lambda i: True, rate=0.8)[0][1], "en", "s1") for i in range(160)]
    distinct = prose_rows(50_000, 160, "en", "s2", junk=lambda i: True, rate=0.8)
    # Half of its lines repeat: a rate in [0, 1] that a wide bound would never reach.
    lines = [[w for w in t.split(" ")] for _, t, *_ in prose_rows(60_000, 160, "en", "s3")]
    repeated = [(60_000 + i, "\n".join(w for w in words for _ in range(2)), "en", "s3") for i, words in enumerate(lines)]
    rows = clean + milder + copied + distinct + repeated
    judged = quality_rules.judged(table(rows)).collect()
    kept = {r["doc_id"]: r["kept"] for r in judged}
    assert not any(r["base_failed"] for r in judged)
    assert {i for i, k in kept.items() if k} == {i for i, *_ in clean}


def test_copies_do_not_move_the_bounds(table):
    rows = prose_rows(0, 60, "en", "s1", junk=lambda i: i % 6 == 0, rate=0.3)
    failing = [(9000 + i, "a b c d # " * 40, "en", "s1") for i in range(50)]
    more = rows + failing + [(1000 + i, rows[0][1], "en", "s1") for i in range(90)]
    bounds = [quality_rules.thresholds(quality_rules.sketches(quality_rules.measures(table(x)).cache())).first() for x in (rows, more)]
    assert bounds[0] == bounds[1]


def test_every_group_has_quartiles_of_the_mixture(spark):
    rng = random.Random(6)
    groups = {("en", "a"): 90, ("en", "b"): 3, ("de", "a"): 1, (None, None): 7}
    data = [(*g, "symbol_rate", rng.choice([-1_000_000, *range(k % 5, 40)]), 1) for k, (g, n) in enumerate(groups.items()) for _ in range(n)]
    cells = spark.createDataFrame(data, "lang string, source string, metric string, bucket int, n bigint")

    def merged(rows, wider=None):
        counts = Counter(b for _, _, _, b, _ in rows)
        return {b: counts[b] + quality_rules.PRIOR * wider.get(b, 0) / sum(wider.values()) for b in {*counts, *wider}} if wider else counts

    def quartile(sketch, q):
        total, up_to = sum(sketch.values()), 0
        for b in sorted(sketch):
            up_to += sketch[b]
            if up_to >= q * total - 1e-9:
                return 0.0 if b == -1_000_000 else quality_rules.GAMMA ** (b - 0.5)

    got = {(r["lang"], r["source"]): r for r in quality_rules.mixed_quartiles(cells).collect()}
    assert set(got) == set(groups)
    for lang, source in groups:
        wider = merged([d for d in data if d[0] == lang], merged(data))
        want = merged([d for d in data if d[:2] == (lang, source)], wider)
        for name, q in (("q1", 0.25), ("q2", 0.5), ("q3", 0.75)):
            assert abs(got[lang, source][name] - quartile(want, q)) < 1e-9


def test_filter_keeps_whole_rows(table, odd_rows, clashing):
    docs = clashing(table(odd_rows + rule_rows()))
    out = quality_rules.filter_quality(docs)
    assert out.columns == docs.columns
    want = Counter(r["doc_id"] for r in quality_rules.judged(docs).collect() if r["kept"])
    assert Counter(r["doc_id"] for r in out.collect()) == want
    assert quality_rules.judged(table([])).count() == 0


def classed_rows():
    rng = random.Random(8)
    rows, marks = [], []
    for i in range(400):
        good = i % 4 != 0
        words = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 8))) for _ in range(rng.randrange(20, 80))]
        if not good:
            words = [w + rng.choice(["***", "$$$", "##"]) for w in words]
        rows.append((i, " ".join(words), "en", "a"))
        marks.append((i, int(good)))
    return rows, marks


def test_classifier_on_held_out_rows(spark, table, odd_rows, clashing):
    rows, marks = classed_rows()
    labels = spark.createDataFrame([*marks, (None, 1), (7000, 0), (3, None)], "doc_id bigint, quality int")
    docs = clashing(table(rows + [(10_000 + (i or 0), *r) for i, *r in odd_rows]))
    model = quality_classifier.fit(docs, quality_classifier.training_marks(labels))
    scored = quality_classifier.scored(docs, model)
    assert scored.columns[: len(docs.columns)] == docs.columns
    scores = {r["doc_id"]: r[scored.columns[-1]] for r in scored.collect()}
    assert all(0 <= s <= 1 for s in scores.values())
    held = [(i, q) for i, q in marks if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(held) > 50
    assert sum((scores[i] >= 0.7) == bool(q) for i, q in held) >= 0.97 * len(held)
    accepted = quality_classifier.accepted(docs, labels)
    assert accepted.columns == docs.columns
    assert {r["doc_id"] for r in accepted.collect()} == {i for i, s in scores.items() if s >= quality_classifier.ACCEPT}


def test_classifier_does_not_read_held_out_labels(spark, table):
    rows, marks = classed_rows()
    flipped = [(i, 1 - q if zlib.crc32(str(i).encode()) % 4 == 2 else q) for i, q in marks]
    out = []
    for m in (marks, flipped):
        labels = spark.createDataFrame(m, "doc_id bigint, quality int")
        docs = table(rows)
        model = quality_classifier.fit(docs, quality_classifier.training_marks(labels))
        out.append({r["doc_id"]: r["score"] for r in quality_classifier.scored(docs, model).collect()})
    assert out[0] == out[1]


def test_classifier_without_labels_or_classes(spark, table, odd_rows):
    docs = table(odd_rows)
    none = spark.createDataFrame([], "doc_id bigint, good boolean")
    one = spark.createDataFrame([(20, True), (21, True)], "doc_id bigint, good boolean")
    for marks, least, most in ((none, 0.5, 0.5), (one, 0.99, 1.0)):
        scores = [r["score"] for r in quality_classifier.scored(docs, quality_classifier.fit(docs, marks)).collect()]
        assert len(scores) == len(odd_rows)
        assert all(least <= s <= most for s in scores)
    assert quality_classifier.scored(table([]), quality_classifier.fit(table([]), none)).count() == 0


def test_repeated_ids_and_bounds_of_the_fit(spark, table):
    """One id on many texts is one row of the fit, and the order of rows does not change the model."""
    rows, marks = classed_rows()
    rows += [(1, f"{t} again", "en", "a") for _, t, *_ in rows[:60]] * 2
    labels = spark.createDataFrame(marks, "doc_id bigint, quality int")
    known = quality_classifier.training_marks(labels)
    models = [quality_classifier.fit(table(r, n), known) for r, n in ((rows, 3), (rows[::-1], 7))]
    assert models[0].bias == models[1].bias and (models[0].scaled == models[1].scaled).all()
    few = quality_classifier.fit(table(rows), known, fit_features=3000)
    assert (few.scaled != models[0].scaled).any()


def test_descent_equals_a_plain_dual_solver():
    import numpy as np

    rng = np.random.default_rng(5)
    rows = [np.unique(rng.integers(0, 40, 12)) for _ in range(60)]
    y = np.array([1 if (r < 20).mean() + rng.normal() * 0.2 > 0.5 else -1 for r in rows])
    ratios = quality_classifier.log_count_ratios(rows, y)
    for j in range(40):
        inside = [sum(j in r for r, s in zip(rows, y, strict=True) if s == sign) + 1 for sign in (1, -1)]
        whole = [sum(len(r) for r, s in zip(rows, y, strict=True) if s == sign) + quality_classifier.BUCKETS for sign in (1, -1)]
        assert abs(ratios[j] - np.log(inside[0] / whole[0] * whole[1] / inside[1])) < 1e-9
    x = np.zeros((60, 41))
    for i, r in enumerate(rows):
        x[i, r] = ratios[r] / np.linalg.norm(ratios[r])
        x[i, 40] = 1
    most = np.array([quality_classifier.COST * 60 / (2 * (y == s).sum()) for s in y])
    gram = (x * y[:, None]) @ (x * y[:, None]).T
    alpha = np.zeros(60)
    for _ in range(20_000):
        alpha = np.clip(alpha - (gram @ alpha - 1) / np.linalg.norm(gram, 2), 0, most)

    def loss(w):
        return 0.5 * w @ w + (most * np.maximum(0, 1 - y * (x @ w))).sum()

    weights, bias = quality_classifier.descend(rows, y, ratios)
    mine, best = np.append(weights[:40], bias), x.T @ (alpha * y)
    assert loss(mine) <= 1.02 * loss(best)
    assert np.corrcoef(x @ mine, x @ best)[0, 1] > 0.99


def test_descent_separates():
    import numpy as np

    rows = [np.array([1, 5]), np.array([1, 6]), np.array([2, 5]), np.array([2, 6])]
    y = np.array([1, 1, -1, -1])
    ratios = quality_classifier.log_count_ratios(rows, y)
    weights, bias = quality_classifier.descend(rows, y, ratios)
    assert [np.sign(quality_classifier.margin(r, ratios, weights, bias)) for r in rows] == [1, 1, -1, -1]
