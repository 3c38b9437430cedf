"""Shards and mixes."""

import re
import zlib
from collections import Counter, defaultdict

from chronotape.llm import exact_dedup, mixing, quality_rules, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def size(text):
    return len((text or "").encode()) + 1


def test_shards(table, odd_rows):
    for rows, n in ((odd_rows, 16), ([(i, "x" * (i % 7), "en", "a") for i in range(500)], 16), (odd_rows[:5], 16), (odd_rows, 1)):
        out = sharding.shards(table(rows), n).collect()
        want = Counter((i, size(t), zlib.crc32((t or "").encode())) for i, t, *_ in rows)
        assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == want
        slots = defaultdict(list)
        for r in out:
            slots[r["shard"]].append(r["slot"])
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        assert set(slots) <= set(range(n))
        ordered = sorted(out, key=lambda r: (r["shard"], r["slot"]))
        key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["text_crc32"], r["size"])
        assert [key(r) for r in ordered] == sorted(key(r) for r in out)
        total, largest = sum(r["size"] for r in out), max(r["size"] for r in out)
        bytes_of = Counter()
        for r in out:
            bytes_of[r["shard"]] += r["size"]
        assert all(abs(bytes_of[s] - total / n) <= largest for s in range(n))
    assert sharding.shards(table([]), 16).count() == 0


def test_written_shards_hold_every_document(table, odd_rows, spark, clashing, tmp_path):
    for name, docs, folder in (("plain", table(odd_rows + odd_rows[4:7]), "shard"), ("clash", clashing(table(odd_rows)), "_shard")):
        out = str(tmp_path / name)
        sharding.write_shards(docs, out, 4)
        assert {f.name for f in (tmp_path / name).glob("*=*")} <= {f"{folder}={s}" for s in range(4)}
        back = spark.read.parquet(out).drop(folder)
        assert back.columns == docs.columns
        assert Counter(map(tuple, back.collect())) == Counter(map(tuple, docs.collect()))
        placed = Counter((r["shard"], r["text_crc32"]) for r in sharding.shards(docs, 4).collect())
        again = spark.read.parquet(out).selectExpr(folder, "crc32(cast(coalesce(text, '') as binary)) as c").collect()
        assert Counter((r[0], r["c"]) for r in again) == placed


def test_rows_of_equal_id_and_text_stay_themselves(spark, tmp_path):
    """Only the source and another column tell two rows apart."""
    text = " ".join(f"word{i}" for i in range(80))
    rows = [(1, text, "en", "a", len(text), "x"), (1, text, "en", "b", len(text), "y"), (1, text, "en", "b", len(text), "y"), (None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, note string")
    kept = quality_rules.filter_quality(docs)
    assert Counter(map(tuple, kept.collect())) == Counter(rows[:3])
    none = spark.createDataFrame([], "doc_id bigint, weight double")
    mixed = Counter((r["source"], r["note"]) for r in mixing.mixture(docs, none).collect())
    assert {("a", "x"): mixed["a", "x"], ("b", "y"): mixed["b", "y"]} == {("a", "x"): 1, ("b", "y"): 2}
    sharding.write_shards(docs, str(tmp_path / "s"), 3)
    assert Counter(map(tuple, spark.read.parquet(str(tmp_path / "s")).drop("shard").collect())) == Counter(rows)
    assert Counter(map(tuple, exact_dedup.deduplicate(docs.limit(3)).collect())).total() == 1


def test_ids_that_are_texts(spark):
    docs = spark.createDataFrame([("x1", "one two", "en", "a"), ("x2", "one  two", "en", "a"), (None, "three", "en", "b")], "doc_id string, text string, lang string, source string")
    assert {(r["doc_id"], r["keep_id"]) for r in exact_dedup.decisions(docs).collect()} == {("x1", "x2"), ("x2", "x2"), (None, None)}
    assert sharding.shards(docs, 2).count() == quality_rules.judged(docs).count() == 3


def targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        rest, free = total - sum(fixed.values()), [s for s in names if s not in fixed]
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return {**fixed, **share}
        fixed |= {s: 3.0 * sizes[s] for s in over}


def test_mix(table, odd_rows, spark):
    rows = odd_rows + [(2000 + i, "w " * (1 + i % 40), "en", f"s{i % 11}" if i % 3 else "s0") for i in range(900)]
    rows += [(5000, "tiny", "en", "t1"), (5001, "tiny one", "en", "t2"), (5002, None, "en", "t3")]
    weights = spark.createDataFrame([(2000 + i, 4.0) for i in range(0, 900, 2)] + [(None, 3.0), (2001, None), (2003, -1.0)], "doc_id bigint, weight double")
    out = mixing.mix(table(rows), weights).collect()
    again = mixing.mix(table(rows, 7), weights).collect()
    assert Counter(map(tuple, out)) == Counter(map(tuple, again))
    by_source = defaultdict(int)
    for i, t, _, s in rows:
        by_source[s] += len(WORD.findall(t or ""))
    want = targets(by_source)
    known = defaultdict(list)
    for i, t, _, s in rows:
        known[i, len(WORD.findall(t or ""))].append(s)
    taken, largest = defaultdict(int), defaultdict(int)
    for r in out:
        sources = {s for s in known[r["doc_id"], r["size"]] if by_source[s] == r["source_size"]}
        assert sources
        s = sources.pop()
        assert abs(r["target"] - want[s]) <= 1e-6 * max(1, want[s])
        assert r["taken"] == r["copies"] * r["size"] <= 3 * r["size"]
        assert r["copies"] - r["target"] // max(1, r["source_size"]) in (0, 1) or not r["source_size"]
        taken[s] += r["taken"]
        largest[s] = max(largest[s], r["size"])
    for s in by_source:
        assert abs(taken[s] - want[s]) <= largest[s], s
    assert mixing.mix(table([]), weights).count() == 0


def test_sources_that_fill_at_the_same_level(spark):
    """Sizes in the ratio of the weights: the tie must not lower the common level."""
    sizes = {"a": 80, "b": 160, None: 0}
    out = mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, size bigint")).collect()
    assert {r["source"]: r["target"] for r in out} == targets(sizes) == {"a": 80, "b": 160, None: 0}


def test_heavier_documents_are_taken_more_often(table, spark):
    rows = [(i, "w " * 10, "en", "a" if i < 2000 else "b") for i in range(4000)]
    weights = spark.createDataFrame([(i, 5.0) for i in range(0, 4000, 2)], "doc_id bigint, weight double")
    out = mixing.mix(table(rows), weights).where("doc_id < 2000").collect()
    heavy = sum(r["copies"] for r in out if r["doc_id"] % 2 == 0)
    light = sum(r["copies"] for r in out if r["doc_id"] % 2)
    assert heavy > 1.5 * light


def test_mixture_repeats_whole_rows(table, odd_rows, spark, clashing):
    docs = clashing(table(odd_rows))
    none = spark.createDataFrame([], "doc_id bigint, weight double")
    out = mixing.mixture(docs, none)
    assert out.columns == docs.columns
    want = sum(r["copies"] for r in mixing.mix(docs, none).collect())
    assert out.count() == want
    words = sum(len(WORD.findall(r["text"] or "")) for r in out.collect())
    assert words == sum(r["taken"] for r in mixing.mix(docs, none).collect())
