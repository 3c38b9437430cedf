"""Quality rules whose thresholds come from quantile sketches of each language and source."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronotape.llm.rows import SPACE, WORD, apply_copies, row_key
from chronotape.plans.shared import written

#: Relative width of a bucket of the sketch: a quantile is right to half of it.
GAMMA = 1.02
#: Documents that the sketch of the next wider group counts for: of the corpus in a language, of the language in a source.
PRIOR = 100.0
#: How many spreads beyond a quartile a document may stand.
REACH = 3.0
#: metric -> (its value, its smallest spread, judged on both sides).
METRICS: dict[str, tuple[str, float, bool]] = {
    "word_length": ("word_chars / n_words", 0.5, True),
    "symbol_rate": ("n_symbols / n_words", 0.05, False),
    "dup_line_rate": ("n_dup_lines / n_lines", 0.05, False),
    "repeat_rate": ("n_repeat_words / n_words", 0.05, False),
}


def repeated_words(words: Column) -> Column:
    """Number of words in 3-word windows that occur at least twice in the array.

    The windows' hashes are compared first as a set; only texts that repeat one sort (hash, place), where
    equal windows are neighbours, and add up the union of their intervals.
    """
    n = F.size(words)
    hashes = F.transform(
        F.sequence(F.lit(1), n - 2),
        lambda i: F.xxhash64(F.element_at(words, i), F.element_at(words, i + 1), F.element_at(words, i + 2)),
    )

    def covered(grams: Column) -> Column:
        def places(ordered: Column) -> Column:
            def same(k: Column) -> Column:
                here = F.get(ordered, k)["h"]
                return (here == F.get(ordered, k - 1)["h"]) | (here == F.get(ordered, k + 1)["h"])

            found = F.filter(F.sequence(F.lit(0), F.size(ordered) - 1), lambda k: F.coalesce(same(k), F.lit(False)))
            return F.transform(found, lambda k: F.get(ordered, k)["i"])

        placed = F.sort_array(
            F.transform(F.sequence(F.lit(1), F.size(grams)), lambda i: F.struct(F.element_at(grams, i).alias("h"), i.alias("i")))
        )
        starts = F.sort_array(F.element_at(F.transform(F.array(placed), places), 1))
        return F.aggregate(
            starts,
            F.struct(F.lit(0).alias("words"), F.lit(0).alias("end")),
            lambda a, x: F.struct((a["words"] + 3 - F.greatest(F.lit(0), a["end"] - x)).alias("words"), (x + 3).alias("end")),
            lambda a: a["words"],
        )

    counted = F.transform(
        F.array(hashes), lambda g: F.when(F.size(F.array_distinct(g)) < F.size(g), covered(g)).otherwise(F.lit(0))
    )
    return F.when(n >= 3, F.element_at(counted, 1)).otherwise(F.lit(0))


def measures(docs: DataFrame) -> DataFrame:
    """Row key, lang, source and the counts of every whole text; a null text has no words."""
    key_id, key_text = row_key(docs)
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    return (
        docs.select(
            "doc_id",
            F.col("lang").cast("string").alias("lang"),
            F.col("source").cast("string").alias("source"),
            key_id.alias("key_id"),
            key_text.alias("key_text"),
            F.xxhash64(text).alias("text_hash"),
            F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("words"),
            F.length(F.regexp_replace(text, SPACE, "")).alias("word_chars"),
            F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).alias("n_symbols"),
            lines.alias("lines"),
        )
        .select(
            "doc_id",
            "lang",
            "source",
            "key_id",
            "key_text",
            "text_hash",
            F.size("words").cast("bigint").alias("n_words"),
            F.col("word_chars").cast("bigint").alias("word_chars"),
            F.col("n_symbols").cast("bigint").alias("n_symbols"),
            F.size("lines").cast("bigint").alias("n_lines"),
            (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
            repeated_words(F.col("words")).cast("bigint").alias("n_repeat_words"),
        )
        .withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    )


def sketches(measured: DataFrame) -> DataFrame:
    """Counts per (lang, source, metric, bucket): sketches with relative error, merged by adding counts.

    A text counts once in its language and source, however many copies it has, and only when it passes the base rules.
    Bucket b > 0 or < 0 holds the values up to GAMMA ** b and above the next lower power; a value of 0 has
    its own bucket. Counts are whole numbers, so merging in any order gives the same sketch.
    """
    one = F.explode(
        F.array(*[F.struct(F.lit(name).alias("metric"), F.expr(value).alias("value")) for name, (value, _, _) in METRICS.items()])
    )
    counts = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
    texts = measured.where(~F.col("base_failed")).groupBy("lang", "source", "text_hash").agg(*[F.min(c).alias(c) for c in counts])
    values = texts.select("lang", "source", one.alias("m")).select("lang", "source", "m.*")
    bucket = F.when(F.col("value") > 0, F.ceil(F.log("value") / F.log(F.lit(GAMMA)))).otherwise(F.lit(-1_000_000))
    return values.groupBy("lang", "source", "metric", bucket.cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def running(cells: DataFrame, *groups: str) -> DataFrame:
    """The merged cells of each (group, metric): the count up to every bucket, and the whole count n."""
    merged = cells.groupBy(*groups, "metric", "bucket").agg(F.sum("n").alias("n"))
    keys = [F.col(g) for g in groups] + [F.col("metric")]
    up_to = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    return merged.select(*groups, "metric", "bucket", F.sum("n").over(up_to).alias("up_to"), F.sum("n").over(whole).alias("n"))


def bucket_value(bucket: Column) -> Column:
    return F.when(bucket > -1_000_000, F.pow(F.lit(GAMMA), bucket - 0.5)).otherwise(F.lit(0.0))


QUARTILES = {"q1": 0.25, "q2": 0.5, "q3": 0.75}


def quartiles(cells: DataFrame, *groups: str) -> DataFrame:
    """The quartiles and the number of values of each (group, metric), merged from the cells."""
    at = lambda q: F.min(F.when(F.col("up_to") >= q * F.col("n"), bucket_value(F.col("bucket"))))
    return running(cells, *groups).groupBy(*groups, "metric").agg(F.max("n").alias("n"), *[at(q).alias(name) for name, q in QUARTILES.items()])


def language_cells(cells: DataFrame) -> DataFrame:
    """The cells of each language, with the sketch of the whole corpus added at the weight of PRIOR documents.

    Rows are languages times buckets, and a metric has some thousand buckets at most.
    """
    corpus = cells.groupBy("metric", "bucket").agg(F.sum("n").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("metric"))
    prior = cells.select("lang").distinct().crossJoin(F.broadcast(corpus.select("metric", "bucket", (PRIOR * share).alias("prior"))))
    own = cells.select("lang", "metric", "bucket", "n", F.lit(0.0).alias("prior"))
    both = own.unionByName(prior.select("lang", "metric", "bucket", F.lit(0).cast("bigint").alias("n"), "prior"))
    return both.groupBy("lang", "metric", "bucket").agg((F.sum("n") + F.sum("prior")).alias("n"))


def bucket_reaching(wider: Column, share: Column) -> Column:
    """The first bucket of the array (bucket, share up to it) that reaches a share, by halving; null beyond the last."""
    steps = F.array(*[F.lit(1 << k) for k in range(15, -1, -1)])
    below = F.aggregate(
        steps, F.lit(0), lambda at, step: F.when(F.get(wider, at + step - 1)["share"] < share, at + step).otherwise(at)
    )
    return F.get(wider, below)["bucket"]


def mixed_quartiles(cells: DataFrame) -> DataFrame:
    """Quartiles of each (lang, source, metric) whose sketch has its language's added at the weight of PRIOR documents.

    The language's sketch has the corpus's added in the same way, so every group has quartiles, and they move
    from the corpus's to its own as it grows. Between two own buckets the own count stands still, and the
    language's sketch says where the rest is reached: the quartile is the least of these places.
    """
    listed = lambda *fields: F.sort_array(F.collect_list(F.struct(*fields)))
    own = running(cells, "lang", "source").groupBy("lang", "source", "metric").agg(
        F.max("n").alias("n"), listed("bucket", "up_to").alias("own")
    )
    wider = running(language_cells(cells), "lang").groupBy(F.col("lang").alias("lang_all"), F.col("metric").alias("metric_all")).agg(
        listed("bucket", (F.col("up_to") / F.col("n")).alias("share")).alias("wider"),
        *[F.min(F.when(F.col("up_to") >= q * F.col("n"), bucket_value(F.col("bucket")))).alias(f"{name}_all") for name, q in QUARTILES.items()],
    )
    both = own.join(wider, F.col("lang").eqNullSafe(F.col("lang_all")) & (F.col("metric") == F.col("metric_all")))
    first = F.struct(F.lit(-2_000_000).alias("bucket"), F.lit(0).cast("bigint").alias("up_to"))

    def at(q: float) -> Column:
        def place(cell: Column) -> Column:
            rest = bucket_reaching(F.col("wider"), (q * (F.col("n") + PRIOR) - cell["up_to"]) / PRIOR)
            return F.when(rest.isNotNull(), F.greatest(cell["bucket"], rest))

        return bucket_value(F.array_min(F.transform(F.concat(F.array(first), F.col("own")), place)))

    found = [at(q).alias(name) for name, q in QUARTILES.items()]
    return both.select("lang", "source", "metric", *found, *[f"{name}_all" for name in QUARTILES])


def thresholds(cells: DataFrame) -> DataFrame:
    """One row per (lang, source): the bounds of every metric.

    The spread of a language is twice the lesser distance of its median from a quartile: junk on one side
    leaves it as it is up to half of all texts. A group's quartiles count as far as that spread from its own median, and
    its reach is REACH such spreads at most, so junk in a group widens its bounds only by as much as its language allows.
    """
    chosen = mixed_quartiles(cells)
    bounds = []
    for name, (_, spread, two_sided) in METRICS.items():
        robust = F.greatest(F.lit(spread), 2 * F.least(F.col("q2_all") - F.col("q1_all"), F.col("q3_all") - F.col("q2_all")))
        reach = REACH * F.greatest(F.lit(spread), F.least(F.col("q3") - F.col("q1"), robust))
        mine = F.col("metric") == name
        bounds.append(F.max(F.when(mine, F.least(F.col("q3"), F.col("q2") + robust) + reach)).alias(f"{name}_most"))
        if two_sided:
            bounds.append(F.max(F.when(mine, F.greatest(F.col("q1"), F.col("q2") - robust) - reach)).alias(f"{name}_least"))
    return chosen.groupBy("lang", "source").agg(*bounds)


def judged(docs: DataFrame) -> DataFrame:
    """For every row: doc_id, its counts, base_failed, kept, and its row key.

    A document is kept when it passes the base rules and each of its rates lies within the bounds of its
    language and source: REACH spreads beyond the quartiles that the sketches of all distinct texts give. A group
    of few documents leans on its language and a rare language on the corpus; null languages and sources are
    values of their own. Blank and null texts have no words and fail the base rules. An empty
    table gives an empty result; other columns are not read; equal rows get equal verdicts.
    """
    measured = written(measures(docs), "measures")
    bounds = thresholds(written(sketches(measured), "sketches"))
    named = bounds.withColumnRenamed("lang", "of_lang").withColumnRenamed("source", "of_source")
    joined = measured.join(
        named, F.col("lang").eqNullSafe(F.col("of_lang")) & F.col("source").eqNullSafe(F.col("of_source")), "left"
    )
    outside = []
    for name, (value, _, two_sided) in METRICS.items():
        outside.append(F.expr(value) > F.col(f"{name}_most"))
        if two_sided:
            outside.append(F.expr(value) < F.col(f"{name}_least"))
    beyond = reduce(lambda a, b: a | b, [F.coalesce(x, F.lit(False)) for x in outside])
    verdict = F.when(F.col("base_failed"), F.lit(False)).otherwise(~beyond)
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        verdict.alias("kept"), "key_id", "key_text",
    )


def filter_quality(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, whole rows."""
    return apply_copies(docs, judged(docs).select("key_id", "key_text", F.col("kept").cast("int").alias("copies")))
