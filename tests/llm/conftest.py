import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def table(spark):
    """Rows (doc_id, text, lang, source) as a documents table."""

    def build(rows, partitions=3):
        data = [(i, t, lang, source, None if t is None else len(t)) for i, t, lang, source in rows]
        return spark.createDataFrame(data, SCHEMA).repartition(partitions)

    return build


@pytest.fixture
def odd_rows():
    """Nulls in every column, blank, empty and long texts, ties and repeated rows."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    long = prose(6000)
    base = prose(120)
    rows = [
        (1, None, "en", "a"), (2, "", "en", "a"), (3, " \t\n\x0b\x0c\r", "en", None), (None, base, None, "b"),
        (4, base, "en", "b"), (5, base.replace(" ", "\n"), "en", "b"), (6, base + " end", "de", None),
        (6, base + " end", "de", None), (7, long, "fr", "c"), (8, long[:200] + "  " + long[200:], None, None),
        (None, None, None, None), (9, "x" * 500 + " " + "!" * 400, "en", "a"), (10, "a b c a b c a b c", "en", "a"),
        (11, "    wide", "en", "a"), (12, "😀 é \u0000 nul", "en", "c"),
    ]
    rows += [(20 + i, prose(rng.randint(1, 90)), rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", None])) for i in range(60)]
    rows += [(100 + i, prose(40) + " " + base[: base.index(" ", 300)] + " " + prose(40), "en", "a") for i in range(6)]
    return rows


@pytest.fixture
def clashing():
    """Adds columns whose names the operators use themselves."""

    def add(df):
        from pyspark.sql import functions as F

        names = ["key_id", "key_text", "size", "score", "ids", "row", "shard", "part", "copies", "kept", "draw", "label", "node", "run", "best", "target"]
        return df.select("*", *[F.lit(n).alias(n) for n in names])

    return add
