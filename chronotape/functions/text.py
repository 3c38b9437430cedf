"""Text normalisation: compatibility form, single spaces, case folding; empty becomes null."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ASCII = r"^[\x00-\x7F]*$"
ASCII_SPACE = r"[\x09-\x0D\x1C-\x20]+"


def is_blank(text: Column) -> Column:
    """Null, empty or only white space, Unicode white space included."""
    return text.isNull() | text.rlike(r"(?U)^\s*$")


def normalize_ascii(text: Column) -> Column:
    """The rule for text that has only ASCII characters, inside the JVM."""
    collapsed = F.lower(F.regexp_replace(text, ASCII_SPACE, " "))
    trimmed = F.trim(collapsed)
    return F.when(trimmed != "", trimmed)


def _normalize(text: str | None) -> str | None:
    if text is None:
        return None
    return " ".join(unicodedata.normalize("NFKC", text).split()).casefold() or None


@F.pandas_udf(T.StringType())
def normalize_any(text: pd.Series) -> pd.Series:
    return text.map(_normalize)


def normalized(rows: DataFrame, column: str, name: str = "normalized") -> DataFrame:
    """Add the normalised text, row by row; only texts beyond ASCII leave the JVM."""
    text = F.col(column)
    plain = text.rlike(ASCII)
    return rows.withColumn(name, F.when(plain, normalize_ascii(text)).otherwise(normalize_any(F.when(~plain, text))))
