"""Hashes that other engines can repeat: SHA-256 over joined text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = "\x1f"
NULL = "\\N"
DIGITS = 13


def joined(*parts: Column | str) -> Column:
    return F.concat_ws(SEPARATOR, *[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])


def row_line(fields: Sequence[str]) -> Column:
    """A row as one line; a null is spelled out, so it differs from empty text."""
    return F.concat_ws(SEPARATOR, *[F.coalesce(F.col(c).cast("string"), F.lit(NULL)) for c in fields])


def sha_hex(text: Column) -> Column:
    return F.sha2(text, 256)


def sha_number(text: Column) -> Column:
    """The first 13 hex digits of the hash as a whole number below 16**13."""
    return F.conv(F.substring(sha_hex(text), 1, DIGITS), 16, 10).cast("bigint")


def uniform(*parts: Column | str) -> Column:
    """A reproducible draw in [0, 1) that depends only on its parts."""
    return sha_number(joined(*parts)) / F.lit(float(16**DIGITS))
