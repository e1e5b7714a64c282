"""Text sources: lines and characters of stored texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def explode_lines(df: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """One row per line: keys, line_no (from 0), line."""
    return df.select(*keys, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))


def explode_chars(df: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """One row per character of every line; ``x`` is the column in a monospaced font."""
    lines = explode_lines(df, keys, text).where(F.length("line") > 0)
    return lines.select(*keys, "line_no", F.posexplode(F.split("line", "")).alias("x", "char"))


def char_features(df: DataFrame, keys: Sequence[str], line: str) -> DataFrame:
    """What tells a tab line from prose, for every line."""
    c = F.col(line)
    return df.select(
        *keys,
        F.length(c).alias("length"),
        F.regexp_count(c, F.lit("-")).alias("dashes"),
        F.regexp_count(c, F.lit("[0-9]")).alias("digits"),
        F.regexp_count(c, F.lit("[A-Za-z]{3,}")).alias("words"),
    )
