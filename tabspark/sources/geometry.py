"""Page geometry: glyphs and strokes with the columns the layout operators need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DASHES = "–—−‐‑‒"  # fixed values: dash look-alikes read as "-"


def prepare_glyphs(glyphs: DataFrame) -> DataFrame:
    """Dashes as "-", blank glyphs dropped, centre, bold and italic derived."""
    text = F.translate("text", DASHES, "-" * len(DASHES))
    return glyphs.where(F.trim("text") != "").withColumns(
        {
            "text": text,
            "xc": (F.col("x0") + F.col("x1")) / 2,
            "yc": (F.col("top") + F.col("bottom")) / 2,
            "bold": F.lower("font").contains("bold"),
            "italic": F.lower("font").rlike("italic|oblique"),
        }
    )


def prepare_strokes(strokes: DataFrame) -> DataFrame:
    """Whether strokes are level or upright; only slanted ones rise or fall."""
    wide, high = F.col("x1") - F.col("x0"), F.col("bottom") - F.col("top")
    level, upright = (high <= 1.0) & (wide > high), (wide <= 1.0) & (high > wide)
    slanted: Column = F.when(~level & ~upright, F.col("rising"))
    return strokes.withColumns({"horizontal": level, "vertical": upright, "rising": slanted})


def read_geometry(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    glyphs = prepare_glyphs(spark.read.parquet(f"{folder}/glyphs"))
    return glyphs, prepare_strokes(spark.read.parquet(f"{folder}/strokes"))
