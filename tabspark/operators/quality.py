"""Rollups of a track and a song, change points, agreement of two readings, and text coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import lag, ordered


def track_report(notes: DataFrame, keys: Sequence[str], bar: str, beat: str, tie: Column, source: str, estimated: Column, strings: str) -> DataFrame:
    """Per track: notes (beats of ties only left out), bars, strings, sources, printed and estimated bars, instrument."""
    per_beat = notes.groupBy(*keys, bar, beat).agg(
        F.count("*").alias("_n"), F.bool_or(~tie).alias("_struck"), F.bool_or(estimated).alias("_est"),
        F.max(strings).alias("_strings"), F.collect_set(source).alias("_src"),
    )
    per_bar = per_beat.groupBy(*keys, bar).agg(
        F.sum(F.when(F.col("_struck"), F.col("_n")).otherwise(0)).alias("_n"), F.bool_or("_est").alias("_est"),
        F.max("_strings").alias("_strings"), F.array_distinct(F.flatten(F.collect_set("_src"))).alias("_src"),
    )
    out = per_bar.groupBy(*keys).agg(
        F.sum("_n").alias("notes"), F.count("*").alias("measures"), F.max("_strings").alias("strings"),
        F.count_if(~F.col("_est")).alias("notated"), F.count_if("_est").alias("estimated"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("_src")))), ",").alias("sources"),
    )
    return out.withColumn("instrument", F.when(F.col("strings") <= 5, "bass").otherwise("steel"))


def song_report(tracks: DataFrame, song: Sequence[str], track: str, name: str, measures: str, notes: str, warning: str) -> DataFrame:
    """Per song: tracks in order, totals, and warnings that name the track when there are several."""
    many = tracks.groupBy(*song).agg(
        F.count("*").alias("n_tracks"), F.max(measures).alias("measures"), F.sum(notes).alias("notes"),
        F.array_sort(F.collect_list(F.struct(track, name, warning))).alias("_t"),
    )
    said = F.filter("_t", lambda t: t[warning].isNotNull())
    text = F.transform(said, lambda t: F.when(F.col("n_tracks") > 1, F.concat(t[name], F.lit(": "), t[warning])).otherwise(t[warning]))
    return many.select(
        *song, "n_tracks", "measures", "notes", F.array_join(F.transform("_t", lambda t: t[name]), ",").alias("names"), F.array_join(text, "; ").alias("warnings")
    )


def change_points(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Rows where a value differs from the row before, the first row included."""
    line = ordered(df, keys, order).add(_p=lag(F.struct(F.col(value).alias("v"))))
    return line.df.where(F.col("_p").isNull() | ~F.col(value).eqNullSafe(F.col("_p")["v"])).drop("_p")


def compare_readings(a: DataFrame, b: DataFrame, song: Sequence[str], place: Sequence[str], fret: str, bar: str) -> DataFrame:
    """Agreement of reading ``b`` with ``a``: notes found, found with the right fret, extra, and bars equal in all notes."""
    left = a.select(*song, *place, F.col(fret).alias("_fa"), F.lit(True).alias("_a"))
    right = b.select(*song, *place, F.col(fret).alias("_fb"), F.lit(True).alias("_b"))
    both = left.join(right, [*song, *place], "full_outer")
    found = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    same = found & F.col("_fa").eqNullSafe(F.col("_fb"))
    bars = both.groupBy(*song, bar).agg(
        F.count_if(F.col("_a").isNotNull()).alias("n"), F.count_if(found).alias("f"), F.count_if(same).alias("r"),
        F.count_if(F.col("_a").isNull()).alias("x"), F.every(same).alias("eq"),
    )
    return bars.groupBy(*song).agg(
        F.sum("n").alias("notes"), F.sum("f").alias("found"), F.sum("r").alias("right_fret"), F.sum("x").alias("extra"),
        F.count("*").alias("bars"), F.count_if("eq").alias("bars_equal"),
    )


def i18n_coverage(texts: DataFrame, key: str, lang: str, text: str, langs: Sequence[str], placeholder: str = r"\{(\w+)\}") -> DataFrame:
    """What is wrong with a translation: missing, empty, or other placeholders than the base language (the first)."""
    per_key = texts.groupBy(key).pivot(lang, list(langs)).agg(F.first(text))
    base = F.array_sort(F.array_distinct(F.regexp_extract_all(F.col(langs[0]), F.lit(placeholder), F.lit(1))))
    checks = []
    for code in langs:
        own = F.array_sort(F.array_distinct(F.regexp_extract_all(F.col(code), F.lit(placeholder), F.lit(1))))
        problem = (
            F.when(F.col(code).isNull(), "missing")
            .when(F.trim(code) == "", "empty")
            .when(F.col(langs[0]).isNotNull() & (own != base), "placeholders")
        )
        checks.append(F.struct(F.lit(code).alias("lang"), problem.alias("problem")))
    rows = per_key.select(key, F.explode(F.array(*checks)).alias("_c"))
    return rows.select(key, "_c.lang", "_c.problem").where("problem is not null")


def shape_diff(items: DataFrame, lang: str, base: str, other: str, version: str, section: str) -> DataFrame:
    """Releases and sections whose number of items differs between two languages."""
    counts = items.groupBy(version, section).agg(
        F.count_if(F.col(lang) == base).alias("base_items"), F.count_if(F.col(lang) == other).alias("other_items")
    )
    return counts.where("base_items <> other_items")


def version_key(version: Column) -> Column:
    return F.transform(F.split(version, r"\."), lambda p: p.cast("int"))


def unseen_releases(releases: DataFrame, version: str, seen: Column) -> DataFrame:
    """Releases newer than the last one seen, by number and not by text."""
    return releases.where(version_key(F.col(version)) > version_key(seen))
