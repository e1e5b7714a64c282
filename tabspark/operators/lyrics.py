"""Lyrics: syllables placed in bars, the track that carries them and the notes they fall on."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.asof import back_to_points, merged
from ..functions.ordered import Ordered, fill, fill_back, lag, lead, number, ordered, running_max, running_sum, total_count, total_max
from .rhythm import split_units


def place_lyrics(marks: DataFrame, bars: DataFrame, keys: Sequence[str], x: str, mark_id: str, bar: str) -> DataFrame:
    """Bar and place from 0 to 1 of each syllable: before the first bar line at that bar's start, past the last one at its bar's end."""
    line = merged(marks, bars, keys, F.col(x), mark_id, F.col("start"), bar).add(_m=fill("_mark"), _first=fill_back("_mark"))
    m = F.coalesce("_m", "_first")
    width = m["end"] - m["start"]
    place = F.when(width > 0, F.least(F.greatest((F.col("_pos") - m["start"]) / width, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    return back_to_points(line, marks, bar=m[bar], place=place)


def pick_carrier(lyrics: DataFrame, beats: DataFrame, song: Sequence[str], track: str, bar: str, rest: Column) -> DataFrame:
    """The track with most syllables, and the one playing in most of the bars they are sung in (ties: most notes)."""
    sung = lyrics.groupBy(*song, track).agg(F.count("*").alias("_n"))
    source = sung.groupBy(*song).agg(F.max_by(track, F.struct("_n", (-F.col(track)).alias("t"))).alias("source"))
    words = lyrics.join(source, [*song]).where(F.col(track) == F.col("source")).groupBy(*song, bar).agg(F.count("*").alias("_w"))
    played = beats.where(~rest).groupBy(*song, track, bar).agg(F.count("*").alias("_notes"))
    notes = played.groupBy(*song, track).agg(F.sum("_notes").alias("_notes"))
    cover = played.join(words, [*song, bar]).groupBy(*song, track).agg(F.sum("_w").alias("_cover"))
    rank = notes.join(cover, [*song, track], "left").withColumn("_cover", F.coalesce("_cover", F.lit(0)))
    best = rank.groupBy(*song).agg(F.max_by(track, F.struct("_cover", "_notes", (-F.col(track)).alias("t"))).alias("carrier"))
    return source.join(best, list(song), "left")


def assign_lyrics(syllables: DataFrame, beats: DataFrame, song: Sequence[str], order: str, like: Ordered | None = None) -> DataFrame:
    """The played beat each syllable falls on: nearest in its bar, never going back, the rest of a word on the next.

    Syllables ``bar, place, joins`` in ``order``; beats ``bar, place`` (not rests). Syllables of bars without a
    beat have none, unless they finish a word.
    """
    numbered = ordered(beats.select(*song, F.col("bar").cast("long").alias("bar"), "place"), song, ["bar", "place"], like).add(_b=number(), _all=total_count()).df
    numbered = numbered.withColumn("_b", F.col("_b") - 1)
    ends = numbered.groupBy(*song).agg((F.max("_all") - 1).cast("double").alias("_last"))
    s = syllables.select(*song, order, F.col("bar").cast("long").alias("bar"), "place", F.col("joins").alias("_joins"))
    line = merged(s, numbered, [*song, "bar"], F.col("place"), order, F.col("place"), "_b", like=like).add(_lo=fill("_mark"), _hi=fill_back("_mark"))
    low, high = F.col("_lo"), F.col("_hi")
    near_low = high.isNull() | (F.abs(F.col("_pos") - low["_at"]) <= F.abs(high["_at"] - F.col("_pos")))
    best = F.when(near_low, low["_b"]).otherwise(high["_b"])
    found = back_to_points(line, s, _best=best.cast("double"))
    found = found.join(ends, list(song)).withColumn("_sung", F.col("_best").isNotNull())
    # A syllable of a resting bar is sung only while every one since the last bar with beats goes on with its word.
    by_song = ordered(found, song, [order], like).add(_group=running_sum(F.col("_sung").cast("int")))
    line = by_song.refine(["_group"], [order]).add(_ended=running_sum((~F.col("_joins")).cast("int"), before=True))
    sung = F.col("_sung") | ((F.col("_group") > 0) & (F.coalesce("_ended", F.lit(0)) == 0))
    silent = line.df.where(~sung).select(*song, order, "bar", F.col("_joins").alias("joins"), F.lit(None).cast("long").alias("beat"))
    # A word starts at its nearest beat or where the last one ended; each further syllable takes the next beat. So a
    # syllable's beat is the greatest start so far, less the steps before that start, plus all steps up to here.
    words = ordered(line.df.where(sung), song, [order], like=by_song).add(_goes_on=lag("_joins"))
    words = words.with_columns(_step=F.coalesce("_goes_on", F.lit(False)).cast("int")).add(_steps=running_sum("_step"))
    words = words.add(_start=running_max(F.when(F.col("_step") == 0, F.col("_best") - F.col("_steps"))))
    beat = F.least(F.col("_last"), F.col("_start") + F.col("_steps")).cast("long")
    return words.df.select(*song, order, "bar", F.col("_joins").alias("joins"), beat.alias("beat")).unionByName(silent)


def syllable_track(syllables: DataFrame, keys: Sequence[str], order: Sequence[str], place: str, units: int) -> DataFrame:
    """One note per syllable in each bar (key) on a 16th grid, or 32nds in dense text, pushed apart to the right.

    Gives onset and the note's written length; syllables beyond the last slot share the last note: no row is lost.
    """
    line = ordered(syllables, keys, order).add(_i=number(), _n=total_count())
    grid = F.when(F.col("_n") <= units // 2, 2).otherwise(1)
    q = F.least(units - grid, F.rint(F.col(place) * units / grid) * grid)
    line = line.with_columns(_g=grid, _free=q - F.col("_i") * grid).add(_push=running_max("_free"))
    onset = (F.col("_push") + F.col("_i") * F.col("_g")).cast("int")
    line = line.with_columns(onset=onset).add(_top=total_max(F.when(F.col("onset") < units, F.col("onset"))), _next=lead("onset"))
    shared = F.least("onset", "_top")
    end = F.when(F.col("onset") < F.col("_top"), F.col("_next")).otherwise(units)
    length = F.element_at(split_units(end - shared), 1)
    return line.df.withColumns({"onset": shared, "length": length}).drop("_i", "_n", "_g", "_free", "_push", "_next", "_top")


def lyric_line(assigned: DataFrame, keys: Sequence[str], order: str, text: str, joins: str, beat: str) -> DataFrame:
    """The text pieces of a lyric line: "+" joins words on one beat, "-" goes on in the word, a space per beat passed."""
    line = ordered(assigned, keys, [order]).add(_pb=lag(beat), _pj=lag(joins))
    clean = F.regexp_replace(text, r"[\s\[\]+\-]", "")
    gap = F.col(beat) - F.col("_pb")
    before = (
        F.when(F.col("_pb").isNull(), F.lit(""))
        .when((gap == 0) & ~F.col("_pj"), F.lit("+"))
        .when((gap == 0), F.lit(""))
        .when(F.col("_pj"), F.repeat(F.lit(" "), (gap - 1).cast("int")))
        .otherwise(F.repeat(F.lit(" "), gap.cast("int")))
    )
    piece = F.concat(before, clean, F.when(F.col(joins), F.lit("-")).otherwise(F.lit("")))
    return line.df.withColumn("piece", piece).drop("_pb", "_pj")
