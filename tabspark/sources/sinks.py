"""Sinks: nested reports, text previews, catalog bundles and file-ready song tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import number, ordered, running_sum


def nested_report(songs: DataFrame, tracks: DataFrame, song: Sequence[str], track: str) -> DataFrame:
    """One row per song with its tracks as an array in track order, ready for ``write.json``."""
    fields = [c for c in tracks.columns if c not in song]
    nested = tracks.groupBy(*song).agg(F.array_sort(F.collect_list(F.struct(track, *[f for f in fields if f != track]))).alias("tracks"))
    return songs.join(nested, list(song), "left")


MARKS = {48: "W.", 32: "W", 24: "H.", 16: "H", 12: "Q.", 8: "Q", 6: "E.", 4: "E", 3: "S.", 2: "S", 1: "T"}  # fixed values
BARS_A_LINE = 4


def note_cell(fret: Column, dead: Column, tie: Column, harmonic: Column, bend: Column, vibrato: Column) -> Column:
    """How a note is written in the text preview."""
    text = F.when(harmonic, F.concat(F.lit("<"), fret, F.lit(">"))).when(tie, F.concat(F.lit("("), fret, F.lit(")"))).otherwise(fret.cast("string"))
    tail = F.concat(F.when(bend, "b").otherwise(""), F.when(vibrato, "~").otherwise(""))
    return F.when(dead, F.lit("x")).otherwise(F.concat(text, tail))


def render_preview(beats: DataFrame, notes: DataFrame, song: Sequence[str], strings: int, bars: int | None = None) -> DataFrame:
    """Text lines of all bars, or the first ``bars``, four a line: one row per string (string 0 holds the length letters).

    Beats ``bar, beat, units, is_rest, opens, closes`` (repeat signs of their bar, ``closes`` the times or 0); notes
    ``bar, beat, string, cell``. Columns line up: as wide as the beat's widest cell, at least three.
    """
    song = list(song)
    if bars is not None:
        beats, notes = beats.where(F.col("bar") < bars), notes.where(F.col("bar") < bars)
    ends = beats.groupBy(*song, "bar").agg(F.min("beat").alias("_first"), F.max("beat").alias("_last"))
    letters = F.create_map(*[F.lit(v) for item in MARKS.items() for v in item])
    mark = F.try_element_at(letters, F.col("units").cast("int"))
    mark = F.when(F.col("is_rest"), F.lower(mark)).otherwise(mark)
    cells = notes.groupBy(*song, "bar", "beat").agg(
        F.max(F.length("cell")).alias("_wide"), F.map_from_entries(F.collect_list(F.struct(F.col("string").cast("int"), "cell"))).alias("_cells")
    )
    data = beats.join(ends, [*song, "bar"]).join(cells, [*song, "bar", "beat"], "left").withColumn("_mark", mark)
    width = F.greatest(F.lit(3), F.coalesce("_wide", F.lit(0)) + 1, F.length("_mark") + 1)
    data = data.withColumn("_w", width)
    rows = data.withColumn("string", F.explode(F.sequence(F.lit(0), F.lit(strings))))
    cell = F.coalesce(F.try_element_at("_cells", F.col("string")), F.lit(""))
    body = F.when(F.col("string") == 0, F.concat(F.lit(" "), F.rpad("_mark", F.col("_w") - 1, F.lit(" ")))).otherwise(
        F.concat(F.lit("-"), F.rpad(cell, F.col("_w") - 1, F.lit("-")))
    )
    opening = F.when((F.col("beat") == F.col("_first")) & F.col("opens"), F.when(F.col("string") == 0, " ").otherwise(":")).otherwise("")
    times = F.concat(F.lit("x"), F.col("closes").cast("string"))
    closing = (
        F.when(F.col("beat") < F.col("_last"), "")
        .when((F.col("closes") > 0) & (F.col("string") == 0), F.concat(F.lit(" "), times))
        .when(F.col("closes") > 0, F.concat(F.lit("-:|"), F.repeat(F.lit("-"), F.length(times) - 2)))
        .when(F.col("string") == 0, "  ")
        .otherwise("-|")
    )
    pieces = rows.select(*song, F.floor(F.col("bar") / BARS_A_LINE).alias("line"), "string", F.struct("bar", "beat", F.concat(opening, body, closing).alias("t")).alias("_p"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list("_p")), lambda p: p["t"]), "")
    return pieces.groupBy(*song, "line", "string").agg(text.alias("text"))


def export_catalog(catalog: DataFrame, chosen: DataFrame, key: str, order: str, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(songs without their audio, manifest of order and key): all chosen ids or the first ``limit``, unknown and repeated ones skipped."""
    taken = chosen if limit is None else chosen.orderBy(order).limit(limit)
    first = taken.groupBy(key).agg(F.min(order).alias(order))
    songs = catalog.join(first, key).withColumn("files", F.map_filter("files", lambda k, v: k != "audio"))
    return songs, songs.select(order, key)


# Length in 32nds -> note value and whether it is dotted.
NOTE_VALUES = {48: (1, True), 32: (1, False), 24: (2, True), 16: (2, False), 12: (4, True), 8: (4, False), 6: (8, True), 4: (8, False), 3: (16, True), 2: (16, False), 1: (32, False)}
QUARTER_TICKS, MAX_REPEATS = 960, 32


def file_beats(beats: DataFrame, units: str) -> DataFrame:
    """Note value and dot of each beat."""
    values = F.create_map(*[F.lit(v) for u, (n, _) in NOTE_VALUES.items() for v in (u, n)])
    dots = F.create_map(*[F.lit(v) for u, (_, d) in NOTE_VALUES.items() for v in (u, d)])
    u = F.col(units).cast("int")
    return beats.withColumns({"value": F.try_element_at(values, u), "dotted": F.try_element_at(dots, u)})


def file_notes(notes: DataFrame, keys: Sequence[str], dead: str, tie: str) -> DataFrame:
    """Note kind, and per beat (key) whether it is tapped."""
    kind = F.when(F.col(dead), "dead").when(F.col(tie), "tie").otherwise("normal")
    return notes.withColumn("kind", kind)


def file_bars(bars: DataFrame, song: Sequence[str], bar: str, num: str, den: str, times: str, endings: str) -> DataFrame:
    """Start tick, extra passes (-1 for none, at most 31) and volta bits (passes 1..8) of each bar."""
    length = (F.lit(QUARTER_TICKS * 4) * F.col(num) / F.col(den)).cast("long")
    line = ordered(bars.withColumn("_len", length), song, [bar]).add(_before=running_sum("_len", before=True))
    passes = F.filter(F.array_distinct(F.coalesce(F.col(endings), F.array().cast("array<int>"))), lambda n: n.between(1, 8))
    bits = F.aggregate(passes, F.lit(0), lambda acc, n: acc + F.pow(F.lit(2), n - 1).cast("int"))
    return line.df.withColumns(
        {
            "start_tick": F.col("_before") + QUARTER_TICKS,
            "extra_passes": F.when(F.col(times) >= 2, F.least(F.col(times), F.lit(MAX_REPEATS)) - 1).otherwise(-1),
            "volta_bits": bits,
        }
    ).drop("_len", "_before")


def file_tracks(tracks: DataFrame, notes: DataFrame, song: Sequence[str], track: str, fret: str) -> DataFrame:
    """Fret count and MIDI channels of each track, numbered from 1 in the song; channel 9 is left to drums."""
    frets = notes.groupBy(*song, track).agg(F.greatest(F.lit(24), F.max(fret)).alias("fret_count"))
    line = ordered(tracks.join(frets, [*song, track], "left"), song, [track]).add(no=number())
    def channel(at: Column) -> Column:
        return F.when(at < 9, at).otherwise(at + 1)
    first = 2 * (F.col("no") - 1)
    return line.df.withColumns(
        {"fret_count": F.coalesce("fret_count", F.lit(24)), "channel": channel(first), "effect_channel": channel(first + 1)}
    )


def file_text(text: Column, limit: int = 100) -> Column:
    """Text a cp1252 file can hold: control and other characters dropped, trimmed and cut."""
    allowed = r"[^\x20-\x7e -¬®-ÿ€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]"
    return F.left(F.trim(F.regexp_replace(text, allowed, "")), F.lit(limit))
