"""Note analytics: sounding notes, chords, hand positions, slides and bends over time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.asof import back_to_points, merged
from ..functions.ordered import Ordered, fill, fill_back, keyed, lag, ordered, total_max


def sounding_notes(notes: DataFrame, keys: Sequence[str], order: str, tie: str, fret: str, length: str, link: str) -> DataFrame:
    """Struck notes with the length of the notes tied to them, and H / P where legato reaches them (key includes the string)."""
    line = ordered(notes, keys, [order]).add(_pf=lag(fret), _pl=lag(link))
    line = line.islands("chain", ~F.col(tie))
    legato = F.when(F.col("_pl").isin("h", "p"), F.when(F.col(fret) >= F.col("_pf"), "H").otherwise("P")).otherwise("")
    data = line.df.withColumn("_legato", legato)
    first = F.min(F.when(~F.col(tie), F.struct(order, fret, "_legato"))).alias("_f")
    chains = data.where("chain > 0").groupBy(*keys, "chain").agg(first, F.sum(length).alias("sustain"))
    return chains.select(*keys, F.col("_f")[order].alias(order), F.col("_f")[fret].alias(fret), F.col("_f._legato").alias("legato"), "chain", "sustain")


# Note names, and chord types by intervals over the root, most usual first.
NOTE_NAMES = ("C", "C#", "D", "Eb", "E", "F", "F#", "G", "Ab", "A", "Bb", "B")
CHORD_TYPES = {
    "": "0,4,7",
    "m": "0,3,7",
    "5": "0,7",
    "7": "0,4,7,10",
    "m7": "0,3,7,10",
    "maj7": "0,4,7,11",
    "sus4": "0,5,7",
    "sus2": "0,2,7",
    "add9": "0,2,4,7",
    "m(add9)": "0,2,3,7",
    "6": "0,4,7,9",
    "m6": "0,3,7,9",
    "7sus4": "0,5,7,10",
    "dim": "0,3,6",
    "aug": "0,4,8",
    "m7b5": "0,3,6,10",
    "dim7": "0,3,6,9",
}


def chord_names(notes: DataFrame, keys: Sequence[str], pitch: str) -> DataFrame:
    """Name of the chord of each key's pitches by exact intervals; the bass as root first, then the usual types; "" for none."""
    pc = F.pmod(F.col(pitch), F.lit(12)).cast("int")
    sets = notes.groupBy(*keys).agg(
        F.array_sort(F.collect_set(pc)).alias("_pcs"), F.pmod(F.min(pitch), F.lit(12)).cast("int").alias("_bass")
    )
    known = F.create_map(*[F.lit(v) for i, shape in enumerate(CHORD_TYPES.values()) for v in (shape, i)])
    names = F.array(*[F.lit(n) for n in CHORD_TYPES])
    roots = F.array(*[F.lit(n) for n in NOTE_NAMES])

    def shape(root: Column) -> Column:
        steps = F.array_sort(F.transform("_pcs", lambda p: F.pmod(p - root, F.lit(12))))
        return F.array_join(F.transform(steps, lambda s: s.cast("string")), ",")

    tried = F.transform(
        "_pcs",
        lambda r: F.struct(
            (F.try_element_at(known, shape(r)) + F.when(r == F.col("_bass"), 0).otherwise(100)).alias("rank"), r.alias("root")
        ),
    )
    best = F.array_min(F.filter(tried, lambda t: t["rank"].isNotNull()))
    slash = F.when(F.col("_best.root") == F.col("_bass"), "").otherwise(F.concat(F.lit("/"), F.get(roots, F.col("_bass"))))
    name = F.concat(F.get(roots, F.col("_best.root")), F.get(names, F.col("_best.rank") % 100), slash)
    out = sets.withColumn("_best", best)
    return out.select(*keys, F.when((F.size("_pcs") >= 2) & F.col("_best").isNotNull(), name).otherwise("").alias("name"))


def chord_spans(notes: DataFrame, keys: Sequence[str], fret: str, dead: Column) -> DataFrame:
    """Frets spanned by the fretted notes struck together (keys include the tick); 1 when alone or open."""
    pressed = F.when((F.col(fret) > 0) & ~dead, F.col(fret))
    spans = notes.groupBy(*keys).agg((F.max(pressed) - F.min(pressed) + 1).alias("_s"))
    return spans.select(*keys, F.coalesce("_s", F.lit(1)).alias("span"))


HAND_BEFORE, HAND_AFTER, HAND_WIDTH, FRETS = 960, 2880, 4, 24  # fixed values: ticks around a note, frets of a hand and a neck


def hand_windows(notes: DataFrame, keys: Sequence[str], tick: str, note_id: str, fret: str, dead: Column) -> DataFrame:
    """Frets the hand covers around each note: at least four, the previous window where nothing is pressed."""
    pressed = notes.withColumn("_f", F.when((F.col(fret) > 0) & ~dead, F.col(fret)))
    first = ordered(pressed, keys, [tick, note_id])
    near = first.ranged(-HAND_BEFORE, HAND_AFTER, _lo="min(_f)", _hi="max(_f)")
    wide = F.when(F.col("_hi") - F.col("_lo") + 1 < HAND_WIDTH, F.least(F.lit(FRETS), F.col("_lo") + HAND_WIDTH - 1)).otherwise(F.col("_hi"))
    window = F.when(F.col("_lo").isNotNull(), F.struct(F.col("_lo").alias("low"), wide.alias("high")))
    line = ordered(near.withColumn("_w", window), keys, [tick, note_id], like=first).add(_in_force=fill("_w"))
    return line.df.select(
        *keys, note_id, tick, F.coalesce(F.col("_in_force")["low"], F.lit(1)).alias("low"),
        F.coalesce(F.col("_in_force")["high"], F.lit(HAND_WIDTH)).alias("high"),
    )


def joined_slides(notes: DataFrame, keys: Sequence[str], tick: str, note_id: str, run: float, least: float, gap: float) -> DataFrame:
    """Slides in that meet the sustained note before them on the string: its fret, the run and the cut trail.

    Notes ``fret, length, slide_in (below / above), dead, bent, slide_out``.
    """
    state = F.struct(F.col(tick).alias("tick"), "fret", "length", "dead", "bent", F.col("slide_out").isNotNull().alias("out"), F.col(note_id).alias("id"))
    line = ordered(notes, keys, [tick, note_id]).add(_b=lag(state))
    b = F.col("_b")
    up = F.col("slide_in") == "below"
    side = F.when(up, b["fret"] < F.col("fret")).otherwise(b["fret"] > F.col("fret"))
    ok = (
        F.col("slide_in").isNotNull() & ~b["dead"] & (b["fret"] > 0) & ~b["bent"] & ~b["out"] & (b["tick"] < F.col(tick)) & side
        & (b["length"] >= least) & (b["tick"] + b["length"] >= F.col(tick) - gap)
    )
    length = F.least(F.lit(run), (F.col(tick) - b["tick"]) / 2)
    found = line.df.where(ok)
    return found.select(
        *keys, note_id, b["id"].alias("from_id"), b["fret"].alias("from_fret"), length.alias("run"),
        (F.col(tick) - length - b["tick"]).alias("cut_ticks"),
    )


def bend_curve(parts: DataFrame, keys: Sequence[str], order: str, tick: str, length: str, points: str, like: Ordered | None = None) -> DataFrame:
    """Points (tick, value) of a chain of tied notes; a part without points keeps the height before it.

    ``points`` is an array of (offset 0..60, value); null or empty for none. Chains nothing bends have no curve.
    """
    line = ordered(parts, keys, [order], like).with_columns(
        _end=F.when(F.size(points) > 0, F.element_at(points, -1)["value"])
    ).add(_before=fill("_end", before=True), _any=total_max(F.coalesce(F.size(points) > 0, F.lit(False)).cast("int")))
    keep = F.coalesce("_before", F.lit(0.0))
    flat = F.array(F.struct(F.lit(0.0).alias("offset"), keep.alias("value")), F.struct(F.lit(60.0).alias("offset"), keep.alias("value")))
    own = F.when(F.size(points) > 0, F.col(points)).otherwise(flat)
    out = keyed(line.df.where("_any = 1"), keys).select(*keys, order, tick, length, F.posexplode(own).alias("pt", "_p"))
    return out.select(*keys, order, "pt", (F.col(tick) + F.col("_p")["offset"] / 60 * F.col(length)).alias("tick"), F.col("_p")["value"].alias("value"))


def bend_at(points: DataFrame, curve: DataFrame, keys: Sequence[str], tick: str, point_id: str, curve_id: str, like: Ordered | None = None) -> DataFrame:
    """Height of a curve at any tick: straight between its points, level outside them."""
    line = merged(points, curve, keys, F.col(tick), point_id, F.col("tick"), curve_id, marks_first=False, like=like)
    line = line.add(_a=fill("_mark"), _b=fill_back("_mark"))
    a, b, x = F.col("_a"), F.col("_b"), F.col("_pos")
    span = b["_at"] - a["_at"]
    between = F.when(span > 0, a["value"] + (b["value"] - a["value"]) * (x - a["_at"]) / span).otherwise(b["value"])
    return back_to_points(line, points, bend=F.when(a.isNull(), b["value"]).when(b.isNull(), a["value"]).otherwise(between))


def bend_class(peak: Column, release_only: Column) -> Column:
    """A bend's strength by its peak in quarter tones: 1 half step, 2 whole step, 3 more; "release" alone."""
    return F.when(release_only, "release").when(peak <= 2, "bend:1").when(peak <= 4, "bend:2").when(peak.isNotNull(), "bend:3").otherwise("")


def peaks(samples: DataFrame, keys: Sequence[str], second: str, amplitude: str, step: float = 0.05) -> DataFrame:
    """Loudest sample of every ``step`` seconds, scaled by the loudest of the file."""
    spots = samples.groupBy(*keys, F.floor(F.col(second) / step).alias("slot")).agg(F.max(F.abs(amplitude)).alias("_p"))
    loudest = spots.groupBy(*keys).agg(F.max("_p").alias("_all"))
    scaled = F.when(F.col("_all") > 0, F.col("_p") / F.col("_all")).otherwise(F.col("_p"))
    return spots.join(loudest, list(keys)).select(*keys, "slot", scaled.alias("peak"))
