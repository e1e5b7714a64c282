"""Rhythm, bars and tracks: onsets, lengths and bar contents. Lengths are 32nd notes; thirds of one when exact."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.asof import back_to_points, merged
from ..functions.ordered import (
    Ordered,
    fill,
    fill_back,
    lag,
    lead,
    number,
    ordered,
    running_max,
    running_sum,
    total_count,
    total_max,
    total_min,
    total_sum,
)
from ..functions.session import checkpoint

# Lengths one beat can have, plain or dotted.
REPRESENTABLE_UNITS = (48, 32, 24, 16, 12, 8, 6, 4, 3, 2, 1)


def split_units(units: Column) -> Column:
    """A length as representable lengths, longest first (array of ints)."""
    start = F.struct(units.cast("int").alias("rest"), F.array().cast("array<int>").alias("parts"))
    split = F.aggregate(
        F.array(*[F.lit(v) for v in REPRESENTABLE_UNITS]),
        start,
        lambda acc, v: F.struct(
            (acc["rest"] % v).alias("rest"),
            F.concat(acc["parts"], F.array_repeat(v, F.floor(acc["rest"] / v).cast("int"))).alias("parts"),
        ),
    )
    return split["parts"]


def pack_into_bars(items: DataFrame, keys: Sequence[str], order: str, units: str, capacity: int) -> DataFrame:
    """Items laid end to end over bars of ``capacity``, cut at bar lines, every part a representable length.

    Parts after an item's first are tied; the last bar is filled with rests (``item`` null).
    """
    line = ordered(items.select(*keys, order, units), keys, [order]).add(
        _start=running_sum(units, before=True), _all=total_sum(units)
    )
    data = line.df.where(F.col(units) > 0)
    end = F.col("_start") + F.col(units)
    bar = F.explode(F.sequence(F.floor(F.col("_start") / capacity), F.floor((end - 1) / capacity)))
    pieces = data.select(*keys, F.col(order).alias("item"), F.col("_start"), end.alias("_end"), bar.alias("bar"))
    low = F.greatest(F.col("_start"), F.col("bar") * capacity)
    high = F.least(F.col("_end"), (F.col("bar") + 1) * capacity)
    notes = pieces.select(
        *keys,
        "item",
        "bar",
        (F.col("bar") > F.floor(F.col("_start") / capacity)).alias("_later"),
        low.alias("_at"),
        F.posexplode(split_units(high - low)).alias("part", "units"),
    )
    notes = notes.select(*keys, "bar", "item", "part", "units", ((F.col("part") > 0) | F.col("_later")).alias("tie"))
    totals = items.groupBy(*keys).agg(F.sum(units).alias("_all")).where(F.col("_all") % capacity > 0)
    rests = totals.select(
        *keys,
        F.floor(F.col("_all") / capacity).alias("bar"),
        F.lit(None).cast("long").alias("item"),
        F.posexplode(split_units(F.lit(capacity) - F.col("_all") % capacity)).alias("part", "units"),
        F.lit(False).alias("tie"),
    )
    return notes.unionByName(rests)


def _triplet_step(units: str, tuplet: str, capacity: int):
    def step(columns, state):
        filled = state[0]
        whole = capacity * 3
        starts, closed = [], []
        for length, three in zip(columns[units].tolist(), columns[tuplet].tolist()):
            starts.append(int(filled))
            filled += 2 * length if three else 3 * length
            bars = 0
            if three:
                if filled >= whole:  # a triplet is never cut: what it has too much is forgotten
                    bars, filled = 1, 0.0
            else:
                bars, filled = int(filled // whole), filled % whole
            closed.append(bars)
        return {"start3": starts, "_closed": closed}, [filled]

    return step


def _placing_step(units: str, tuplet: str, capacity: int):
    """``_triplet_step`` with the bar of each item, for keys that are read in one go."""
    fill = _triplet_step(units, tuplet, capacity)

    def step(columns, state):
        made, (filled,) = fill(columns, state[:1])
        closed = np.asarray(made["_closed"], dtype=np.int64)
        after = int(state[1]) + np.cumsum(closed)
        return {**made, "bar": (after - closed).tolist()}, [filled, float(after[-1])]

    return step


def _fills_after(units: str, tuplet: str, capacity: int):
    """What ``_triplet_step`` leaves of a bar, for many fills at once; plain items in a row are one shift."""

    def exits(columns, fills):
        whole, shift = capacity * 3, 0
        for length, three in zip(columns[units].tolist(), columns[tuplet].tolist()):
            if not three:
                shift += 3 * length
                continue
            fills = (fills + shift) % whole + 2 * length
            fills, shift = np.where(fills >= whole, 0, fills), 0
        return (fills + shift) % whole

    return exits


def _triplet_line(
    items: DataFrame, keys: Sequence[str], order: str, units: str, tuplet: str, capacity: int, like: Ordered | None = None
) -> Ordered:
    """Items with ``start3``, ``bar`` and ``_closed``: the bars that end in them. The fill of a bar has few values, so maps compose."""
    line = ordered(items, keys, [order], like)
    if not line.chunked:
        return line.fold(_placing_step(units, tuplet, capacity), "start3 long, _closed long, bar long", [0.0, 0.0])
    line = line.walk(
        _fills_after(units, tuplet, capacity), _triplet_step(units, tuplet, capacity), "start3 long, _closed long", capacity * 3
    )
    return line.add(bar=running_sum("_closed", before=True))


def pack_triplets(
    items: DataFrame, keys: Sequence[str], order: str, units: str, tuplet: str, capacity: int, like: Ordered | None = None
) -> DataFrame:
    """Bar and place (thirds of a 32nd) where each item begins when some items are triplet notes."""
    return _triplet_line(items, keys, order, units, tuplet, capacity, like).df.drop("_closed")


def pack_triplet_bars(
    items: DataFrame, keys: Sequence[str], order: str, units: str, tuplet: str, capacity: int, like: Ordered | None = None
) -> DataFrame:
    """Bars of whole length from plain and triplet items: each beat's bar, ``at3`` in it (thirds of a 32nd), item, part, units.

    A plain item is cut at bar lines into representable lengths; parts after its first are tied, and a remainder below
    a 32nd, which only an unfinished triplet leaves, sounds in no beat. A triplet note (two thirds of its written length) is never
    cut; the bar it fills ends with it. The last bar is filled with rests (``item`` null). Items without a length
    above 0 are left out; a null ``tuplet`` is a plain one.
    """
    whole = 3 * capacity
    three, length = F.coalesce(F.col(tuplet), F.lit(False)), F.col(units).cast("long")
    rows = items.where(F.col(units) > 0).select(*keys, F.col(order).alias("item"), length.alias("_u"), three.alias("_t"))
    line = checkpoint(_triplet_line(rows, keys, "item", "_u", "_t", capacity, like).df)  # read for triplets, plain items and rests
    start, end = F.col("start3"), F.col("start3") + 3 * F.col("_u")
    final = F.floor((end - 1) / whole)

    triplets = line.where("_t").select(
        *keys, "bar", start.alias("at3"), "item", F.lit(0).alias("part"), F.col("_u").cast("int").alias("units"), F.lit(True).alias("tuplet"), F.lit(False).alias("tie")
    )
    pieces = line.where("not _t").select(*keys, "item", "bar", "start3", end.alias("_end"), F.explode(F.sequence(F.lit(0).cast("long"), final)).alias("_k"))
    low = F.greatest(start, F.col("_k") * whole)
    pieces = pieces.select(
        *keys, "item", (F.col("bar") + F.col("_k")).alias("bar"), (low - F.col("_k") * whole).alias("_at"),
        ((F.col("_k") > 1) | ((F.col("_k") == 1) & (whole - start >= 3))).alias("_later"),
        split_units(F.floor((F.least(F.col("_end"), (F.col("_k") + 1) * whole) - low) / 3)).alias("_parts"),
    )
    spread = pieces.select("*", F.posexplode("_parts").alias("part", "units"))
    before = F.aggregate(F.slice("_parts", 1, F.col("part")), F.lit(0), lambda a, v: a + v)
    notes = spread.select(
        *keys, "bar", (F.col("_at") + 3 * before).alias("at3"), "item", "part", "units", F.lit(False).alias("tuplet"),
        ((F.col("part") > 0) | F.col("_later")).alias("tie"),
    )
    # What the last item leaves open, and the last bar in which anything sounds.
    sounds = F.when(F.col("_t") | (final == 0) | (end - final * whole >= 3), F.col("bar") + F.when(F.col("_t"), 0).otherwise(final))
    last = line.groupBy(*keys).agg(F.max_by(F.struct("bar", "_closed", "start3", "_u", "_t"), "item").alias("_l"), F.max(sounds).alias("_heard"))
    reached = F.col("_l")["start3"] + F.col("_l")["_u"] * F.when(F.col("_l")["_t"], 2).otherwise(3)
    fill = F.when(F.col("_l")["_t"] & (reached >= whole), 0).otherwise(reached % whole)
    bar = F.col("_l")["bar"] + F.col("_l")["_closed"]
    gap = last.select(*keys, bar.alias("bar"), fill.alias("_fill"), "_heard").where((F.col("_fill") > 0) & (F.col("_heard") == F.col("bar")))
    gap = gap.withColumn("_parts", split_units(F.floor((whole - F.col("_fill")) / 3))).select("*", F.posexplode("_parts").alias("part", "units"))
    rests = gap.select(
        *keys, "bar", (F.col("_fill") + 3 * before).alias("at3"), F.lit(None).cast(line.schema["item"].dataType).alias("item"), "part", "units",
        F.lit(False).alias("tuplet"), F.lit(False).alias("tie"),
    )
    return triplets.unionByName(notes).unionByName(rests)


def _in_proportion(line: Ordered, x: str, origin: str, end: str, units: int, name: str) -> Ordered:
    """Proportional onsets of numbered (_i of _n) points: pushed right to stay apart, then kept inside the bar.

    More points than slots are 32nds one after another, which go on over the bar line.
    """
    grid = F.when(F.col("_n") * 2 <= units, 2).otherwise(1)
    span = F.when(F.col(end) > F.col(origin), F.col(end) - F.col(origin)).otherwise(1.0)
    q = F.rint((F.col(x) - F.col(origin)) / span * units / grid) * grid
    q = F.least(F.greatest(q, F.lit(0)), units - grid)
    line = line.with_columns(_g=grid, _free=q - F.col("_i") * grid).add(_push=running_max("_free"))
    pushed = F.col("_push") + F.col("_i") * F.col("_g")
    inside = F.least(pushed, units - (F.col("_n") - F.col("_i") + 1) * F.col("_g"))
    onset = F.when(F.col("_n") > units, F.col("_i") - 1).otherwise(inside).cast("int")
    return line.with_columns(**{name: onset}).map(lambda d: d.drop("_g", "_free", "_push"))


def snap_fallback(points: DataFrame, keys: Sequence[str], x: str, tie: str, origin: str, end: str, units: int) -> DataFrame:
    """Onsets in proportion to the bar's width, pushed right to stay apart, then kept inside the bar.

    A bar with more points than slots gives 32nds one after another: onsets from ``units`` on lie in the bars after it.
    """
    line = ordered(points, keys, [x, tie]).add(_i=number(), _n=total_count())
    return _in_proportion(line, x, origin, end, units, "onset").df.drop("_i", "_n")


GRIDS = ((4, 0.0), (2, 0.05), (1, 0.12))  # fixed values: grid step and its penalty


def quantize(points: DataFrame, keys: Sequence[str], x: str, tie: str, origin: str, end: str, units: int) -> DataFrame:
    """Strictly increasing onsets of each bar's points, by the candidate scale of least cost.

    A gap is taken for 1 to 8 grid steps; a scale must put every point within a quarter step of the grid.
    Bars no scale fits are placed in proportion; with more points than slots they are 32nds over the bar line.
    """
    line = ordered(points, keys, [x, tie]).add(_i=number(), _n=total_count())
    few = line.df.where(F.col("_n") <= units)  # at most `units` points in one array
    bars = few.groupBy(*keys).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("_i", (F.col(x) - F.col(origin)).alias("o")))), lambda p: p["o"]
        ).alias("_xs"),
        (F.max(end) - F.min(origin)).alias("_w"),
    )
    # The filter keeps the sorted array a column of its own instead of being evaluated inside the lambdas below.
    bars = bars.where(F.size("_xs") > 0)
    pairs = F.zip_with(F.slice("_xs", 1, F.size("_xs") - 1), F.slice("_xs", 2, F.size("_xs") - 1), lambda a, b: b - a)
    gaps = F.when(F.size("_xs") > 1, F.array_distinct(F.transform(F.filter(pairs, lambda g: g > 0), lambda g: F.bround(g, 1))))
    bars = bars.withColumn("_gaps", F.coalesce(gaps, F.array().cast("array<double>")))
    own = F.when(F.col("_w") > 0, F.array(units / F.col("_w"))).otherwise(F.array().cast("array<double>"))
    steps = F.sequence(F.lit(1), F.lit(8))
    grids = F.filter(
        F.array(*[F.struct(F.lit(g).alias("g"), F.lit(p).alias("p")) for g, p in GRIDS]), lambda grid: F.size("_xs") * grid["g"] <= units
    )

    def scales(grid: Column) -> Column:
        by_gap = F.flatten(F.transform("_gaps", lambda gap: F.transform(steps, lambda k: grid["g"] * k / gap)))
        found = F.array_distinct(F.concat(own, by_gap))
        return F.transform(found, lambda s: F.struct(grid["g"].alias("g"), grid["p"].alias("p"), s.alias("s")))

    def placed(c: Column) -> Column:
        return F.struct(c["g"].alias("g"), c["p"].alias("p"), c["s"].alias("s"), F.transform("_xs", lambda o: o * c["s"] / c["g"]).alias("spots"))

    def stepped(c: Column) -> Column:
        return F.struct(
            c["g"].alias("g"), c["p"].alias("p"), c["s"].alias("s"), F.transform(c["spots"], lambda x: F.rint(x)).alias("steps"),
            F.array_max(F.transform(c["spots"], lambda x: F.abs(x - F.rint(x)))).alias("error"),
        )

    def fits(c: Column) -> Column:
        rises = F.aggregate(
            c["steps"],
            F.struct(F.lit(float("-inf")).alias("last"), F.lit(True).alias("ok")),
            lambda acc, q: F.struct(q.alias("last"), (acc["ok"] & (q > acc["last"])).alias("ok")),
        )["ok"]
        inside = (F.element_at(c["steps"], 1) >= 0) & (F.element_at(c["steps"], -1) * c["g"] <= units - c["g"])
        return (c["error"] <= 0.25) & inside & rises

    def ranked(c: Column) -> Column:
        cost = F.abs(F.col("_w") * c["s"] - units) / units + 0.5 * c["error"] + c["p"]
        onsets = F.transform(c["steps"], lambda q: (q * c["g"]).cast("int"))
        return F.struct(cost.alias("cost"), (-c["g"]).alias("g"), c["s"].alias("s"), onsets.alias("onsets"))

    tried = F.transform(F.transform(F.flatten(F.transform(grids, scales)), placed), stepped)
    best = bars.select(*keys, F.array_min(F.transform(F.filter(tried, fits), ranked))["onsets"].alias("_on")).where("_on is not null")
    placed_all = _in_proportion(line, x, origin, end, units, "_fallback").df.join(best, list(keys), "left")
    onset = F.coalesce(F.get("_on", F.col("_i").cast("int") - 1), F.col("_fallback"))
    return placed_all.select(*points.columns, onset.alias("onset"))


def choose_rhythm(
    columns: DataFrame, keys: Sequence[str], order: str, notated3: str, estimated: str, units: int, bare: Column | None = None
) -> DataFrame:
    """Notated lengths where they fill the bar (key) exactly, else the estimated ones.

    ``bare`` holds where a line prints no rhythm although its part does: a bar with one note and no length there is a whole
    bar, which counts as notated. An estimated bar with more notes than it has 32nds gives each a 32nd (``crowded``).
    """
    line = ordered(columns, keys, [order]).add(
        _sum=total_sum(notated3), _missing=total_sum(F.col(notated3).isNull().cast("int")), _n=total_count()
    )
    exact = (F.col("_missing") == 0) & (F.col("_sum") == units * 3)
    lone = F.coalesce((F.col("_n") == 1) & (F.col("_missing") == 1) & bare, F.lit(False)) if bare is not None else F.lit(False)
    crowded = ~exact & ~lone & (F.col("_n") > units)
    chosen = F.when(exact, F.col(notated3)).when(lone, units * 3).when(crowded, 3).otherwise(F.col(estimated) * 3)
    return line.df.withColumns({"len3": chosen, "estimated": ~exact & ~lone, "crowded": crowded}).drop("_sum", "_missing", "_n")


def rhythm_counters(chosen: DataFrame, part: Sequence[str], bar: Sequence[str]) -> DataFrame:
    """Bars with notes of each part whose lengths were notated, and estimated."""
    bars = chosen.groupBy(*part, *bar).agg(F.bool_or("estimated").alias("_e"))
    return bars.groupBy(*part).agg(F.count_if(~F.col("_e")).alias("notated"), F.count_if("_e").alias("estimated"))


def expand_rest_bars(bars: DataFrame, keys: Sequence[str], order: str, number_: str, empty: Column, printed: Column) -> DataFrame:
    """Empty bars as the bars they stand for: up to the next printed number (2..64), else the printed count, else 1."""
    line = ordered(bars, keys, [order]).add(_next=lead(number_))
    gap = F.col("_next") - F.col(number_)
    span = F.when(~empty, 1).when(gap.between(2, 64), gap).otherwise(F.coalesce(printed, F.lit(1)))
    out = line.df.withColumn("_span", span.cast("int")).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("_span") - 1)))
    return out.withColumn("number", F.when((F.col("copy") == 0) | empty, F.col(number_) + F.col("copy"))).drop("_next", "_span")


def fixed_rhythm(columns: DataFrame, keys: Sequence[str], order: str, bar_lines: str, value: int, capacity: int) -> DataFrame:
    """Fixed lengths for the songs where a line has fewer than two bar lines."""
    songs = columns.groupBy(*keys).agg(F.every(F.col(bar_lines) >= 2).alias("_barred")).where(~F.col("_barred"))
    loose = columns.join(songs.select(*keys), list(keys), "left_semi").withColumn("_u", F.lit(32 // value))
    return pack_into_bars(loose, keys, order, "_u", capacity)


def bar_attributes(bars: DataFrame, marks: DataFrame, keys: Sequence[str], bar: str, tol: float) -> DataFrame:
    """Printed signature, tempo, section names, signs and jumps of each bar; the signature stays in force.

    Bars ``start, end``; marks ``mid, x, kind, sval, ival``. Jumps and "Fine" belong to the bar before them
    (within ``tol``), and past the last bar line to the last bar.
    """
    at_end = F.col("kind").isin("jump") | ((F.col("kind") == "sign") & (F.col("sval") == "Fine"))
    place = F.when(at_end, F.col("x") - tol).otherwise(F.col("x"))
    line = merged(marks, bars, keys, place, "mid", F.col("end"), bar).add(
        _next=fill_back("_mark", after=True), _prev=fill("_mark")
    )
    placed = back_to_points(line, marks, _late=F.col("_prev")[bar], _bar=F.col("_next")[bar])
    placed = placed.withColumn("_bar", F.coalesce("_bar", F.when(at_end, F.col("_late")))).where("_bar is not null")

    def latest(value: str, what: Column) -> Column:
        return F.max_by(value, F.when(what, F.struct("x", "mid")))

    k = F.col("kind")
    per_bar = placed.groupBy(*keys, F.col("_bar").alias(bar)).agg(
        latest("ival", k == "signature").alias("_sig"),
        latest("ival", k == "tempo").alias("tempo"),
        latest("sval", k == "sign").alias("sign"),
        latest("sval", k == "jump").alias("jump"),
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.when(k == "section", F.struct("x", "mid", "sval")))), lambda m: m["sval"]
            ),
            " / ",
        ).alias("marker"),
    )
    full = ordered(bars.join(per_bar, [*keys, bar], "left"), keys, [bar]).add(signature=fill("_sig"))
    return full.df.drop("_sig").withColumn("marker", F.nullif("marker", F.lit("")))


def fill_ties(beats: DataFrame, keys: Sequence[str], order: str, tied: Column, rest: Column, notes: str) -> DataFrame:
    """Beats that only continue copy the notes sounding before them; a rest ends what was ringing."""
    sounding = F.when(~tied, F.struct(F.when(~rest, F.col(notes)).alias("n")))
    line = ordered(beats, keys, [order]).with_columns(_s=sounding).add(_before=fill("_s"))
    return line.df.withColumn("sounding", F.when(tied, F.col("_before")["n"]).otherwise(F.col(notes))).drop("_s", "_before")


def resolve_links(notes: DataFrame, keys: Sequence[str], beat: str, fret: str, paren: str, arc: str, link: str, dead: str) -> DataFrame:
    """Ties, ghosts and where hammers, pulls and slides start, from the previous note of the string (key includes it)."""
    line = ordered(notes, keys, [beat]).add(_p=lag(F.struct(beat, fret, dead)), _next_link=lead(link))
    p = F.col("_p")
    held = p.isNotNull() & ~p[dead] & (p[fret] == F.col(fret)) & (p[beat] == F.col(beat) - 1)
    held = F.coalesce(held, F.lit(False))
    tie = F.col(paren) & held & F.coalesce(F.col(arc), F.lit(True))
    start = F.when(F.col("_next_link").isin("h", "p"), "hammer").when(F.col("_next_link") == "sl", "shift").when(
        F.col("_next_link").isNotNull(), "slide"
    )
    return line.df.withColumns(
        {"tie": tie, "ghost": F.col(paren) & ~tie, "starts": F.when(~F.col(dead), start)}
    ).drop("_p", "_next_link")


def hold_bends(notes: DataFrame, keys: Sequence[str], order: str, tie: str, bend: str, release: str) -> DataFrame:
    """Bends held over ties: a tied note keeps the bend in force unless the note before it released it.

    A bent tie goes on with the bend in force (``pre_bend``), if there is one: a tie that neither bends nor holds ends it.
    """
    line = ordered(notes, keys, [order]).add(_pr=lag(release))
    ended = F.coalesce("_pr", F.lit(True))
    own = F.when(~F.col(tie) | (F.col(bend) > 0), F.col(bend)).when(ended, F.lit(0))
    line = line.with_columns(_k=own).add(_b=fill("_k", before=True))
    going = F.coalesce(F.col(tie) & (F.col("_b") > 0), F.lit(False))
    held = going & (F.col(bend) == 0) & ~ended
    again = going & (F.col(bend) > 0)
    return line.df.withColumns({"held_bend": F.when(held, F.col("_b")).otherwise(F.col(bend)), "pre_bend": held | again}).drop("_k", "_b", "_pr")


def carry_forward(
    notes: DataFrame, marks: DataFrame, keys: Sequence[str], pos: Column, note_id: str, mark_pos: Column, mark_id: str, value: str, tol: float
) -> DataFrame:
    """The state in force at each note: the last mark up to ``tol`` after it."""
    line = merged(notes, marks, keys, pos + tol, note_id, mark_pos, mark_id).add(_m=fill("_mark"))
    return back_to_points(line, notes, state=F.col("_m")[value])


LEVELS = (15, 127)  # fixed values: softest and loudest level, 16 apart


def _ramp_step(columns, state):
    level = state[0]
    starts, ends = [], []
    for value, direction, after in zip(columns["_value"].tolist(), columns["_dir"].tolist(), columns["_after"].tolist()):
        start = level
        if direction == 0:
            level = value
        elif after == after:
            level = after
        else:
            level = min(max(level + 32 * direction, LEVELS[0]), LEVELS[1])
        starts.append(start)
        ends.append(level)
    return {"_from": starts, "_to": ends}, [level]


def ramps(
    notes: DataFrame, pins: DataFrame, marks: DataFrame, keys: Sequence[str], slack: float, reach: float, default: int = 95
) -> DataFrame:
    """Levels of the notes hairpins cover: from the level in force to the next mark's, else two levels up or down.

    Positions are distances along the song: notes ``nid, x``; pins ``pid, x0, x1, direction`` (pieces of one
    hairpin meet within ``reach``); marks ``mid, x, value``. A ramp's level goes on until the next mark.
    """
    line = ordered(pins, keys, ["x0", "pid"]).add(_pe=lag("x1"), _pd=lag("direction"))
    same = (F.col("_pd") == F.col("direction")) & (F.col("x0") - F.col("_pe") <= reach)
    line = line.islands("_ramp", ~F.coalesce(same, F.lit(False)))
    whole = line.df.groupBy(*keys, "_ramp").agg(
        F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("direction").alias("direction"), F.sum(F.col("x1") - F.col("x0")).alias("_len")
    )
    nxt = merged(whole, marks, keys, F.col("x1") - 2 * slack, "_ramp", F.col("x"), "mid", marks_first=False).add(_n=fill_back("_mark"))
    near = F.col("_n")["_at"] - F.col("_row")["x1"] <= reach
    whole = back_to_points(nxt, whole, _after=F.when(near, F.col("_n")["value"].cast("double")))
    steps = whole.select(
        *keys, (F.col("x0") + 2 * slack).alias("_at"), F.lit(1).alias("_side"), F.col("_ramp").alias("_id"),
        F.lit(0.0).alias("_value"), F.col("direction").cast("double").alias("_dir"), "_after",
    ).unionByName(
        marks.select(
            *keys, F.col("x").cast("double").alias("_at"), F.lit(0).alias("_side"), F.col("mid").alias("_id"),
            F.col("value").cast("double").alias("_value"), F.lit(0.0).alias("_dir"), F.lit(None).cast("double").alias("_after"),
        )
    )
    levels = ordered(steps, keys, ["_at", "_side", "_id"]).fold(_ramp_step, "_from double, _to double", [float(default)]).df
    levels = levels.where("_side = 1").select(*keys, F.col("_id").alias("_ramp"), "_from", "_to")
    pieces = line.df.select(*keys, "_ramp", "pid", "x0", "x1")
    done = ordered(pieces, [*keys, "_ramp"], ["x0", "pid"], like=line).add(_done=running_sum(F.col("x1") - F.col("x0"), before=True)).df
    pieces = done.join(levels.join(whole.select(*keys, "_ramp", "_len"), [*keys, "_ramp"]), [*keys, "_ramp"])
    at = merged(notes, pieces, keys, F.col("x") + slack, "nid", F.col("x0"), "pid").add(_p=fill("_mark"))
    p, x = F.col("_p"), F.col("_row")["x"]
    t = F.least(F.greatest((p["_done"] + x - p["x0"]) / p["_len"], F.lit(0.0)), F.lit(1.0))
    level = p["_from"] + (p["_to"] - p["_from"]) * t
    snapped = LEVELS[0] + 16 * F.rint((level - LEVELS[0]) / 16)
    return back_to_points(at, notes, level=F.when(x <= p["x1"], snapped.cast("int")))


def fit_bar(beats: DataFrame, keys: Sequence[str], order: str, units: str, capacity: int) -> DataFrame:
    """Beats of each bar (key) cut or filled to ``capacity``: the first that overflows is shortened, later ones go.

    Filling rests have no beat; ``cut`` marks what did not fit.
    """
    line = ordered(beats.select(*keys, order, units), keys, [order]).add(_end=running_sum(units))
    begin = F.col("_end") - F.col(units)
    data = line.df.withColumn("_begin", begin)
    whole = data.where(F.col("_end") <= capacity).select(
        *keys, F.col(order).alias("beat"), F.lit(0).alias("part"), F.col(units).alias("units"), F.lit(False).alias("cut")
    )
    over = data.where((F.col("_end") > capacity) & (F.col("_begin") < capacity))
    short = over.select(
        *keys, F.col(order).alias("beat"), F.posexplode(split_units(capacity - F.col("_begin"))).alias("part", "units"), F.lit(True).alias("cut")
    )
    short = short.withColumn("beat", F.when(F.col("part") == 0, F.col("beat")))
    totals = beats.groupBy(*keys).agg(F.sum(units).alias("_all")).where(F.col("_all") < capacity)
    pad = totals.select(
        *keys, F.lit(None).cast("long").alias("beat"), F.posexplode(split_units(capacity - F.col("_all"))).alias("part", "units"), F.lit(False).alias("cut")
    )
    return whole.unionByName(short).unionByName(pad)


def align_by_number(bars: DataFrame, keys: Sequence[str], order: str, number_: str) -> DataFrame:
    """Each bar at its printed number, gaps as rest bars (``order`` null).

    Kept as they are: songs with under 80 % numbered bars, a number beyond 2n + 64, or numbers not increasing.
    """
    line = ordered(bars.select(*keys, order, number_), keys, [order]).add(_i=number())
    base = F.when(F.col(number_).isNotNull(), F.col(number_) - F.col("_i"))
    line = line.with_columns(_base=base).add(_shift=fill("_base"))
    at = F.col("_i") + F.coalesce("_shift", F.lit(0))
    line = line.with_columns(_at=at).add(_prev=lag("_at"))
    step = F.col("_at") - F.coalesce("_prev", F.lit(0))
    line = line.with_columns(_step=step).add(
        _n=total_count(), _known=total_sum(F.col(number_).isNotNull().cast("int")), _max=total_max(number_), _least=total_min("_step")
    )
    trusted = (F.col("_known") >= 0.8 * F.col("_n")) & (F.col("_max") <= 2 * F.col("_n") + 64) & (F.col("_least") > 0)
    data = line.df.withColumn("_ok", F.coalesce(trusted, F.lit(False)))
    kept = data.select(*keys, F.col(order), F.when(F.col("_ok"), F.col("_at")).otherwise(F.col("_i")).alias("position"))
    gaps = data.where(F.col("_ok") & (F.col("_step") > 1)).select(
        *keys, F.lit(None).cast("long").alias(order), F.explode(F.sequence(F.col("_at") - F.col("_step") + 1, F.col("_at") - 1)).alias("position")
    )
    return kept.unionByName(gaps)


def pad_tracks(bars: DataFrame, song: Sequence[str], track: str, bar: str) -> DataFrame:
    """Rest bars that make every track as long as the song's longest."""
    ends = bars.groupBy(*song, track).agg(F.max(bar).alias("_last"))
    longest = ends.groupBy(*song).agg(F.max("_last").alias("_all"))
    short = ends.join(longest, list(song)).where("_last < _all")
    return short.select(*song, track, F.explode(F.sequence(F.col("_last") + 1, F.col("_all"))).alias(bar))


def unify_bars(bars: DataFrame, song: Sequence[str], bar: str, track: str, like: Ordered | None = None) -> DataFrame:
    """One signature, repeat, volta, tempo, sign and jump per bar of a song.

    The first track that has a value gives it; the signature goes on until the next. Columns ``signature,
    repeat_open, repeat_times, endings, tempo, sign, jump``; ``endings`` empty as null.
    """

    def first(value: str) -> Column:
        return F.min_by(value, F.when(F.col(value).isNotNull(), F.col(track))).alias(value)

    per_bar = bars.groupBy(*song, bar).agg(
        first("signature"),
        F.bool_or("repeat_open").alias("repeat_open"),
        F.max("repeat_times").alias("repeat_times"),
        first("endings"),
        first("tempo"),
        first("sign"),
        first("jump"),
    )
    line = ordered(per_bar, song, [bar], like).add(_sig=fill("signature"))
    return line.df.withColumn("signature", F.col("_sig")).drop("_sig")


def tidy_navigation(
    bars: DataFrame, song: Sequence[str], bar: str, tempo: str, sign: str, jump: str, initial: Column, like: Ordered | None = None
) -> tuple[DataFrame, DataFrame]:
    """(bars with real tempo changes and each mark once, marks left out with their bar)."""
    line = ordered(bars, song, [bar], like).add(_before=fill(tempo, before=True))
    changed = F.when(F.col(tempo).isNotNull() & (F.col(tempo) != F.coalesce("_before", initial)), F.col(tempo))
    data = line.df.withColumn("tempo_change", changed).drop("_before")
    marks = data.select(*song, bar, F.posexplode(F.array(sign, jump)).alias("_rank", "_name")).where("_name is not null")
    firsts = marks.groupBy(*song, "_name").agg(F.min(F.struct(bar, "_rank")).alias("_first"))
    seen = marks.join(firsts, [*song, "_name"])
    dropped = seen.where(F.struct(bar, "_rank") != F.col("_first")).select(*song, bar, F.col("_name").alias("name"))
    kept = firsts.select(*song, F.col("_first")[bar].alias(bar), "_name", F.col("_first._rank").alias("_rank"))
    kept = kept.groupBy(*song, bar).agg(
        F.max(F.when(F.col("_rank") == 0, F.col("_name"))).alias("kept_sign"),
        F.max(F.when(F.col("_rank") == 1, F.col("_name"))).alias("kept_jump"),
    )
    return data.join(kept, [*song, bar], "left"), dropped


def drop_opening(marks: DataFrame, keys: Sequence[str], order: Sequence[str], opening: Column) -> DataFrame:
    """Marks without the key's first one of the kind ``opening`` tells."""
    firsts = marks.where(opening).groupBy(*keys).agg(F.min(F.struct(*order)).alias("_f"))
    return marks.join(firsts, list(keys), "left").where(
        ~F.coalesce(opening & (F.struct(*order) == F.col("_f")), F.lit(False))
    ).drop("_f")
