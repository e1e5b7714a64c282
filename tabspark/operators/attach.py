"""Annotations attached to notes: nearest, covering and following marks, without building pairs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.asof import asof, back_to_points, close_pairs, covered, merged, nearest
from ..functions.ordered import Ordered, fill, fill_back, gathered, keyed, lag, lead, meet, ordered, running_max, running_sum, total_max, total_min, total_sum
from ..functions.session import checkpoint
from .layout import anchored_groups


def nearest_exclusive(
    columns: DataFrame,
    stems: DataFrame,
    keys: Sequence[str],
    pos: str,
    column_id: str,
    stem_pos: str,
    stem_id: str,
    tol: float,
) -> DataFrame:
    """Each column's nearest stem; two columns on one stem refuse the whole bar (key).

    ``kind`` tells matched columns, columns without a stem (whole notes) and stems no column took (continuations).
    """
    stems = stems.select(*keys, stem_pos, F.col(stem_id).alias("_sid"))
    found = nearest(
        columns.select(*keys, pos, column_id), stems, keys, F.col(pos), column_id, F.col(stem_pos), "_sid",
        {"right_id": "_sid"}, "dist", tol,
    )
    taken = found.where(F.col("right_id").isNotNull()).groupBy(*keys, "right_id").agg(F.count("*").alias("_n"))
    refused = taken.groupBy(*keys).agg((F.max("_n") > 1).alias("refused"))
    kind = F.when(F.col("right_id").isNull(), "whole").otherwise("stem")
    matched = found.select(*keys, F.col(column_id).alias("left_id"), "right_id", "dist", kind.alias("kind"))
    free = stems.join(taken.withColumnRenamed("right_id", "_sid"), [*keys, "_sid"], "left_anti").select(
        *keys, F.lit(None).cast("long").alias("left_id"), F.col("_sid").alias("right_id"),
        F.lit(None).cast("double").alias("dist"), F.lit("continued").alias("kind"),
    )
    both = matched.unionByName(free).join(refused, list(keys), "left")
    return both.withColumn("refused", F.coalesce("refused", F.lit(False)))


def snap(
    points: DataFrame, bars: DataFrame, keys: Sequence[str], pos: str, point_id: str, bar_pos: str, bar_id: str, limit: float,
    like: Ordered | None = None,
) -> DataFrame:
    """The nearest bar line of each point, null beyond ``limit``."""
    return nearest(points, bars, keys, F.col(pos), point_id, F.col(bar_pos), bar_id, {"bar_x": bar_pos}, "dist", limit, like)


def repeat_signs(
    dots: DataFrame, bars: DataFrame, keys: Sequence[str], x: str, dot_id: str, bar_x: str, bar_id: str, spacing: float,
    like: Ordered | None = None,
) -> DataFrame:
    """Bar lines that open or close a repeat: two or more aligned dots right or left of them."""
    columns = anchored_groups(dots, keys, x, dot_id, 0.5 * spacing, like=like).groupBy(*keys, "group_no").agg(
        F.min(x).alias("_x"), F.count("*").alias("_n")
    )
    signs = snap(columns.where("_n >= 2"), bars, keys, "_x", "group_no", bar_x, bar_id, 2 * spacing, like)
    kind = F.when(F.col("_x") > F.col("bar_x"), "open").otherwise("close")
    return signs.where(F.col("bar_x").isNotNull()).select(*keys, "bar_x", kind.alias("kind")).distinct()


def apply_ranges(
    notes: DataFrame, ranges: DataFrame, keys: Sequence[str], pos: str, note_id: str, start: Column, end: Column, range_id: str
) -> DataFrame:
    """Whether a dashed range (palm mute, let ring, harmonics) or vibrato line covers each note."""
    return covered(notes, ranges, keys, F.col(pos), note_id, start, end, range_id, "covered")


def grow_range(
    marks: DataFrame, dashes: DataFrame, keys: Sequence[str], x1: str, mark_id: str, d0: str, d1: str, dash_id: str, reach: float,
    like: Ordered | None = None,
) -> DataFrame:
    """End of each mark's range: over the dashes that follow while the gap is at most ``reach``."""
    line = ordered(dashes, keys, [d0, dash_id], like).add(_far=running_max(d1, before=True))
    line = line.islands("_run", F.col("_far").isNull() | (F.col(d0) - F.col("_far") > reach))
    runs = line.refine(["_run"], [d0, dash_id]).add(_to=total_max(d1)).df
    starts = keyed(runs, keys).select(*keys, d0, dash_id, "_to")
    near = merged(marks, starts, keys, F.col(x1) - 1.0, mark_id, F.col(d0), dash_id, marks_first=False, like=like)
    near = near.add(_next=fill_back("_mark"))
    row, nxt = F.col("_row"), F.col("_next")
    grown = F.when(nxt[d0] - row[x1] <= reach, F.greatest(row[x1], nxt["_to"])).otherwise(row[x1])
    return back_to_points(near, marks, range_end=grown)


def nearest_owner(
    marks: DataFrame, staves: DataFrame, keys: Sequence[str], y: str, mark_id: str, edge: str, staff_id: str, reach: float
) -> DataFrame:
    """The staff whose edge is the last one above each mark, strictly and within ``reach``."""
    line = merged(marks, staves, keys, F.col(y), mark_id, F.col(edge), staff_id, marks_first=False)
    line = line.add(_s=fill("_mark"))
    gap = F.col("_pos") - F.col("_s")["_at"]
    ok = (gap > 0) & (gap < reach)
    return back_to_points(line, marks, owner=F.when(ok, F.col("_s")[staff_id]), distance=F.when(ok, gap))


def between_pair(
    marks: DataFrame, notes: DataFrame, keys: Sequence[str], x: str, mark_id: str, string: str, note_x: str, note_id: str, span: float
) -> DataFrame:
    """The pair of neighbouring notes of one string each mark stands between, at least cost.

    Cost is the distance from the middle plus half the span; pairs wider than ``span`` do not count.
    """
    strings = notes.select(*keys, string).distinct()
    spread = marks.select(*keys, x, mark_id).join(strings, list(keys))
    line = merged(spread, notes.select(*keys, string, note_x, note_id), [*keys, string], F.col(x), mark_id, F.col(note_x), note_id)
    line = line.add(_a=fill("_mark"), _b=fill_back("_mark"))
    low, high = F.col("_a")["_at"], F.col("_b")["_at"]
    wide = high - low
    rows = line.df.where(F.col("_row").isNotNull() & (low < F.col("_pos")) & (F.col("_pos") < high) & (wide <= span))
    cost = F.abs((low + high) / 2 - F.col("_pos")) + 0.5 * wide
    pair = F.struct(cost.alias("cost"), string, F.col("_a")[note_id].alias("first_id"), F.col("_b")[note_id].alias("second_id"))
    best = rows.select(*keys, F.col("_row")[mark_id].alias(mark_id), pair.alias("_p")).groupBy(*keys, mark_id).agg(
        F.min("_p").alias("_p")
    )
    return best.select(*keys, mark_id, "_p.*")


def isolated(glyphs: DataFrame, keys: Sequence[str], x0: str, x1: str, tie: str, k: float = 0.5) -> DataFrame:
    """Glyphs that no other glyph of the line touches: none begins less than ``k`` of their width after them or ends as little before them.

    Not only neighbours in the order of starts count: glyphs may overlap. ``tie`` tells glyphs of a line apart.
    """
    marks = glyphs.select(*keys, tie, F.col(x0).alias("_m0"), F.col(x1).alias("_m1"))
    after = merged(glyphs, marks, keys, F.col(x1), tie, F.col("_m0"), tie, marks_first=False).add(_n=fill_back("_mark"))
    seen = back_to_points(after, glyphs, _right=F.col("_n")["_m0"])
    before = merged(seen, marks, keys, F.col(x0), tie, F.col("_m1"), tie).add(_p=fill("_mark"))
    width = k * (F.col(x1) - F.col(x0))
    touching = (F.col("_right") - F.col(x1) < width) | (F.col(x0) - F.col("_left") < width)
    out = back_to_points(before, seen, _left=F.col("_p")["_m1"])
    return out.where(~F.coalesce(touching, F.lit(False))).drop("_left", "_right")


def attach_next(
    marks: DataFrame, notes: DataFrame, keys: Sequence[str], x: str, mark_id: str, note_x: str, note_id: str,
    value: str, reach: float, column: float,
) -> DataFrame:
    """A mark (strum arrow, grace note) goes to the column of notes next to its right, within ``reach``."""
    line = merged(marks, notes.select(*keys, note_x, note_id), keys, F.col(x), mark_id, F.col(note_x), note_id)
    line = line.add(_n=fill_back("_mark", after=True))
    aimed = back_to_points(line, marks, _to=F.col("_n")["_at"])
    aimed = aimed.where((F.col("_to") - F.col(x) > 0) & (F.col("_to") - F.col(x) <= reach))
    aimed = aimed.select(*keys, "_to", x, mark_id, value)
    got = merged(notes, aimed, keys, F.col(note_x), note_id, F.col("_to"), mark_id).add(_m=fill("_mark"))
    at, mark = F.col("_pos"), F.col("_m")
    ok = (at - mark["_to"] <= column) & (at - mark[x] <= reach)
    return back_to_points(got, notes, attached=F.when(ok, mark[value]))


def slides(
    strokes: DataFrame, notes: DataFrame, arcs: DataFrame, keys: Sequence[str], spacing: float, like: Ordered | None = None
) -> DataFrame:
    """Oblique strokes beside fret numbers: legato or shift slide between two notes, slide in or out at one.

    Strokes, notes and arcs carry their string; strokes ``x0, x1, rising, sid``, notes ``x, half, nid``, arcs ``x0, x1, aid``.
    """
    near, far = 0.3 * spacing, 0.8 * spacing
    right_edge = notes.withColumn("_r", F.col("x") + F.col("half"))
    left_edge = notes.withColumn("_l", F.col("x") - F.col("half"))
    before = merged(strokes, right_edge, keys, F.col("x0") + near, "sid", F.col("_r"), "nid", like=like).add(_b=fill("_mark"))
    gap = F.col("_row")["x0"] - F.col("_b")["_r"]
    found = back_to_points(
        before, strokes, before_id=F.when(gap <= far, F.col("_b")["nid"]), _bx=F.when(gap <= far, F.col("_b")["x"])
    )
    after = merged(found, left_edge, keys, F.col("x1") - near, "sid", F.col("_l"), "nid", marks_first=False, like=like)
    after = after.add(_a=fill_back("_mark"))
    gap = F.col("_a")["_l"] - F.col("_row")["x1"]
    found = back_to_points(
        after, found, after_id=F.when(gap <= far, F.col("_a")["nid"]), _ax=F.when(gap <= far, F.col("_a")["x"])
    )
    found = checkpoint(found)  # read for the slides and for their arcs
    # An arc over both ends makes the slide legato.
    both = found.where("before_id is not null and after_id is not null").select(*keys, "sid", "_bx", "_ax")
    over = close_pairs(both, arcs.select(*keys, "x0", "x1"), keys, (F.col("_bx"), F.col("_ax")), (F.col("x0"), F.col("x1")), far)
    slurred = over.select(*keys, F.col("l")["sid"].alias("sid"), F.lit(True).alias("_slur")).distinct()
    found = found.join(slurred, [*keys, "sid"], "left").withColumn("_slur", F.coalesce("_slur", F.lit(False)))
    b, a = F.col("before_id").isNotNull(), F.col("after_id").isNotNull()
    short = F.col("x1") - F.col("x0") <= 2.5 * spacing
    kind = (
        F.when(b & a & F.col("_slur"), "legato")
        .when(b & a, "shift")
        .when(b & short, F.when(F.col("rising"), "out_up").otherwise("out_down"))
        .when(a & short, F.when(F.col("rising"), "in_below").otherwise("in_above"))
    )
    return found.withColumn("kind", kind).where(F.col("kind").isNotNull()).select(*keys, "sid", "before_id", "after_id", "kind")


BEND_AMOUNTS = {"1/2": 1, "1": 2, "full": 2, "11/2": 3, "2": 4}  # fixed values: label -> semitones


def bends(
    heads: DataFrame, notes: DataFrame, keys: Sequence[str], spacing: float
) -> DataFrame:
    """Bend arrows put on notes: heads ``hid, x, straight, down, label``; notes ``nid, x`` of the same string.

    An up arrow bends the nearest note (straight: a pre-bend); a down arrow releases the bent note beside
    it, else the last bent note before it when nothing was struck in between.
    """
    amount: Column = F.lit(2)
    for label, semitones in BEND_AMOUNTS.items():
        amount = F.when(F.lower("label") == label, semitones).otherwise(amount)
    up = heads.where(~F.col("down")).withColumn("_amount", amount)
    tol = F.when(F.col("straight"), 0.5 * spacing).otherwise(1.8 * spacing)
    hit = nearest(up, notes, keys, F.col("x"), "hid", F.col("x"), "nid", {"nid": "nid"}, "_d").where(F.col("_d") <= tol)
    bent = hit.groupBy(*keys, "nid").agg(
        F.max_by("_amount", "hid").alias("semitones"), F.max_by("straight", "hid").alias("pre_bend")
    )
    marked = notes.join(bent, [*keys, "nid"], "left")
    downs = heads.where("down").select(*keys, "hid", "x")
    beside = nearest(
        downs, marked.where("semitones is not null").select(*keys, "nid", "x"), keys, F.col("x"), "hid", F.col("x"), "nid",
        {"_beside": "nid"}, "_d", 1.8 * spacing,
    )
    last = asof(beside, marked.select(*keys, "nid", "x", "semitones"), keys, F.col("x"), "hid", F.col("x"), "nid",
                {"_last": "nid", "_lb": "semitones"})
    target = F.coalesce("_beside", F.when(F.col("_lb").isNotNull(), F.col("_last")))
    released = last.select(*keys, target.alias("nid")).where("nid is not null").distinct().withColumn("release", F.lit(True))
    out = marked.join(released, [*keys, "nid"], "left").where("semitones is not null")
    return out.select(*keys, "nid", "semitones", "pre_bend", F.coalesce("release", F.lit(False)).alias("release"))


def tie_arcs(notes: DataFrame, arcs: DataFrame, keys: Sequence[str], page_keys: Sequence[str], spacing: float, like: Ordered | None = None) -> DataFrame:
    """Whether an arc arrives at each parenthesised note; null on pages that draw no arcs at all.

    Notes ``nid, x, parenthesized, left`` (where their staff begins); arcs ``aid, x0, x1`` of the same string. The arc
    must be wider than a space, end just before the note and begin after the string's previous note (one more than half a
    space before it), so the latest beginning among the arcs ending there decides. A line's first note also takes the
    stub of a tie from the line above: a fifth of a space or more, from near the staff's beginning on.
    """
    earlier = notes.select(*keys, F.col("nid").alias("_id"), F.col("x").alias("_x"))
    line = merged(notes, earlier, keys, F.col("x") - 0.5 * spacing, "nid", F.col("_x"), "_id", marks_first=False, like=like).add(_p=fill("_mark"))
    points = back_to_points(line, notes, _prev=F.col("_p")["_x"])
    first = F.coalesce("_prev", F.col("left") - spacing) - 1.5 * spacing
    points = points.select(*keys, "nid", "x", "parenthesized", first.alias("_start"), F.col("_prev").isNull().alias("_opens"), "left")
    row = f"struct<{','.join(f'{f.name}:{f.dataType.simpleString()}' for f in points.schema.fields)}>"
    none = F.lit(None).cast("double")
    both = points.select(*keys, F.col("x").alias("_at"), none.alias("x0"), none.alias("x1"), F.struct(*points.columns).alias("_row")).unionByName(
        arcs.select(*keys, F.col("x1").alias("_at"), "x0", "x1", F.lit(None).cast(row).alias("_row"))
    )
    if like is not None:
        both = gathered(both, like.keys, like)
    # Arcs that are neither wide nor stubs stay in the line, but begin nowhere.
    wide = F.col("x1") - F.col("x0")
    stub = (wide > 0.2 * spacing) & (F.col("x0") <= F.col("_left") + 2 * spacing)
    line = ordered(both, keys, ["_at"], like).add(_left=total_min(F.col("_row")["left"]))
    line = line.with_columns(_b=F.when(wide > spacing, F.col("x0")), _s=F.when((wide > spacing) | stub, F.col("x0")))
    near = line.ranged(-2.5 * spacing, 0.3 * spacing, _late="max(_b)", _stub="max(_s)")
    seen = near.where(F.col("_row").isNotNull()).select("_row.*", "_late", "_stub")
    arrives = (F.col("_late") >= F.col("_start")) | (F.col("_opens") & (F.col("_stub") >= F.col("_start")))
    seen = seen.where("parenthesized").withColumn("_arc", F.coalesce(arrives, F.lit(False)))
    out = ordered(seen, page_keys, ["nid"], like).add(_any=total_max("_arc")).df
    paged = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in page_keys])
    return out.select(*keys, "nid", F.when(F.col("_any") & paged, F.col("_arc")).alias("tie_arc"))


def hairpins(strokes: DataFrame, keys: Sequence[str], spacing: float) -> DataFrame:
    """A rising with a falling stroke over one span: opening to the right (+1) or closing (-1).

    Both ends must agree within half a space.
    """
    shapes = strokes.select(*keys, "x0", "x1", "top", "bottom", "rising").distinct()
    ends = (F.col("x0"), F.col("x1"))
    rows = close_pairs(shapes.where("rising"), shapes.where("not rising"), keys, ends, ends, 0.5 * spacing)
    u, d = F.col("l"), F.col("r")
    left, right = F.abs(u["bottom"] - d["top"]), F.abs(u["top"] - d["bottom"])
    ok = (F.abs(right - left) >= 0.3 * spacing) & (F.least(left, right) <= spacing)
    return rows.where(ok).select(
        *keys,
        F.least(u["x0"], d["x0"]).alias("x0"),
        F.greatest(u["x1"], d["x1"]).alias("x1"),
        F.when(right > left, 1).otherwise(-1).alias("direction"),
    ).distinct()


def decode_symbols(glyphs: DataFrame, text: Column, symbols: dict[str, str | int], name: str = "meaning") -> DataFrame:
    """Meaning of each symbol by a small fixed dictionary, compared without case, spaces and dots."""
    key = F.lower(F.regexp_replace(text, r"[\s.,:;()\[\]]", ""))
    pairs = [F.lit(v) for item in symbols.items() for v in item]
    return glyphs.withColumn(name, F.try_element_at(F.create_map(*pairs), key))


def read_stems(stems: DataFrame, beams: DataFrame, flags: DataFrame, dots: DataFrame, keys: Sequence[str], spacing: float) -> DataFrame:
    """Length of each stem: levels of beams over it (8 / 4 / 2 / 1), else its shortest flag, else half or quarter; a dot
    adds half.

    Stems ``sid, x, top, bottom``; beams ``bid, x0, x1, top``; flags ``fid, x, units``; dots ``did, x``. Short stems
    (at most 0.7 of the staff's median height) are halves.
    """
    typical = stems.groupBy(*keys).agg(F.percentile(F.col("bottom") - F.col("top"), F.lit(0.5)).alias("_typ"))
    # Levels over a stem: each level's beams joined to spans, then spans begun less spans ended before the stem.
    levels = beams.select(*keys, F.bround("top", 0).alias("_level"), "bid", (F.col("x0") - 2).alias("a"), (F.col("x1") + 2).alias("b"))
    line = ordered(levels, [*keys, "_level"], ["a", "bid"]).add(_far=running_max("b", before=True))
    line = line.islands("_span", F.col("_far").isNull() | (F.col("a") > F.col("_far")))
    spans = line.df.groupBy(*keys, "_level", "_span").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.min("bid").alias("bid"))
    none = F.lit(None).cast("long")
    sweep = (
        spans.select(*keys, F.col("a").alias("_at"), F.lit(0).alias("_side"), F.col("bid").cast("long").alias("_id"), none.alias("sid"), F.lit(1).alias("_d"))
        .unionByName(spans.select(*keys, F.col("b").alias("_at"), F.lit(2).alias("_side"), F.col("bid").cast("long").alias("_id"), none.alias("sid"), F.lit(-1).alias("_d")))
        .unionByName(stems.select(*keys, F.col("x").alias("_at"), F.lit(1).alias("_side"), F.col("sid").cast("long").alias("_id"), F.col("sid").cast("long").alias("sid"), F.lit(0).alias("_d")))
    )
    swept = ordered(sweep, keys, ["_at", "_side", "_id"]).add(_beams=running_sum("_d")).df
    count = swept.where("sid is not null and _beams > 0").select(*keys, "sid", "_beams")
    lone = flags.select(*keys, F.col("x").alias("_at"), "units", "fid")
    both = stems.select(*keys, F.col("x").alias("_at"), "sid", "top", "bottom").unionByName(lone, allowMissingColumns=True)
    near = ordered(both, keys, ["_at"]).ranged(-0.5 * spacing, 1.0 * spacing, _flag="min(units)")
    out = near.where("sid is not null").select(*keys, "sid", F.col("_at").alias("x"), "top", "bottom", "_flag")
    dotted = merged(out, dots, keys, F.col("x"), "sid", F.col("x"), "did").add(_d=fill_back("_mark", after=True))
    gap = F.col("_d")["_at"] - F.col("_pos")
    out = back_to_points(dotted, out, _dot=F.coalesce((gap > 0) & (gap <= 1.5 * spacing), F.lit(False)))
    out = out.join(count, [*keys, "sid"], "left").join(typical, list(keys))
    beamed = F.element_at(F.create_map(*[F.lit(v) for v in (1, 4, 2, 2, 3, 1)]), F.col("_beams").cast("int"))
    short = F.col("bottom") - F.col("top") <= 0.7 * F.greatest("_typ", F.lit(1.5 * spacing))
    units = F.when(F.col("_beams").isNotNull(), beamed).otherwise(F.coalesce("_flag", F.when(short, 16).otherwise(8)))
    with_dot = F.when(F.col("_dot"), F.when(units.isin(2, 4, 8, 16, 32), (units * 1.5).cast("int"))).otherwise(units)
    return out.select(*keys, "sid", with_dot.alias("units"))


def time_signatures(digits: DataFrame, keys: Sequence[str], x0: str, row_y: str, digit: str, tie: str, gap: float, size: float) -> DataFrame:
    """Stacked digits as time signatures: groups close in x with exactly two rows, 1..32 over 1, 2, 4, 8, 16 or 32."""
    line = ordered(digits, keys, [x0, tie]).add(_prev=lag(x0))
    line = line.islands("sign", F.col("_prev").isNull() | (F.col(x0) - F.col("_prev") > gap))
    rows = anchored_groups(line.df.drop("_prev"), [*keys, "sign"], row_y, tie, 0.2 * size, "row_no", like=line)
    read = rows.groupBy(*keys, "sign", "row_no").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(x0, tie, digit))), lambda d: d[digit].cast("string")), "").alias("n"),
        F.min(x0).alias("x"),
    )
    both = read.groupBy(*keys, "sign").agg(
        F.min("x").alias("x"), F.max("row_no").alias("_rows"),
        F.max(F.when(F.col("row_no") == 1, F.col("n"))).try_cast("int").alias("num"),
        F.max(F.when(F.col("row_no") == 2, F.col("n"))).try_cast("int").alias("den"),
    )
    ok = (F.col("_rows") == 2) & F.col("num").between(1, 32) & F.col("den").isin(1, 2, 4, 8, 16, 32)
    return both.where(ok).select(*keys, "x", "num", "den")


def bar_numbers(bars: DataFrame, numbers: DataFrame, keys: Sequence[str], x: str, bar_id: str, number_x: str, value: str, reach: float) -> DataFrame:
    """The number printed at each bar line: exactly one within ``reach``, else null."""
    both = bars.select(*keys, F.col(x).cast("double").alias("_at"), bar_id).unionByName(
        numbers.select(*keys, F.col(number_x).cast("double").alias("_at"), F.col(value).alias("_v")), allowMissingColumns=True
    )
    near = ordered(both, keys, ["_at"]).ranged(-reach, reach, _n="count(_v)", _one="max(_v)")
    return near.where(F.col(bar_id).isNotNull()).select(*keys, bar_id, F.when(F.col("_n") == 1, F.col("_one")).alias("number"))


def staff_labels(lines: DataFrame, keys: Sequence[str], string: str, label: Column) -> DataFrame:
    """Tuning letters left of a staff's lines, all or none."""
    ok = F.upper(F.substring(label, 1, 1)).rlike("^[A-G]$")
    found = lines.groupBy(*keys).agg(
        F.every(F.coalesce(ok, F.lit(False))).alias("_all"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(string, label.alias("l")))), lambda r: r["l"]), " ").alias("_labels"),
    )
    return found.select(*keys, F.when(F.col("_all"), F.col("_labels")).alias("labels"))


def bar_counts(
    bars: DataFrame, notes: DataFrame, counts: DataFrame, keys: Sequence[str], bar_id: str, note_x: str, note_id: str, count_x: str, count_id: str, value: str
) -> DataFrame:
    """Rest bars an empty bar stands for: the one count printed over it. Bars ``start, end``."""
    def inside(points: DataFrame, x: str, pid: str) -> DataFrame:
        line = merged(points, bars, keys, F.col(x), pid, F.col("start"), bar_id).add(_m=fill("_mark"))
        ok = F.col("_pos") < F.col("_m")["end"]
        return back_to_points(line, points, _bar=F.when(ok, F.col("_m")[bar_id])).where("_bar is not null")

    played = inside(notes.select(*keys, note_x, note_id), note_x, note_id).select(*keys, F.col("_bar").alias(bar_id)).distinct()
    printed = inside(counts.select(*keys, count_x, count_id, value), count_x, count_id).groupBy(*keys, F.col("_bar").alias(bar_id)).agg(
        F.count("*").alias("_n"), F.max(value).alias("rest_bars")
    )
    return printed.where("_n = 1").join(played, [*keys, bar_id], "left_anti").select(*keys, bar_id, "rest_bars")


def volta_passes(text: Column) -> Column:
    """Passes of a volta label ("1.", "1., 2."), ascending; null for other text."""
    t = F.regexp_replace(text, " ", "")
    found = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(t, F.lit("[0-9]"), F.lit(0)), lambda d: d.cast("int"))))
    return F.when(t.rlike(r"^[0-9]([.,][0-9])*\.$") | t.rlike(r"^[0-9](\.,[0-9])*\.$"), found)


TECHNIQUE_WORDS = ("letring", "lr", "pm", "palmmute")  # fixed values: marks that may share a line with lyrics
TECHNIQUE_PAIRS = ("let ring", "palm mute", "p m")


def without_techniques(words: DataFrame, keys: Sequence[str], pos: str, word: str) -> DataFrame:
    """Words of lyric lines without technique marks, single or in pairs, and lone H / P."""
    plain = F.lower(F.regexp_replace(word, r"[.\-]", ""))
    line = ordered(words.withColumn("_k", plain), keys, [pos]).add(_next=lead("_k"), _before=lag("_k"))
    pair = F.concat_ws(" ", "_k", "_next").isin(*TECHNIQUE_PAIRS) | F.concat_ws(" ", "_before", "_k").isin(*TECHNIQUE_PAIRS)
    drop = F.col(word).isin("H", "P") | F.col("_k").isin(*TECHNIQUE_WORDS) | pair
    return line.df.where(~drop).drop("_k", "_next", "_before")


def zone_text(words: DataFrame, staves: DataFrame, keys: Sequence[str], y: str, word_id: str, edge: str, staff_id: str, low: float, high: float) -> DataFrame:
    """Words lying ``low``..``high`` below a staff's edge, with that staff (the nearest one above)."""
    line = merged(words, staves, keys, F.col(y) - low, word_id, F.col(edge), staff_id).add(_s=fill("_mark"))
    gap = F.col("_row")[y] - F.col("_s")["_at"]
    return back_to_points(line, words, staff=F.when(gap <= high, F.col("_s")[staff_id])).where("staff is not null")


def sized_numbers(digits: DataFrame, keys: Sequence[str], height: Column, k: float = 0.85) -> DataFrame:
    """Small (grace) digits: lower than ``k`` of the staff's 75th-percentile height, found by counting heights."""
    counts = digits.withColumn("_h", height).groupBy(*keys, "_h").agg(F.count("*").alias("_n"))
    ranks = ordered(counts, keys, ["_h"])  # one row per height
    ranks = ranks.add(_to=running_sum("_n"), _all=total_sum("_n"))
    typical = ranks.df.where(F.col("_to") > F.floor(F.col("_all") * 3 / 4)).groupBy(*keys).agg(F.min("_h").alias("_typ"))
    return digits.join(typical, list(keys)).withColumn("small", height < k * F.col("_typ")).drop("_typ")


def bracketed(tokens: DataFrame, keys: Sequence[str], order: Sequence[str], text: str) -> DataFrame:
    """Whether each token stands between "(" and ")"."""
    line = ordered(tokens, keys, order).add(_l=lag(text), _r=lead(text))
    both = (F.col("_l") == "(") & (F.col("_r") == ")")
    return line.df.withColumn("bracketed", F.coalesce(both, F.lit(False))).drop("_l", "_r")


def strum_marks(parts: DataFrame, keys: Sequence[str], x: str, y: str, tie: str, is_arrow: str, spacing: float) -> DataFrame:
    """Wavy arpeggio columns: an arrow below the middle of the waves is an upstroke, else a downstroke."""
    groups = anchored_groups(parts, keys, x, tie, 0.5 * spacing).groupBy(*keys, "group_no").agg(
        F.avg(x).alias("x"),
        F.avg(F.when(~F.col(is_arrow), F.col(y))).alias("_mid"),
        F.min_by(y, F.when(F.col(is_arrow), F.struct(x, tie))).alias("_head"),
    )
    up = F.coalesce(F.col("_head") > F.col("_mid"), F.lit(False))
    return groups.where("_mid is not null").select(*keys, "group_no", "x", F.when(up, "up").otherwise("down").alias("stroke"))


def candidate_positions(glyphs: DataFrame, top: Column, bottom: Column) -> DataFrame:
    """Both heights a music glyph may stand for: its box centre, and nine tenths of its size above the top."""
    return glyphs.select("*", F.explode(F.array((top + bottom) / 2, top - 0.9 * (bottom - top))).alias("y"))


