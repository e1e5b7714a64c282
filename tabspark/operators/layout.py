"""Layout: positioned marks grouped into words, lines, columns, staves and bars."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.asof import merged
from ..functions.ordered import (
    Ordered,
    fill,
    fill_back,
    keyed,
    lag,
    lead,
    number,
    ordered,
    total_count,
    total_min,
)


def chain_groups(df: DataFrame, keys: Sequence[str], pos: str, tie: str, tol: float, group: str) -> Ordered:
    """A new group starts where the gap to the previous mark exceeds ``tol``."""
    line = ordered(df, keys, [pos, tie]).add(_prev=lag(pos))
    starts = F.col("_prev").isNull() | (F.col(pos) - F.col("_prev") > tol)
    return line.with_columns(_starts=starts).islands(group, F.col("_starts")).map(lambda d: d.drop("_prev"))


def shared_positions(df: DataFrame, keys: Sequence[str], lane: str, x: str, tie: str, tol: float) -> DataFrame:
    """Positions most lanes agree on: chained groups holding at least half of the key's lanes, at their median.

    The median is taken by rank, so a group of any size needs no list of its members.
    """
    lanes = df.groupBy(*keys, lane).agg(F.lit(1).alias("_one")).groupBy(*keys).agg(F.count("*").alias("_lanes"))
    line = chain_groups(df.select(*keys, lane, x, tie), keys, x, tie, tol, "_g").add(_no=number(), _all=total_count())
    first = F.when(F.col("_starts"), F.col("_no"))
    line = line.add(_from=fill(first), _next=fill_back(first, after=True))
    size = F.coalesce(F.col("_next"), F.col("_all") + 1) - F.col("_from")
    rank = F.col("_no") - F.col("_from") + 1
    middle = (rank * 2 == size) | (rank * 2 == size + 1) | (rank * 2 == size + 2)
    groups = line.df.groupBy(*keys, "_g").agg(
        F.avg(F.when(middle, F.col(x))).alias("position"), F.count_distinct(lane).alias("lanes"), F.count("*").alias("n")
    )
    return (
        groups.join(lanes, list(keys)).where(F.col("lanes") * 2 >= F.col("_lanes")).select(*keys, "position", "lanes", "n")
    )


def _anchor_step(pos: str, tol: str):
    def step(columns, state):
        anchor, reach = state
        anchors = []
        for x, t in zip(columns[pos].tolist(), columns[tol].tolist()):
            if not x - anchor <= reach:
                anchor, reach = x, t
            anchors.append(anchor)
        return {"anchor": anchors}, [anchor, reach]

    return step


def anchored_groups(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    tie: str,
    tol: Column | float,
    group: str = "group_no",
    like: Ordered | None = None,
) -> DataFrame:
    """Groups measured from their first member: a mark joins while it is within the anchor's tolerance.

    Adds ``anchor`` (position of the first member) and the group's number in the key.
    """
    reach = tol if isinstance(tol, Column) else F.lit(float(tol))
    line = ordered(df.withColumn(pos, F.col(pos).cast("double")).withColumn("_tol", reach), keys, [pos, tie], like)
    line = line.fold(_anchor_step(pos, "_tol"), "anchor double", [float("nan"), float("nan")]).add(_a=lag("anchor"))
    line = line.islands(group, F.col("_a").isNull() | (F.col("_a") != F.col("anchor")))
    return line.df.drop("_a", "_tol")


def dedupe_in_group(df: DataFrame, keys: Sequence[str], group: str, lane: str, order: Sequence[str]) -> DataFrame:
    """The first mark of each (group, lane), and how many later ones were dropped."""
    first = F.min_by(F.struct(*df.columns), F.struct(*order))
    kept = df.groupBy(*keys, group, lane).agg(first.alias("_f"), (F.count("*") - 1).alias("dropped"))
    return kept.select("_f.*", "dropped")


def split_by_gap(
    df: DataFrame, keys: Sequence[str], x0: str, x1: str, height: Column, tie: str, k: float, token: str = "token"
) -> DataFrame:
    """Number of the word (k = 0.2), label (0.6) or phrase (1.0) each mark belongs to."""
    line = ordered(df, keys, [x0, tie]).add(_end=lag(x1))
    line = line.islands(token, F.col("_end").isNull() | (F.col(x0) - F.col("_end") > k * height))
    return line.df.drop("_end")


def line_text(
    df: DataFrame, keys: Sequence[str], text: str, x0: str, x1: str, height: Column, tie: str, k: float = 0.2
) -> DataFrame:
    """Text of each key with the spaces restored where the gap is wider than ``k`` heights."""
    line = ordered(df, keys, [x0, tie]).add(_end=lag(x1))
    spaced = F.when(F.col(x0) - F.col("_end") > k * height, F.concat(F.lit(" "), F.col(text))).otherwise(F.col(text))
    parts = line.df.select(*keys, F.struct(x0, tie, spaced.alias("t")).alias("_p"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("_p")), lambda p: p["t"]), "")
    return parts.groupBy(*keys).agg(joined.alias("text"))


def _merge_step(columns, state):
    y, end = state
    starts = []
    for ny, nx0, nx1, reach in zip(*(columns[c].tolist() for c in ("_y", "x0", "x1", "_reach"))):
        if abs(y - ny) <= 0.5 and nx0 <= end + reach:
            starts.append(0)
            end = max(end, nx1)
        else:
            starts.append(1)
            y, end = ny, nx1
    return {"_new": starts}, [y, end]


def merge_lines(strokes: DataFrame, keys: Sequence[str], width: Column, tie: str) -> DataFrame:
    """Horizontal strokes on one height and close in x, merged to staff lines (short ones dropped)."""
    y = (F.col("top") + F.col("bottom")) / 2
    flat = strokes.where(F.col("x1") - F.col("x0") > 0.02 * width).withColumns(
        {"_y": y.cast("double"), "_row": F.bround(y, 1), "_reach": (0.1 * width).cast("double"), "_width": width}
    )
    flat = flat.select(*keys, tie, "x0", "x1", "_y", "_row", "_reach", "_width")
    line = ordered(flat, keys, ["_row", "x0", tie]).fold(_merge_step, "_new int", [float("nan"), float("nan")])
    line = line.islands("line_no", F.col("_new") == 1)
    merged_lines = line.df.groupBy(*keys, "line_no").agg(
        F.min_by("_y", F.struct("_row", "x0", tie)).alias("y"),
        F.min("x0").alias("x0"),
        F.max("x1").alias("x1"),
        F.max("_width").alias("_width"),
    )
    return merged_lines.where(F.col("x1") - F.col("x0") > 0.08 * F.col("_width")).drop("_width")


def _staff_step(columns, state):
    # state: lines in the run, its first gap, and the last line's y, x0, x1
    count, gap1, py, px0, px1 = state
    starts, inner = [], []
    for y, x0, x1 in zip(*(columns[c].tolist() for c in ("y", "x0", "x1"))):
        gap = y - py
        same = abs(x0 - px0) < 5 and abs(x1 - px1) < 5
        even = gap > 2 and (count < 2 or abs(gap - gap1) <= 0.15 * gap)
        skip = count >= 2 and gap < gap1 and (x1 - x0) < 0.9 * (px1 - px0)
        if count and same and even:
            if count == 1:
                gap1 = gap
            count, py, px0, px1 = count + 1, y, x0, x1
            starts.append(0)
            inner.append(0)
        elif count and skip:
            starts.append(0)
            inner.append(1)
        else:
            count, gap1, py, px0, px1 = 1, 0.0, y, x0, x1
            starts.append(1)
            inner.append(0)
        count = min(count, 100)  # only 4 to 8 count; a bounded counter lets chunk states meet
    return {"_new": starts, "_inner": inner}, [count, gap1, py, px0, px1]


def find_staves(lines: DataFrame, keys: Sequence[str], low: int = 4, high: int = 8) -> DataFrame:
    """Runs of ``low``..``high`` equally spaced, equally long lines; a shorter line inside is skipped."""
    line = ordered(lines, keys, ["y", "x0", "line_no"]).fold(_staff_step, "_new int, _inner int", [0.0, 0.0, 0.0, 0.0, 0.0])
    line = line.islands("staff", F.col("_new") == 1)
    runs = (
        line.df.where(F.col("_inner") == 0)
        .groupBy(*keys, "staff")
        .agg(
            F.count("*").alias("strings"),
            F.min("y").alias("top"),
            F.max("y").alias("bottom"),
            F.min_by("x0", F.struct("y", "x0")).alias("x0"),
            F.min_by("x1", F.struct("y", "x0")).alias("x1"),
        )
    )
    return runs.where(F.col("strings").between(low, high))


MAX_FRET = 29  # fixed value: the highest fret one number can mean


def digit_runs(chars: DataFrame, keys: Sequence[str], char: str, x0: str, x1: str, apart: bool = False) -> DataFrame:
    """Numbers made of touching digits (gap < 0.3 of a width); above 29 every digit is a number of its own.

    ``apart``: no character begins inside another, as in a monospaced line. Then nothing stands between touching
    digits, and only digits are looked at, shuffled and sorted.
    """
    digit = F.col(char).rlike("^[0-9]$")
    chars = chars.select(*keys, char, x0, x1)
    line = ordered(chars.where(digit) if apart else chars, keys, [x0]).add(_pc=lag(char), _pe=lag(x1))
    joins = F.col("_pc").rlike("^[0-9]$") & (F.col(x0) - F.col("_pe") < 0.3 * (F.col(x1) - F.col(x0)))
    line = line.islands("_run", digit & ~F.coalesce(joins, F.lit(False)))
    runs = (
        line.df.where(digit)
        .groupBy(*keys, "_run")
        .agg(
            F.array_sort(F.collect_list(F.struct(F.col(x0).alias("x"), F.col(char).alias("c")))).alias("_cs"),
        )
    )
    whole = F.array_join(F.col("_cs.c"), "")
    single = F.array(F.struct(F.element_at("_cs", 1)["x"].alias("x"), whole.alias("c")))
    small = F.length(F.ltrim(whole, F.lit("0"))) <= 2
    fits = small & (F.coalesce(whole.try_cast("int"), F.lit(99)) <= MAX_FRET)
    out = runs.select(*keys, F.explode(F.when(fits, single).otherwise(F.col("_cs"))).alias("_n"))
    return out.select(*keys, F.col("_n.x").alias("x"), F.col("_n.c").cast("int").alias("fret"))


# What a tab line may hold, and the label before it.
BODY_CHARS = r"-0123456789|hpbrs/\~xX()<>.:*^=+tTo"
TAB_LABEL = r"^([A-Ga-g][#b]?)?[|-]"


def tab_line_parts(line: Column) -> tuple[Column, Column]:
    """(label, body) of a text line; the body ends before a gap of more than two columns."""
    label = F.regexp_extract(line, r"^([^|-]*)[|-]", 1)
    body = F.regexp_extract(line, r"^[^|-]*([|-].*)$", 1)
    return label, F.regexp_replace(body, r"   .*$", "")


def is_tab_line(line: Column) -> Column:
    """Whether a text line looks like one string of a tab."""
    label, body = tab_line_parts(F.rtrim(line))

    def counted(part: Column) -> Column:
        text = part["body"]
        dashes = F.length(text) - F.length(F.translate(text, "-", ""))
        return F.struct(part["label"].alias("label"), text.alias("body"), dashes.alias("dashes"), F.length(F.translate(text, " ", "")).alias("n"))

    def looks_like_tab(part: Column) -> Column:
        name, text, dashes, n = part["label"], part["body"], part["dashes"], part["n"]
        return (
            ((name == "") | name.rlike(r"^[A-Ga-g][#b]?$"))
            & (dashes >= 6)
            & (dashes / n >= 0.35)
            & ~text.rlike(r"[A-Za-z]{3,}")
            & (F.length(F.translate(text, " " + BODY_CHARS, "")) / n <= 0.15)
        )

    # The parts and their counts are bound once by the one-element arrays; prose lines end at the cheap dash count.
    parts = F.transform(F.array(F.struct(label.alias("label"), body.alias("body"))), counted)
    return (F.length(line) - F.length(F.translate(line, "-", "")) >= 6) & F.exists(parts, looks_like_tab)


def tab_blocks(lines: DataFrame, keys: Sequence[str], line_no: str, line: str, like: Ordered | None = None) -> DataFrame:
    """Consecutive tab lines as systems of 4 to 8 strings.

    Longer blocks are cut where their labels repeat (8 strings down to 4); blocks that fit nothing are left out.
    """
    tabs = keyed(lines, keys).where(is_tab_line(F.col(line)))
    label, body = tab_line_parts(F.col(line))
    tabs = tabs.select(*keys, line_no, label.alias("label"), body.alias("body"), F.col(line).alias("_line"))
    run = ordered(tabs, keys, [line_no], like).add(_prev=lag(line_no))
    run = run.islands("block", F.col("_prev").isNull() | (F.col(line_no) != F.col("_prev") + 1))
    rows = run.map(lambda d: d.drop("_prev")).refine(["block"], [line_no]).add(_no=number(), _n=total_count())
    # A block repeats with period s when every label equals the label s lines before.
    checks = {}
    for s in range(4, 9):
        same = (F.col("_no") <= s) | (F.col("label") == F.col(f"_l{s}"))
        checks[f"_p{s}"] = total_min((same & (F.col("label") != "")).cast("int"))
    data = rows.lags("_l", "label", 8).add(**checks).df
    size = F.col("_n")
    period = F.when(size.between(4, 8), size)
    for s in range(8, 3, -1):
        period = F.coalesce(period, F.when((size > 8) & (size % s == 0) & (F.col(f"_p{s}") == 1), F.lit(s)))
    out = data.withColumn("_period", period.cast("long")).where(F.col("_period").isNotNull())
    at = F.col("_no") - 1
    return out.select(
        *keys,
        "block",
        F.floor(at / F.col("_period")).cast("long").alias("part"),
        (at % F.col("_period") + 1).cast("int").alias("string"),
        F.col("_period").cast("int").alias("string_count"),
        F.col(line_no),
        "label",
        "body",
        F.col("_line").alias("line"),
    )


# The ways a line says how often it is played.
REPEAT_X = r"(?i)^\(?\s*[x×]\s*([0-9]{1,2})\s*\)?$"
REPEAT_N = r"(?i)^\(?\s*([0-9]{1,2})\s*[x×]\s*\)?$"
REPEAT_WORD = r"(?i)^\(?\s*(?:play\s+)?([0-9]{1,2})\s*(?:times|vezes)\s*\)?$"


def repeat_count(text: Column) -> Column:
    """Times a passage is played ("x4", "3x", "3 vezes", "play 3 times"), 2 to 32, else null."""
    t = F.trim(text)
    found = [F.nullif(F.regexp_extract(t, p, 1), F.lit("")) for p in (REPEAT_X, REPEAT_N, REPEAT_WORD)]
    n = F.coalesce(*found).cast("int")
    return F.when(n.between(2, 32), n)


def bar_intervals(
    edges: DataFrame, marks: DataFrame, keys: Sequence[str], x: str, mark_x: str, start: str, end: str,
    like: Ordered | None = None,
) -> DataFrame:
    """Bars between bar lines; a line's own start / end is a bar line when marks lie outside the drawn ones."""
    drawn = edges.groupBy(*keys).agg(F.min(x).alias("_b0"), F.max(x).alias("_b1"))
    seen = marks.groupBy(*keys).agg(
        F.min(mark_x).alias("_m0"), F.max(mark_x).alias("_m1"), F.min(start).alias("_s"), F.max(end).alias("_e")
    )
    both = seen.join(drawn, list(keys), "left")
    first = F.when(F.col("_b0").isNull() | (F.col("_m0") < F.col("_b0")), F.col("_s"))
    last = F.when(F.col("_m1") > F.coalesce("_b1", "_s"), F.col("_e"))
    implied = both.select(*keys, F.explode(F.array(first, last)).alias(x)).where(F.col(x).isNotNull())
    bounds = edges.select(*keys, x).unionByName(implied).distinct()
    line = ordered(bounds, keys, [x], like).add(end=lead(x), bar=number())
    return line.df.where(F.col("end").isNotNull()).select(*keys, F.col("bar"), F.col(x).alias("start"), "end")


def assign_bar(
    points: DataFrame, bars: DataFrame, keys: Sequence[str], pos: str, point_id: str, bar_id: str, like: Ordered | None = None
) -> DataFrame:
    """The bar each point lies in (start <= x < end) and its place in it from 0 to 1; null outside all bars."""
    line = merged(points, bars, keys, F.col(pos), point_id, F.col("start"), bar_id, like=like).add(_m=fill("_mark"))
    inside = F.col("_pos") < F.col("_m")["end"]
    width = F.col("_m")["end"] - F.col("_m")["start"]
    place = F.when(width > 0, (F.col("_pos") - F.col("_m")["start"]) / width).otherwise(0.0)
    rows = line.df.where(F.col("_row").isNotNull())
    return rows.select(
        *[F.col("_row")[c].alias(c) for c in points.columns],
        F.when(inside, F.col("_m")[bar_id]).alias("bar"),
        F.when(inside, F.least(F.greatest(place, F.lit(0.0)), F.lit(1.0))).alias("place"),
    )


def lines_above(
    lines: DataFrame, keys: Sequence[str], line_no: str, y: str, height: str, text: str, depth: int = 3
) -> DataFrame:
    """Texts of the up to ``depth`` lines above each line, nearest first, ending at a gap over four heights."""
    row = F.struct(F.col(y).alias("y"), F.col(height).alias("h"), F.col(text).alias("t"))
    # Nothing else of a line comes along: in large keys each scan stores and shuffles whole rows.
    run = ordered(lines.select(*keys, line_no, row.alias("_r0")), keys, [line_no])
    for back in range(1, depth + 1):
        run = run.add(**{f"_r{back}": lag(f"_r{back - 1}")})
    ok: Column = F.lit(True)
    found = []
    for back in range(1, depth + 1):
        here, below = F.col(f"_r{back}"), F.col(f"_r{back - 1}")
        ok = ok & here.isNotNull() & ~(below["y"] - here["y"] > 4 * here["h"])
        found.append(F.when(ok, here["t"]).alias(f"above_{back}"))
    return run.df.select(*keys, line_no, *found)
