"""Reading the strings of text tabs: one pass of patterns over each line, no rows per character."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .layout import MAX_FRET

# What stands before a note, the note, and the bend written after it ("7b9r7", "7pb9").
TOKEN = r"([^0-9xX]*)([0-9]+|[xX])((?:(?:\)?b|[)>]?pb)\(?[0-9]*\)?(?:r[0-9]*)?)?)"
LINK_MARK = r"(h|p|s|[0-9)>][/\\][0-9(<]|[^0-9)>][/\\][^0-9(<])"
SLIDE_IN_MARK = r"[^0-9)>]([/\\])[0-9(<]"
AFTER_BAR = r"([^|]*)$"


def _tokens(lines: DataFrame, keys: Sequence[str], body: str) -> DataFrame:
    closed = F.concat(F.col(body), F.lit("x"))  # a closing mark, so that the text after the last note is read too
    found = lines.select(
        *keys, *[F.regexp_extract_all(closed, F.lit(TOKEN), F.lit(g)).alias(n) for g, n in ((1, "p"), (2, "n"), (3, "t"))]
    )
    lengths = F.zip_with("p", F.zip_with("n", "t", lambda n, t: F.length(n) + F.length(t)), lambda p, r: F.length(p) + r)
    ends = F.aggregate(
        lengths, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n))
    )
    rows = found.withColumn("_ends", ends).select(
        *keys, "p", "n", "t", "_ends", F.explode(F.sequence(F.lit(0), F.size("n") - 1)).alias("i")
    )
    before_text = F.concat(F.coalesce(F.get("n", F.col("i") - 1), F.lit("")), F.coalesce(F.get("t", F.col("i") - 1), F.lit("")))
    return rows.select(
        *keys,
        "i",
        F.get("p", F.col("i")).alias("before"),
        F.get("n", F.col("i")).alias("num"),
        F.get("t", F.col("i")).alias("tail"),
        F.get("p", F.col("i") + 1).alias("after"),
        F.coalesce(F.get("n", F.col("i") + 1), F.lit("")).alias("next"),
        F.when(F.col("i") == 0, F.lit("-")).otherwise(F.right(before_text, F.lit(1))).alias("came"),
        F.get("_ends", F.col("i")).alias("at"),
        (F.size("n") - 1).alias("last"),
    )


def _last_mark(found: Column) -> Column:
    mark = F.when(F.size(found) > 0, F.element_at(found, -1))
    return F.when(F.length(mark) == 3, F.substring(mark, 2, 1)).otherwise(mark)


def scan_notes(lines: DataFrame, keys: Sequence[str], body: str) -> DataFrame:
    """Notes of each tab string: x, fret (null when dead), brackets, links, slides, bends, taps, vibrato."""
    rows = _tokens(lines, keys, body).where(F.col("i") < F.col("last"))
    num, tail, after = F.col("num"), F.col("tail"), F.col("after")
    digit = num.rlike("^[0-9]")
    seg = F.regexp_extract("before", AFTER_BAR, 1)
    came = F.when(F.col("before").contains("|"), F.lit("|")).otherwise(F.col("came"))
    context = F.concat(came, seg, F.when(digit, F.lit("0")).otherwise(F.lit("x")))
    closing = F.concat(tail, after)
    dead_or_end = F.when(F.col("next").rlike("^[0-9]"), F.lit("0")).otherwise(F.lit("x"))
    out_mark = F.regexp_extract(F.concat(after, dead_or_end), r"^[)>]?([/\\])[^0-9(<]", 1)
    slide_out = F.when(digit & ((tail == "") | tail.rlike(r"[0-9)]$")) & (out_mark != ""), out_mark)
    slide_in = F.when(digit, _last_mark(F.regexp_extract_all(context, F.lit(SLIDE_IN_MARK), F.lit(1))))
    length = F.length(num)
    whole = (length <= 2) & (F.coalesce(num.try_cast("int"), F.lit(99)) <= MAX_FRET)
    target = F.regexp_extract(tail, r"b\(?([0-9]+)", 1).try_cast("int")
    parts = F.when(~digit | whole, F.array(num)).otherwise(F.split(num, ""))
    notes = rows.select(
        *keys,
        (F.col("at") + F.length("before")).alias("_x"),
        digit.alias("_digit"),
        (F.col("before").endswith("(") & closing.startswith(")") & digit).alias("parenthesized"),
        (F.col("before").endswith("<") & closing.startswith(">") & digit).alias("harmonic"),
        _last_mark(F.regexp_extract_all(context, F.lit(LINK_MARK), F.lit(1))).alias("_link"),
        slide_in.alias("_in"),
        slide_out.alias("_out"),
        (digit & seg.rlike("[tT]$")).alias("_tap"),
        after.contains("~").alias("_vib"),
        tail.alias("_tail"),
        target.alias("_target"),
        F.size(parts).alias("_n"),
        F.posexplode(parts).alias("_k", "_part"),
    )
    first, last = F.col("_k") == 0, F.col("_k") == F.col("_n") - 1
    fret = F.when(F.col("_digit"), F.col("_part").try_cast("int"))
    delta = F.col("_target") - fret
    bend = F.when(F.col("_digit") & last & F.col("_tail").contains("b"), F.when(delta.between(1, 4), delta).otherwise(2))
    return notes.select(
        *keys,
        (F.col("_x") + F.col("_k")).alias("x"),
        fret.alias("fret"),
        (~F.col("_digit")).alias("dead"),
        "parenthesized",
        "harmonic",
        F.when(first, F.col("_link")).alias("link"),
        F.when(first, F.col("_in")).alias("slide_in"),
        F.when(last, F.col("_out")).alias("slide_out"),
        (first & F.col("_tap")).alias("tapped"),
        (last & F.col("_vib")).alias("vibrato"),
        F.coalesce(bend, F.lit(0)).alias("bend"),
        (bend.isNotNull() & F.col("_tail").contains("r")).alias("bend_release"),
        (bend.isNotNull() & F.col("_tail").contains("pb")).alias("bend_pre"),
    )


def scan_bars(lines: DataFrame, keys: Sequence[str], body: str) -> DataFrame:
    """Bar lines of each tab string with whether repeat dots stand right (open) or left (close) of them."""
    chars = F.split(F.col(body), "")
    rows = lines.select(*keys, F.posexplode(chars).alias("x", "_c"), F.col(body).alias("_b"))
    dots = r"^[:*o]$"
    return rows.where(F.col("_c") == "|").select(
        *keys,
        "x",
        F.substring(F.col("_b"), F.col("x") + 2, F.lit(1)).rlike(dots).alias("opens"),
        ((F.col("x") > 0) & F.substring(F.col("_b"), F.greatest(F.col("x"), F.lit(1)), F.lit(1)).rlike(dots)).alias("closes"),
    )
