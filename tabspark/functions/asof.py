"""As-of, nearest and coverage joins as one union and one ordered scan: no pairs are built."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import Ordered, fill, fill_back, gathered, ordered, running_max

POS, SIDE, TIE, ROW, MARK = "_pos", "_side", "_tie", "_row", "_mark"


def merged(
    points: DataFrame,
    marks: DataFrame,
    keys: Sequence[str],
    pos: Column,
    point_id: str,
    mark_pos: Column,
    mark_id: str,
    marks_first: bool = True,
    like: Ordered | None = None,
) -> Ordered:
    """Points and marks of each key on one line; ``_row`` holds a point, ``_mark`` a mark."""
    side = 1 if marks_first else -1
    left = points.select(
        *keys,
        pos.cast("double").alias(POS),
        F.lit(side).alias(SIDE),
        F.col(point_id).cast("long").alias(TIE),
        F.struct(*points.columns).alias(ROW),
    )
    right = marks.select(
        *keys,
        mark_pos.cast("double").alias(POS),
        F.lit(0).alias(SIDE),
        F.col(mark_id).cast("long").alias(TIE),
        F.struct(*marks.columns, mark_pos.cast("double").alias("_at")).alias(MARK),
    )
    both = left.unionByName(right, allowMissingColumns=True)
    if like is not None:
        both = gathered(both, like.keys, like)  # once by the keys all scans share
    return ordered(both, keys, [POS, SIDE, TIE], like)


def back_to_points(line: Ordered, points: DataFrame, **columns: Column) -> DataFrame:
    return line.df.where(F.col(ROW).isNotNull()).select(
        *[F.col(ROW)[c].alias(c) for c in points.columns], *[v.alias(k) for k, v in columns.items()]
    )


def asof(
    points: DataFrame,
    marks: DataFrame,
    keys: Sequence[str],
    pos: Column,
    point_id: str,
    mark_pos: Column,
    mark_id: str,
    take: dict[str, str],
    marks_first: bool = True,
    like: Ordered | None = None,
) -> DataFrame:
    """Each point with the last mark at or before it (``take``: new name -> mark column)."""
    line = merged(points, marks, keys, pos, point_id, mark_pos, mark_id, marks_first, like).add(_m=fill(MARK))
    return back_to_points(line, points, **{new: F.col("_m")[old] for new, old in take.items()})


def nearest(
    points: DataFrame,
    marks: DataFrame,
    keys: Sequence[str],
    pos: Column,
    point_id: str,
    mark_pos: Column,
    mark_id: str,
    take: dict[str, str],
    dist: str,
    tol: float | None = None,
    like: Ordered | None = None,
) -> DataFrame:
    """Each point with its nearest mark (ties: the lower position, then the lower id), null beyond ``tol``."""
    at = mark_pos.cast("double")
    lone = (
        marks.withColumn("_at", at)
        .groupBy(*keys, "_at")
        .agg(F.min_by(F.struct(*marks.columns), F.col(mark_id)).alias("_m"))
        .select(*keys, "_at", *[F.col("_m")[c].alias(c) for c in marks.columns if c not in keys])
    )
    line = merged(points, lone.withColumnRenamed("_at", "_mp"), keys, pos, point_id, F.col("_mp"), mark_id, like=like)
    line = line.add(_lo=fill(MARK), _hi=fill_back(MARK))
    low = F.abs(F.col(POS) - F.col("_lo")["_at"])
    high = F.abs(F.col(POS) - F.col("_hi")["_at"])
    use_low = F.col("_hi").isNull() | (low <= high)
    best = F.when(use_low, F.col("_lo")).otherwise(F.col("_hi"))
    gap = F.when(use_low, low).otherwise(high)
    if tol is not None:
        best, gap = F.when(gap <= tol, best), F.when(gap <= tol, gap)
    return back_to_points(line, points, **{new: best[old] for new, old in take.items()}, **{dist: gap})


def covered(
    points: DataFrame,
    ranges: DataFrame,
    keys: Sequence[str],
    pos: Column,
    point_id: str,
    start: Column,
    end: Column,
    range_id: str,
    name: str,
) -> DataFrame:
    """Whether any [start, end] range of the key holds the point: the furthest end begun so far reaches it."""
    withend = ranges.withColumn("_end", end.cast("double"))
    line = merged(points, withend, keys, pos, point_id, start, range_id).add(_far=running_max(F.col(MARK)["_end"]))
    return back_to_points(line, points, **{name: F.coalesce(F.col("_far") >= F.col(POS), F.lit(False))})


def close_pairs(
    left: DataFrame, right: DataFrame, keys: Sequence[str], ends: tuple[Column, Column], other_ends: tuple[Column, Column], tol: float
) -> DataFrame:
    """Rows of both sides (structs ``l``, ``r``) that agree at both ends within ``tol``.

    Equal keys and cells of ``tol`` at both ends: the left side, best the smaller one, visits the nine cells around its own.
    """
    a = left.select(*keys, F.struct("*").alias("l"), *[e.alias(f"_e{i}") for i, e in enumerate(ends)])
    a = a.withColumn("_c0", F.explode(F.array(*[F.floor(F.col("_e0") / tol) + d for d in (-1, 0, 1)])))
    a = a.withColumn("_c1", F.explode(F.array(*[F.floor(F.col("_e1") / tol) + d for d in (-1, 0, 1)])))
    b = right.select(*keys, F.struct("*").alias("r"), *[e.alias(f"_o{i}") for i, e in enumerate(other_ends)])
    b = b.withColumns({f"_c{i}": F.floor(F.col(f"_o{i}") / tol) for i in (0, 1)})
    near = (F.abs(F.col("_e0") - F.col("_o0")) <= tol) & (F.abs(F.col("_e1") - F.col("_o1")) <= tol)
    return a.join(b, [*keys, "_c0", "_c1"]).where(near).select(*keys, "l", "r")
