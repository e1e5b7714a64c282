"""The event feeds over a stored table: the same results the streams give."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import lag, lead, ordered, running_max, running_sum
from . import rules


def rate_limit(df: DataFrame, keys: Sequence[str], sec: str, tie: str, limit: int, window: float = rules.WINDOW_S) -> DataFrame:
    """Adds ``allowed``: whether the sliding window of the key had room for the hit."""

    def step(columns, state):
        allowed, hits = rules.admit(columns[sec].tolist(), state, limit, window)
        return {"allowed": allowed}, hits

    return ordered(df, keys, [sec, tie]).fold(step, "allowed boolean", []).df


def ttl_lookups(df: DataFrame, keys: Sequence[str], sec: str, tie: str, ttl: float = rules.TTL_S) -> DataFrame:
    """Adds ``looked_up``: whether the request had to be looked up, reads from the cache not extending its life."""

    def step(columns, state):
        needed, last = rules.lookups(columns[sec].tolist(), state[0], ttl)
        return {"looked_up": needed}, [last]

    return ordered(df, keys, [sec, tie]).fold(step, "looked_up boolean", [float("-inf")]).df


def presence(df: DataFrame, app: Sequence[str], page: str, sec: str, tie: str, alive: Column, stale: float = rules.STALE_S, grace: float = rules.GRACE_S) -> DataFrame:
    """Alarms: every time no page of the app was left for ``grace`` seconds. A page lives until its goodbye, or ``stale``
    seconds after its last report."""
    rows = ordered(df.withColumn("_alive", alive), [*app, page], [sec, tie]).add(_next=lead(sec)).df.where("_alive")
    spans = rows.select(*app, F.col(sec).alias("_from"), tie, F.least(F.coalesce("_next", F.col(sec) + stale), F.col(sec) + stale).alias("_to"))
    line = ordered(spans, app, ["_from", tie]).add(_far=running_max("_to"), _n=lead("_from"))
    gap = F.col("_n").isNull() | (F.col("_n") - F.col("_far") >= grace)
    return line.df.where(gap).select(*app, (F.col("_far") + grace).alias("alarm_s"))


def job_status(df: DataFrame, job: str, sec: str, tie: str, status: str, finished: Sequence[str], now: Column, ttl: float, deadline: float) -> DataFrame:
    """Latest status of each job not forgotten: finished ones after ``ttl``, any past its deadline plus ``ttl``."""
    latest = df.groupBy(job).agg(F.max_by(F.struct(status, sec), F.struct(sec, tie)).alias("_l"), F.min(sec).alias("_first"))
    old = F.col("_l")[status].isin(*finished) & (now - F.col("_l")[sec] > ttl)
    lost = now - F.col("_first") > deadline + ttl
    return latest.where(~old & ~lost).select(job, F.col("_l")[status].alias("status"), (~F.col("_l")[status].isin(*finished)).alias("active"))


def stalled(df: DataFrame, job: Sequence[str], sec: str, tie: str, quiet: float = rules.STALL_S, total: float = rules.TOTAL_S) -> DataFrame:
    """When each job was cut: ``quiet`` seconds without progress, or ``total`` seconds in all."""
    line = ordered(df, job, [sec, tie]).add(_next=lead(sec))
    cut = F.when(F.col("_next").isNull() | (F.col("_next") - F.col(sec) > quiet), F.col(sec) + quiet)
    ends = line.df.groupBy(*job).agg(F.min(cut).alias("_quiet"), (F.min(sec) + total).alias("_total"))
    return ends.select(*job, F.least("_quiet", "_total").alias("cut_s"), F.when(F.col("_quiet") <= F.col("_total"), "stalled").otherwise("too long").alias("why"))


def loop_rounds(df: DataFrame, keys: Sequence[str], order: Sequence[str], tick: str, a: Column, b: Column, speed: float, step: float = rules.LOOP_STEP, top: float = rules.LOOP_TOP) -> DataFrame:
    """Rows where the player jumped back from the last to the first quarter of the loop, with the next round's speed."""
    span = b - a
    line = ordered(df, keys, order).add(_last=lag(tick))
    back = (F.col(tick) < F.col("_last")) & (F.col(tick) - a <= 0.25 * span) & (b - F.col("_last") <= 0.25 * span) & (span > 0)
    line = line.with_columns(_back=F.coalesce(back, F.lit(False))).add(_round=running_sum(F.col("_back").cast("int")))
    rounds = line.df.where("_back")
    before = speed + step * (F.col("_round") - 1)
    return rounds.where(F.round(before, 2) < top).withColumn("next_speed", F.least(F.lit(top), F.round(before + step, 2))).drop("_last", "_back", "_round")
