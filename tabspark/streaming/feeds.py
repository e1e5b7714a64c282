"""The event feeds as Structured Streaming queries with state per key.

Rows carry an event time ``ts``; rows later than the watermark (10 minutes unless said otherwise) are dropped, and
the rows of one micro-batch are taken in event-time order. State ends with the key's quiet time.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from . import rules

WATERMARK = "10 minutes"


def _watermarked(df: DataFrame, ts: str, delay: str) -> DataFrame:
    return df.withColumn("_sec", F.unix_micros(ts) / 1e6).withWatermark(ts, delay)


def _in_order(pdfs, tie: str) -> pd.DataFrame:
    parts = list(pdfs)  # one key's rows of one micro-batch; the trigger bounds them
    return pd.concat(parts).sort_values(["_sec", tie], kind="stable") if parts else pd.DataFrame()


def _expire(state: GroupState, last: float, seconds: float) -> None:
    due = int((last + seconds) * 1000)
    state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))


def rate_limit(stream: DataFrame, key: str, ts: str, tie: str, limit: int, window: float = rules.WINDOW_S, delay: str = WATERMARK) -> DataFrame:
    """(key, tie, allowed) of every hit."""
    name = stream.schema[key].dataType.simpleString()

    def run(k, pdfs, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        rows = _in_order(pdfs, tie)
        allowed, hits = rules.admit(rows["_sec"].tolist(), list(state.get[0]) if state.exists else [], limit, window)
        state.update((hits,))
        _expire(state, float(rows["_sec"].iloc[-1]), window)
        yield pd.DataFrame({key: [k[0]] * len(rows), tie: rows[tie].tolist(), "allowed": allowed})

    return _watermarked(stream, ts, delay).groupBy(key).applyInPandasWithState(
        run, f"{key} {name}, {tie} long, allowed boolean", "hits array<double>", "append", GroupStateTimeout.EventTimeTimeout
    )


def ttl_lookups(stream: DataFrame, key: str, ts: str, tie: str, ttl: float = rules.TTL_S, delay: str = WATERMARK) -> DataFrame:
    """(key, tie, looked_up) of every request."""
    name = stream.schema[key].dataType.simpleString()

    def run(k, pdfs, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        rows = _in_order(pdfs, tie)
        needed, last = rules.lookups(rows["_sec"].tolist(), state.get[0] if state.exists else float("-inf"), ttl)
        state.update((last,))
        _expire(state, last, ttl)
        yield pd.DataFrame({key: [k[0]] * len(rows), tie: rows[tie].tolist(), "looked_up": needed})

    return _watermarked(stream, ts, delay).groupBy(key).applyInPandasWithState(
        run, f"{key} {name}, {tie} long, looked_up boolean", "last double", "append", GroupStateTimeout.EventTimeTimeout
    )


def presence(
    stream: DataFrame, app: str, page: str, ts: str, tie: str, alive: str, stale: float = rules.STALE_S, grace: float = rules.GRACE_S, delay: str = WATERMARK
) -> DataFrame:
    """(app, alarm_s) whenever no page of the app was left for ``grace`` seconds.

    The state is when each open page goes stale and when the last one ended; the end of a page counts only once the
    watermark has passed it, so that a late report can still keep it open.
    """
    name = stream.schema[app].dataType.simpleString()

    def alarms(pages: dict[str, float], ended: float, now: float, out: list[float]) -> float:
        for p, until in sorted(pages.items(), key=lambda item: item[1]):
            if until <= now:
                ended = max(ended, until)
                del pages[p]
        if not pages and ended > float("-inf") and now >= ended + grace:
            out.append(ended + grace)
            ended = float("-inf")
        return ended

    def run(k, pdfs, state: GroupState):
        pages, ended = {}, float("-inf")
        if state.exists:
            names, untils, ended = state.get
            pages = dict(zip(names, untils))
        out: list[float] = []
        if not state.hasTimedOut:
            rows = _in_order(pdfs, tie)
            for now, p, on in zip(rows["_sec"].tolist(), rows[page].astype(str).tolist(), rows[alive].tolist()):
                ended = alarms(pages, ended, now, out)
                if on:
                    pages[p] = now + stale
                elif p in pages:
                    del pages[p]
                    ended = max(ended, now)
        else:
            ended = alarms(pages, ended, state.getCurrentWatermarkMs() / 1000, out)
        if pages or ended > float("-inf"):
            state.update((list(pages), list(pages.values()), ended))
            due = (max(pages.values()) if pages else ended) + grace
            state.setTimeoutTimestamp(max(int(due * 1000), state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame({app: [k[0]] * len(out), "alarm_s": out})

    return _watermarked(stream, ts, delay).groupBy(app).applyInPandasWithState(
        run, f"{app} {name}, alarm_s double", "names array<string>, untils array<double>, ended double", "append", GroupStateTimeout.EventTimeTimeout
    )


def job_status(stream: DataFrame, job: str, ts: str, tie: str, status: str) -> DataFrame:
    """Latest status of each job as it changes (update mode)."""
    latest = F.max_by(F.struct(status, ts), F.struct(ts, tie)).alias("_l")
    return stream.groupBy(job).agg(latest).select(job, F.col("_l")[status].alias("status"), F.col("_l")[ts].alias("at"))


def stalled(stream: DataFrame, job: str, ts: str, tie: str, quiet: float = rules.STALL_S, total: float = rules.TOTAL_S, delay: str = WATERMARK) -> DataFrame:
    """(job, cut_s, why) of jobs without progress for ``quiet`` seconds, or running for ``total``; a job is cut once."""
    name = stream.schema[job].dataType.simpleString()

    def run(k, pdfs, state: GroupState):
        first, last, done = state.get if state.exists else (0.0, float("-inf"), False)
        rows = pd.DataFrame() if state.hasTimedOut else _in_order(pdfs, tie)
        if done:
            return
        times = rows["_sec"].tolist() if len(rows) else []
        if not state.exists and times:
            first = times[0]
        cut = None
        for now in times:
            if last > float("-inf") and now - last > quiet:
                cut = last + quiet
                break
            last = now
        if cut is None and state.hasTimedOut:
            cut = last + quiet
        if cut is None and last > first + total:
            cut = first + total
        if cut is None:
            state.update((first, last, False))
            due = min(last + quiet, first + total)
            state.setTimeoutTimestamp(max(int(due * 1000), state.getCurrentWatermarkMs() + 1))
            return
        state.update((first, last, True))
        why = "stalled" if cut <= first + total else "too long"
        yield pd.DataFrame({job: [k[0]], "cut_s": [min(cut, first + total)], "why": [why]})

    return _watermarked(stream, ts, delay).groupBy(job).applyInPandasWithState(
        run, f"{job} {name}, cut_s double, why string", "first double, last double, done boolean", "append", GroupStateTimeout.EventTimeTimeout
    )


def loop_rounds(
    stream: DataFrame, key: str, ts: str, tie: str, tick: str, a: float, b: float, speed: float, step: float = rules.LOOP_STEP, top: float = rules.LOOP_TOP, delay: str = WATERMARK
) -> DataFrame:
    """(key, tie, next_speed) of every new round of the A-B loop, until the speed reaches ``top``."""
    name = stream.schema[key].dataType.simpleString()
    span = b - a

    def run(k, pdfs, state: GroupState):
        last, now_speed = state.get if state.exists else (float("-inf"), speed)
        rows = _in_order(pdfs, tie)
        found = []
        for at, t in zip(rows[tick].tolist(), rows[tie].tolist()):
            if span > 0 and at < last and at - a <= 0.25 * span and b - last <= 0.25 * span and now_speed < top:
                now_speed = min(top, round((now_speed + step) * 100) / 100)
                found.append((k[0], t, now_speed))
            last = float(at)
        state.update((last, now_speed))
        yield pd.DataFrame(found, columns=[key, tie, "next_speed"])

    return _watermarked(stream, ts, delay).groupBy(key).applyInPandasWithState(
        run, f"{key} {name}, {tie} long, next_speed double", "last double, speed double", "append", GroupStateTimeout.NoTimeout
    )
