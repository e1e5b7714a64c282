"""The rules of the event feeds, shared by the batch operators and the streams (times in seconds)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WINDOW_S = 60.0  # fixed values of the feeds, in seconds
STALE_S, GRACE_S = 150.0, 8.0
TTL_S = 86_400.0
STALL_S, TOTAL_S = 120.0, 900.0
LOOP_STEP, LOOP_TOP = 0.05, 1.0


def admit(times: list[float], hits: list[float], limit: int, window: float) -> tuple[list[bool], list[float]]:
    """Which hits a sliding window lets in; only those are remembered, and one exactly a window old still counts."""
    allowed = []
    for now in times:
        while hits and now - hits[0] > window:
            hits.pop(0)
        ok = len(hits) < limit
        if ok:
            hits.append(now)
        allowed.append(ok)
    return allowed, hits


def lookups(times: list[float], last: float, ttl: float) -> tuple[list[bool], float]:
    """Which requests need a lookup: the first, and any ``ttl`` or more after the last lookup."""
    needed = []
    for now in times:
        fresh = now - last < ttl
        if not fresh:
            last = now
        needed.append(not fresh)
    return needed, last


def client_key(host: Column) -> Column:
    """Key of a client: its IPv4 address, or the /64 network of its IPv6 address; "unknown" without one."""
    h = F.lower(F.trim(host))
    left = F.split(F.regexp_extract(h, "^(.*?)(::.*)?$", 1), ":")
    right = F.when(h.contains("::"), F.filter(F.split(F.regexp_extract(h, "::(.*)$", 1), ":"), lambda g: g != ""))
    head = F.filter(left, lambda g: g != "")
    zeros = F.array_repeat(F.lit("0"), F.greatest(8 - F.size(head) - F.coalesce(F.size(right), F.lit(0)), F.lit(0)))
    groups = F.when(h.contains("::"), F.concat(head, zeros, right)).otherwise(head)
    first = F.transform(F.slice(groups, 1, 4), lambda g: F.regexp_replace(g, "^0+(?=.)", ""))
    kept = F.regexp_replace(F.array_join(first, ":"), "(^|:)0(:0)*$", "")
    network = F.concat(kept, F.lit("::/64"))
    return F.when(F.coalesce(h, F.lit("")) == "", F.lit("unknown")).when(h.rlike("^[0-9a-f:]*:[0-9a-f:]*$"), network).otherwise(F.trim(host))
