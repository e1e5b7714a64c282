"""Corrections sent in requests: checked, then applied as compare-and-set, a request as a whole or not at all."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordered import Ordered, fill, gathered, lag, large_keys, lead, meet, number, ordered, running_sum, total_max, total_sum
from ..functions.session import checkpoint, split_rows

MAX_EDITS, MAX_FRET = 500, 30  # fixed values: edits of a request, frets of a neck, and the bounds of the places
BOUNDS = {"track": (0, 63), "bar": (0, 9999), "voice": (0, 1), "beat": (0, 999), "string": (1, 12), "expected": (0, 99)}


def check_edits(edits: DataFrame, request: str, fret: str) -> DataFrame:
    """Whether each request may run: 1 to 500 edits, every field in its bounds; one bad edit refuses the request."""
    ok = reduce(lambda a, b: a & b, [F.coalesce(F.col(c).between(low, high), F.lit(False)) for c, (low, high) in BOUNDS.items()])
    ok = ok & (F.col(fret).isNull() | F.col(fret).between(0, 99))
    return edits.groupBy(request).agg(F.every(ok).alias("_ok"), F.count("*").alias("edits")).select(
        request, "edits", (F.col("_ok") & (F.col("edits") <= MAX_EDITS)).alias("accepted")
    )


def tied_chains(notes: DataFrame, keys: Sequence[str], beat: str, tie: str, like: Ordered | None = None) -> DataFrame:
    """Number of the tied chain of each note (key includes the string): a chain goes on while notes are tied and adjacent."""
    line = ordered(notes, keys, [beat], like).add(_p=lag(beat))
    starts = ~F.col(tie) | F.col("_p").isNull() | (F.col(beat) != F.col("_p") + 1)
    return line.islands("chain", starts).df.drop("_p")


def repair_ties(notes: DataFrame, keys: Sequence[str], beat: str, tie: str, fret: str) -> DataFrame:
    """A tied note takes the fret of the last note struck on its string; a tied one with nothing before it counts as struck."""
    line = ordered(notes, keys, [beat]).add(_i=number())
    line = line.add(_f=fill(F.when(~F.col(tie) | (F.col("_i") == 1), F.struct(F.col(fret).alias("f")))))
    return line.df.withColumn("fret_repaired", F.col("_f")["f"]).drop("_f", "_i")


def apply_note_edits(
    notes: DataFrame, edits: DataFrame, song: Sequence[str], string: str, beat: str, tie: str, fret: str, request: str, seq: str,
    like: Ordered | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(notes after the edits, requests with whether they applied).

    An edit names a note and the fret it expects; it changes the whole tied chain (a null fret removes it). The
    edits of a request follow one another: within a chain each must expect what the one before left. A request
    with any edit that fails is refused as a whole. Each song has one request.
    """
    song = list(song)
    place, line = [*song, string], [*song, request]
    whole = ordered(notes, song, [string, beat], like)  # its look at the songs serves all scans of notes
    chained = tied_chains(gathered(notes, song, whole), place, beat, tie, like=whole)
    chained = ordered(chained, song, [string, beat], like=whole).add(_neck=total_max(fret)).df
    sent = ordered(edits, song, [request, seq], like)
    aimed = gathered(edits.select(request, seq, *place, beat, "expected", F.col(fret).alias("_new")), song, sent).join(
        chained.select(*place, beat, "chain", F.col(fret).alias("_now"), "_neck"), [*place, beat], "left"
    )
    # A chain's frets are equal, so the edits of a chain form one line: each sees the fret the last one left.
    steps = ordered(aimed, [*line, string, "chain"], [seq], like=sent).add(_left=lag(F.struct(F.col("_new").alias("f")))).df
    seen = F.when(F.col("_left").isNull(), F.col("_now")).otherwise(F.col("_left")["f"])
    good = F.col("chain").isNotNull() & F.coalesce(seen == F.col("expected"), F.lit(False)) & (
        F.col("_new").isNull() | (F.col("_new") <= F.greatest(F.lit(MAX_FRET), F.lit(24), F.col("_neck")))
    )
    judged = steps.withColumn("_good", good)
    # One row per song and request meets the verdict; the edits themselves stay with their song.
    by_song = judged.groupBy(*line).agg(F.every("_good").alias("_ok"))
    requests = by_song.groupBy(request).agg((F.every("_ok") & F.col(request).isNotNull()).alias("applied"))
    passed = gathered(by_song.select(*line).join(requests.where("applied"), request, "left_semi"), song, sent)
    done = judged.where("chain is not null").join(passed, line, "left_semi")
    last = done.groupBy(*place, "chain").agg(F.max_by(F.struct(F.col("_new").alias("f")), seq).alias("_to"))
    out = chained.drop("_neck").join(last, [*place, "chain"], "left")
    removed = F.col("_to").isNotNull() & F.col("_to")["f"].isNull()
    changed = F.when(F.col("_to").isNotNull(), F.col("_to")["f"]).otherwise(F.col(fret))
    after = out.where(~removed).withColumn(fret, changed).drop("_to", "chain")
    return after, requests


def settled(requests: DataFrame, judge: Callable[[DataFrame], DataFrame], song: Sequence[str]) -> DataFrame:
    """Requests that follow one another, each seeing what the accepted ones of its song before it left, with their ``reason``.

    All requests without a flaw of their own are taken for accepted first. ``judge`` gives each one's reason (null: none)
    under the verdicts so far, and whether it was accepted then (``_was``). A verdict depends on earlier requests only, so
    each round settles at least one more request of each line, and the first round that changes nothing in a song is the answer of a
    sequential loop. Only songs in which a verdict changed are judged again.
    """
    known, done = requests, []
    while True:
        again = checkpoint(judge(known))
        moved = again.where(F.col("reason").isNull() != F.col("_was")).select(*song).distinct()
        if moved.isEmpty():
            return reduce(DataFrame.unionByName, [*done, again]).drop("_was")
        moved = checkpoint(moved)
        done.append(meet(again, moved, song, "left_anti"))
        known = checkpoint(meet(again, moved, song, "left_semi").drop("_was"))


ROUNDS = 4  # rounds of verdicts that follow one another without a shuffle, where a song fits a task


def apply_requests(
    notes: DataFrame, edits: DataFrame, song: Sequence[str], string: str, beat: str, tie: str, fret: str, request: str, seq: str
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(notes after all requests, each request's ``reason`` of refusal or null, beats that lost their last note).

    The requests of a song follow one another in the order of ``request``, the edits of one in the order of ``seq``. An edit names a note
    and the fret it expects there; it sets the fret of the whole tied chain, or removes it (null fret). A request with an edit
    that finds no such note ("gone") or wants a fret beyond the neck ("fret") changes nothing; the first such edit gives
    the reason. Edits of a chain meet in a scan over that chain, so a song with many requests needs no task of its own.
    Repeated rows of edits are edits of their own only if ``seq`` tells them apart.
    """
    place, line = [*song, string], [*song, request]
    chained = checkpoint(tied_chains(notes, place, beat, tie))
    necks = notes.groupBy(*song).agg(F.greatest(F.max(fret), F.lit(24), F.lit(MAX_FRET)).alias("_neck"))
    sent = edits.select(*place, beat, request, seq, "expected", F.col(fret).alias("_new"))
    aimed = meet(sent, chained.select(*place, beat, "chain", F.col(fret).alias("_now")), [*place, beat], "left")
    aimed = checkpoint(meet(aimed, necks, song, "left").withColumn("_high", F.coalesce(F.col("_new") > F.col("_neck"), F.lit(False))).drop("_neck"))
    missed = F.when(F.col("chain").isNull() | (F.col("_now").isNull()), "gone").when(F.col("_high"), "fret")

    hits = aimed.where("chain is not null")
    by_chain = ordered(aimed, [*place, "chain"], [request, seq])
    in_tasks = large_keys(aimed, song, split_rows(notes.sparkSession)).isEmpty()
    of_request = Window.partitionBy(*line)

    def judged(rows: DataFrame) -> DataFrame:
        rows = ordered(rows, [*place, "chain"], [request, seq], like=by_chain).add(
            _own=lag(F.struct(F.col(request).alias("r"), F.col("_new").alias("f"))),
            _left=fill(F.when(F.col("_in"), F.struct(F.col("_new").alias("f"))), before=True),
        )
        seen = F.when(F.col("_own")["r"] == F.col(request), F.col("_own")["f"]).when(F.col("_left").isNotNull(), F.col("_left")["f"]).otherwise(F.col("_now"))
        found = F.col("chain").isNotNull() & F.coalesce(seen == F.col("expected"), F.lit(False))
        return rows.df.withColumn("_r", F.when(~found, "gone").when(F.col("_high"), "fret")).drop("_own", "_left")

    def judge(known: DataFrame) -> DataFrame:
        rows = meet(aimed, known.select(*line, F.col("reason").isNull().alias("_in")), line)
        if in_tasks:
            rows = rows.repartition(*song)
            for _ in range(ROUNDS - 1):
                rows = judged(rows).withColumn("_in", ~F.max(F.col("_r").isNotNull()).over(of_request))
        bad = F.when(F.col("_r").isNotNull(), F.col(seq))
        return judged(rows).groupBy(*line).agg(F.min_by("_r", bad).alias("reason"), F.max("_in").alias("_was"))

    start = aimed.withColumn("_r", missed).groupBy(*line).agg(F.min_by("_r", F.when(F.col("_r").isNotNull(), F.col(seq))).alias("reason"))
    requests = settled(start, judge, song)
    done = meet(hits, requests.where("reason is null").select(*line), line, "left_semi")
    last = done.groupBy(*place, "chain").agg(F.max_by(F.struct(F.col("_new").alias("f")), F.struct(request, seq)).alias("_to"))
    out = meet(chained, last, [*place, "chain"], "left")
    gone = F.col("_to").isNotNull() & F.col("_to")["f"].isNull()
    after = out.where(~gone).withColumn(fret, F.when(F.col("_to").isNotNull(), F.col("_to")["f"]).otherwise(F.col(fret))).drop("_to", "chain")
    # A beat without notes is a rest now.
    left = out.groupBy(*song, beat).agg(F.every(gone).alias("_gone")).where("_gone").drop("_gone")
    return after, requests, left


def filling_rests(units: Column) -> Column:
    """Lengths of the rests that fill so many 32nds: plain values only, the longest first."""
    whole = F.array_repeat(F.lit(32), F.floor(units / 32).cast("int"))
    rest = (units % 32).cast("int")
    return F.concat(whole, F.filter(F.array(*[F.lit(v) for v in (16, 8, 4, 2, 1)]), lambda v: rest.bitwiseAND(v) > 0))


def apply_length_edits(
    beats: DataFrame, edits: DataFrame, bar_keys: Sequence[str], beat: str, units: str, rest: str, capacity: int
) -> tuple[DataFrame, DataFrame]:
    """(beats after one length edit per bar, edits with whether they applied and the 32nds missing).

    The rests at the bar's end, after the edited beat, give or take the time and are filled again with the longest rests.
    """
    line = ordered(beats, bar_keys, [beat]).add(_played=total_sum(F.when(~F.col(rest), 1).otherwise(0)), _seen=running_sum(F.when(~F.col(rest), 1).otherwise(0)))
    trailing = F.col(rest) & (F.col("_seen") == F.col("_played"))
    data = line.df.withColumn("_trail", trailing).drop("_played", "_seen")
    wanted = edits.select(*bar_keys, F.col(beat).alias("_eb"), F.col("expected").alias("_ex"), F.col("new_units").alias("_new"))
    both = data.join(wanted, list(bar_keys))
    aimed = F.col(beat) == F.col("_eb")
    stays = ~F.col("_trail") | (F.col(beat) <= F.col("_eb"))
    size = F.when(aimed, F.col("_new")).otherwise(F.col(units))
    per_bar = both.groupBy(*bar_keys).agg(
        F.coalesce(F.bool_or(aimed & (F.col(units) == F.col("_ex"))), F.lit(False)).alias("_found"),
        F.sum(F.when(stays, size).otherwise(0)).alias("_sum"), F.max(F.when(stays, F.col(beat))).alias("_last"),
    )
    judged = wanted.join(per_bar, list(bar_keys), "left").withColumn("_room", capacity - F.col("_sum"))
    applied = F.coalesce(F.col("_found") & (F.col("_room") >= 0), F.lit(False))
    missing = F.when(F.col("_found") & (F.col("_room") < 0), -F.col("_room"))
    results = judged.select(*bar_keys, applied.alias("applied"), missing.alias("missing_units"))
    good = judged.where(applied)
    kept = both.where(stays).join(good.select(*bar_keys), list(bar_keys), "left_semi").select(*bar_keys, beat, size.alias(units), rest)
    added = good.select(*bar_keys, "_last", F.posexplode(filling_rests(F.col("_room"))).alias("_k", units))
    added = added.select(*bar_keys, (F.col("_last") + 1 + F.col("_k")).alias(beat), F.col(units), F.lit(True).alias(rest))
    same = beats.select(*bar_keys, beat, units, rest).join(good.select(*bar_keys), list(bar_keys), "left_anti")
    return same.unionByName(kept).unionByName(added), results


# Ticks of a 32nd note, and of the rests that fill a bar's end: plain ones, then those of triplets.
TICKS_32ND = 120
PLAIN_RESTS = tuple(TICKS_32ND * v for v in (32, 16, 8, 4, 2, 1))
TRIPLET_RESTS = tuple(v * 2 // 3 for v in PLAIN_RESTS)


def rests_filling(capacity: int) -> dict[int, list[int]]:
    """Rests for every number of ticks up to ``capacity`` that rests can fill, the preferred first one first.

    Whole 32nds take plain rests before those of triplets, other times the other way round; the longest that leaves
    something rests can fill comes first. Shorter times are known when a longer one is looked up.
    """
    known: dict[int, list[int]] = {0: []}
    step = TRIPLET_RESTS[-1] // 2
    for ticks in range(step, capacity + 1, step):
        order = PLAIN_RESTS + TRIPLET_RESTS if ticks % TICKS_32ND == 0 else TRIPLET_RESTS + PLAIN_RESTS
        first = next((v for v in order if ticks - v in known), None)
        if first is not None:
            known[ticks] = [first, *known[ticks - first]]
    return known


def _bar_after(bar: list[tuple[int, bool]], at: int, expected: int, length: int, capacity: int, rests: dict[int, list[int]]):
    """(bar, reason, ticks missing) of one length edit; a bar is (ticks, rest) of each beat."""
    if not 0 <= at < len(bar) or bar[at][0] != expected:
        return bar, "gone", None
    played = max((k for k, (_, rest) in enumerate(bar) if not rest), default=-1)
    kept = [*bar[:at], (length, bar[at][1]), *bar[at + 1 : max(at, played) + 1]]
    room = capacity - sum(ticks for ticks, _ in kept)
    if room < 0:
        return bar, "full", -room
    if room not in rests:
        return bar, "invalid", None
    return [*kept, *((v, True) for v in rests[room])], None, None


def _length_runner(keys: list[str], capacity: int, request: str):
    """Edits of each bar in order: the state is the bar as the accepted requests leave it, and as this request does so far.

    Beats of a bar are numbers here: twice the ticks, and one more for a rest.
    """
    rests = rests_filling(capacity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current = sent = None
        base: list = []
        bar: list = []
        broken = False
        for held in batches:
            reasons, missing, bars = [], [], []
            places = zip(*(held.column(c).to_pylist() for c in keys))
            columns = (held.column(c).to_pylist() for c in (request, "_at", "_expected", "_length", "_in", "_ends", "_last", "_bar"))
            for key, (asked, at, expected, length, taken, ends, last, beats) in zip(places, zip(*columns)):
                if key != current:
                    current, sent = key, None
                    base = [(b >> 1, bool(b & 1)) for b in beats or ()]
                if asked != sent:
                    sent, bar, broken = asked, base, False
                reason, short = None, None
                if not broken:
                    bar, reason, short = _bar_after(bar, at, expected, length, capacity, rests)
                    broken = reason is not None
                if taken and not broken and ends:
                    base = bar
                reasons.append(reason)
                missing.append(short)
                bars.append([2 * t + r for t, r in base] if last else None)
            kept = held.select([*keys, request, "_seq", "_in"])
            made = [pa.array(reasons, pa.string()), pa.array(missing, pa.int64()), pa.array(bars, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([*kept.columns, *made], names=[*kept.schema.names, "_r", "_short", "_after"])

    return run


def apply_length_requests(
    beats: DataFrame, edits: DataFrame, song: Sequence[str], bar: Sequence[str], beat: str, ticks: str, rest: str, capacity: int, request: str, seq: str
) -> tuple[DataFrame, DataFrame]:
    """(beats after all requests, each request's ``reason`` of refusal or null and the ticks missing).

    Beats of a bar (song, bar) are numbered from 0. A length edit names a beat and the ticks it expects (``expected``); ``new_ticks`` is
    its length from then on. The rests after it at the bar's end give or take the time and are filled again with the
    longest rests, those of triplets only for what plain ones can't make, so every bar stays whole. Reasons: "gone" (no such beat
    or another length), "full" (time is missing), "invalid" (no rests add up). Requests of a song follow one another and are
    accepted as a whole, over all their bars; the edits of a bar stream through its task in order.
    """
    keys, line = [*song, *bar], [*song, request]
    whole = beats.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(beat, F.col(ticks).cast("int").alias("ticks"), F.col(rest).alias("rest")))), lambda b: 2 * b["ticks"] + F.coalesce(b["rest"], F.lit(False)).cast("int")).alias("_bar")
    )  # a bar is a bounded list
    sent = edits.select(
        *keys, request, F.col(seq).alias("_seq"), F.col(beat).cast("long").alias("_at"), F.col("expected").cast("long").alias("_expected"), F.col("new_ticks").cast("long").alias("_length")
    ).na.fill(-1, ["_at", "_expected"])
    rows = ordered(meet(sent, whole, keys, "left"), keys, [request, "_seq"]).add(_next=lead(request))
    rows = checkpoint(rows.df.withColumns({"_last": F.col("_next").isNull(), "_ends": F.col("_next").isNull() | (F.col("_next") != F.col(request))}))
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in (*keys, request, "_seq")), "_in boolean, _r string, _short long, _after array<int>"])

    def stepped(known: DataFrame) -> DataFrame:
        data = known.repartition(*keys).sortWithinPartitions(*keys, request, "_seq")
        return data.mapInArrow(_length_runner(keys, capacity, request), schema)

    def verdicts(found: DataFrame) -> DataFrame:
        bad = F.when(F.col("_r").isNotNull(), F.struct("_seq", *bar))
        return found.groupBy(*line).agg(F.min_by("_r", bad).alias("reason"), F.min_by("_short", bad).alias("missing_ticks"), F.max("_in").alias("_was"))

    if bar:
        def taken(known: DataFrame) -> DataFrame:
            return meet(rows, known.select(*line, F.col("reason").isNull().alias("_in")), line)

        start = rows.select(*line).distinct().withColumns({"reason": F.lit(None).cast("string"), "missing_ticks": F.lit(None).cast("long")})
        requests = settled(start, lambda known: verdicts(stepped(taken(known))), song)
        after = stepped(taken(requests))
    else:  # a song is one bar, so the first pass is the sequential loop itself
        after = checkpoint(stepped(rows.withColumn("_in", F.lit(True))))
        requests = verdicts(after).drop("_was")
    done = after.where("_after is not null").select(*keys, F.posexplode("_after").alias(beat, "_b"))
    length, is_rest = F.shiftright("_b", 1), F.col("_b").bitwiseAND(1) == 1
    changed = done.select(*keys, F.col(beat).cast(beats.schema[beat].dataType).alias(beat), length.cast(beats.schema[ticks].dataType).alias(ticks), is_rest.alias(rest))
    same = meet(beats.select(*keys, beat, ticks, rest), edits.select(*keys).distinct(), keys, "left_anti")
    return same.unionByName(changed), requests
