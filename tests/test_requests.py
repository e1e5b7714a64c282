"""Requests that follow one another on a song, against a sequential loop."""

from __future__ import annotations

import random

import pytest

from tabspark.operators import catalog as C
from tabspark.operators import edits as E

SONG = ["song", "track"]


def loop(notes, edits):
    """(frets by place, reason by request, beats without notes) of one request after another; each all or nothing."""
    frets = {(s, t, b, g): f for s, t, b, g, f, _ in notes}
    tied = {(s, t, b, g) for s, t, b, g, _, tie in notes if tie}
    beats = {(s, t, b) for s, t, b, *_ in notes}
    neck = {(s, t): max(30, *(f for s2, t2, _, _, f, _ in notes if (s2, t2) == (s, t))) for s, t, *_ in notes}

    def chain(place):
        s, t, b, g = place
        while (s, t, b, g) in tied and (s, t, b - 1, g) in first:
            b -= 1
        out = [(s, t, b, g)]
        while (s, t, b + 1, g) in tied:
            b += 1
            out.append((s, t, b, g))
        return out

    first, reasons = dict(frets), {}
    for line in sorted({e[:3] for e in edits}, key=lambda k: (k[0] or 0, *k[1:])):
        held, reason = dict(frets), None
        for _, _, _, _, b, g, expected, new in sorted((e for e in edits if e[:3] == line), key=lambda e: e[3]):
            place = (line[0], line[1], b, g)
            if held.get(place) is None or held[place] != expected:
                reason = "gone"
            elif new is not None and new > neck[line[:2]]:
                reason = "fret"
            if reason:
                break
            held.update({p: new for p in chain(place)})
        reasons[line] = reason
        frets = frets if reason else held
    heard = {k[:3] for k, f in frets.items() if f is not None}
    return {k: f for k, f in frets.items() if f is not None}, reasons, beats - heard


def random_song(seed):
    rnd = random.Random(seed)
    notes = []
    for s, t in [(1, 0), (1, 1), (2, 0), (None, 0)]:
        fret = {}
        for b in range(40 if s == 1 else 6):
            for g in range(1, 4):
                if rnd.random() < 0.7:
                    tie = rnd.random() < 0.4 and (s, t, b - 1, g) in fret
                    fret[s, t, b, g] = fret[s, t, b - 1, g] if tie else rnd.randint(0, 12)
                    notes.append((s, t, b, g, fret[s, t, b, g], tie))
    edits = []
    for s, t in [(1, 0), (1, 1), (2, 0), (None, 0)]:
        for r in range(25 if s == 1 else 5):
            for q in range(rnd.randint(1, 3)):
                b, g = rnd.randrange(8 if rnd.random() < 0.6 else 42), rnd.randint(1, 3)
                known = next((n[4] for n in notes if n[:4] == (s, t, b, g)), 3)
                new = rnd.choice([None, known, known, known + 1, known + 1, 40])
                edits.append((s, t, r, q, b, g, known + (rnd.random() < 0.1), new))
    return notes, edits


@pytest.mark.parametrize("split", [None, "11"])
def test_requests_follow_one_another(spark, split):
    notes, edits = random_song(5)
    n = spark.createDataFrame(notes, "song int, track int, beat long, string int, fret int, tie boolean")
    e = spark.createDataFrame(edits, "song int, track int, request long, seq int, beat long, string int, expected int, fret int")
    if split:
        spark.conf.set("spark.tabspark.splitRows", split)
    try:
        after, requests, rests = E.apply_requests(n, e, SONG, "string", "beat", "tie", "fret", "request", "seq")
        got = after.collect(), requests.collect(), rests.collect()
    finally:
        spark.conf.unset("spark.tabspark.splitRows")
    frets, reasons, emptied = loop(notes, edits)
    assert {(r.song, r.track, r.request): r.reason for r in got[1]} == reasons
    assert {None, "gone", "fret"} == set(reasons.values()) and sum(v is None for v in reasons.values()) > 10
    assert {(r.song, r.track, r.beat, r.string): r.fret for r in got[0]} == frets
    assert {(r.song, r.track, r.beat) for r in got[2]} == emptied and emptied


def test_a_refusal_frees_the_request_after_it(spark):
    """Each request expects what the one before it would leave, and the first is refused: every other one is accepted."""
    n = spark.createDataFrame([(1, 0, 1, 5, False), (1, 1, 1, 3, False)], "song int, beat long, string int, fret int, tie boolean")
    rows = [(1, 0, 0, 0, 1, 9, 6), (1, 1, 0, 0, 1, 5, 6), (1, 2, 0, 0, 1, 5, 7), (1, 3, 0, 0, 1, 6, 8), (1, 4, 0, 1, 1, 3, None), (1, 5, 0, 1, 1, 3, 4)]
    e = spark.createDataFrame(rows, "song int, request long, seq int, beat long, string int, expected int, fret int")
    after, requests, rests = E.apply_requests(n, e, ["song"], "string", "beat", "tie", "fret", "request", "seq")
    assert [r.reason for r in requests.orderBy("request").collect()] == ["gone", None, "gone", None, None, "gone"]
    assert [(r.beat, r.fret) for r in after.collect()] == [(0, 8)] and [r.beat for r in rests.collect()] == [1]


def test_no_requests(spark):
    n = spark.createDataFrame([(1, 0, 1, 5, False)], "song int, beat long, string int, fret int, tie boolean")
    e = spark.createDataFrame([], "song int, request long, seq int, beat long, string int, expected int, fret int")
    after, requests, rests = E.apply_requests(n, e, ["song"], "string", "beat", "tie", "fret", "request", "seq")
    assert after.count() == 1 and requests.count() == 0 and rests.count() == 0


def ticks(value, dotted=False, triplet=False):
    out = 3840 // value
    out = out * 3 // 2 if dotted else out
    return out * 2 // 3 if triplet else out


def bars_after(beats, edits, capacity):
    """(bars, reasons) of one request after another, each edit by a search for the first rests that add up."""
    plain, threes = [ticks(1 << k) for k in range(6)], [ticks(1 << k, triplet=True) for k in range(6)]

    def fill(room):
        for v in plain + threes if room % 120 == 0 else threes + plain:
            if v <= room and (rest := [] if v == room else fill(room - v)) is not None:
                return [v, *rest]

    bars, reasons = {}, {}
    for song, bar, _, t, rest in sorted(beats):
        bars.setdefault((song, bar), []).append((t, rest))
    for line in sorted({(e[0], e[2]) for e in edits}):
        held, reason = {k: list(v) for k, v in bars.items()}, None
        for song, bar, _, _, at, expected, new in sorted((e for e in edits if (e[0], e[2]) == line), key=lambda e: e[3]):
            b = held.get((song, bar), [])
            if at >= len(b) or b[at][0] != expected:
                reason = ("gone", None)
                break
            b[at] = (new, b[at][1])
            while len(b) > at + 1 and b[-1][1]:
                b.pop()
            room = capacity - sum(t for t, _ in b)
            filled = [] if room == 0 else fill(room) if room > 0 else None
            if filled is None:
                reason = ("full", -room) if room < 0 else ("invalid", None)
                break
            b += [(v, True) for v in filled]
        reasons[line] = reason
        bars = bars if reason else held
    return bars, reasons


BEATS = "song int, bar long, beat long, ticks int, rest boolean"
LENGTHS = "song int, bar long, request long, seq int, beat long, expected int, new_ticks int"


def test_rests_fill_as_a_search_would():
    rests = E.rests_filling(3840)
    assert rests[2560 + 640] == [2560, 640] and rests[200] == [80, 120] and rests[360] == [240, 120] and 40 not in rests and 60 not in rests
    assert all(sum(v) == k for k, v in rests.items())


def test_triplets_one_beat_at_a_time(spark):
    """Three quarters made triplet eighths one by one: a triplet's rest at the bar's end until the third one is there."""
    beats = [(1, 0, i, 960, i == 3) for i in range(4)]
    rows = [(1, 0, r, 0, r, 960, 320) for r in range(3)]
    df, sent = spark.createDataFrame(beats, BEATS), spark.createDataFrame(rows, LENGTHS)
    for n, want in ((1, [320, 960, 960, 1280, 320]), (3, [320, 320, 320, 1920, 960])):
        after, requests = E.apply_length_requests(df, sent.where(f"request < {n}"), ["song"], ["bar"], "beat", "ticks", "rest", 3840, "request", "seq")
        assert [r.reason for r in requests.collect()] == [None] * n
        assert [r.ticks for r in after.orderBy("beat").collect()] == want and sum(want) == 3840


@pytest.mark.parametrize("split", [None, "11"])
def test_length_requests_against_a_loop(spark, split):
    rnd = random.Random(21)
    sizes = [ticks(v, d, t) for v in (2, 4, 8, 16) for d in (False, True) for t in (False, True) if not (d and t)]
    beats, edits = [], []
    for song in (1, 2, 3):
        for bar in range(6):
            left, i = 3840, 0
            while left > 0:
                t = min(rnd.choice([480, 960, 1920, 320]), left)
                beats.append((song, bar, i, t, rnd.random() < 0.5))
                left, i = left - t, i + 1
        for r in range(20):
            for q in range(rnd.randint(1, 3)):
                bar, at = rnd.randrange(7), rnd.randrange(5)
                known = next((b[3] for b in beats if b[:3] == (song, bar, at)), 480)
                edits.append((song, bar, r, q, at, rnd.choice([known, known, known, 960]), rnd.choice([known, *sizes, 180])))
    if split:
        spark.conf.set("spark.tabspark.splitRows", split)
    try:
        after, requests = E.apply_length_requests(
            spark.createDataFrame(beats, BEATS), spark.createDataFrame(edits, LENGTHS), ["song"], ["bar"], "beat", "ticks", "rest", 3840, "request", "seq"
        )
        got, said = after.collect(), requests.collect()
    finally:
        spark.conf.unset("spark.tabspark.splitRows")
    bars, reasons = bars_after(beats, edits, 3840)
    assert {(r.song, r.request): (r.reason, r.missing_ticks) if r.reason else None for r in said} == reasons
    assert {None, "gone", "full"} <= {v and v[0] for v in reasons.values()}
    made = {}
    for r in sorted(got, key=lambda r: (r.song, r.bar, r.beat)):
        made.setdefault((r.song, r.bar), []).append((r.ticks, r.rest))
    assert made == bars


def test_settings_are_judged_by_type(spark):
    text = '{"audio": {"a": "NaN", "b": "[Chorus]", "c": 1.5, "d": true, "e": [1], "f": {"x": 1}, "g": null, "h": "{not nested", "i": -3, "a": "later"}, "video": {"v": "%s"}, "other": {"z": 1}}'
    rows = [(0, text % ("w" * 3000)), (1, "not json"), (2, None), (3, '{"audio": 5}'), (4, '{"audio": {%s}}' % ", ".join(f'"k{i}": {i}' for i in range(30)))]
    df = spark.createDataFrame(rows, "id int, settings string")
    got = {r.id: (r.audio_settings, r.video_settings) for r in C.clean_settings(df, "settings").collect()}
    assert got[0] == ({"a": "later", "b": "[Chorus]", "c": "1.5", "d": "true", "h": "{not nested", "i": "-3"}, {"v": "w" * 3000})
    assert got[1] == got[2] == got[3] == ({}, {}) and len(got[4][0]) == 30
    cut = {r.id: (r.audio_settings, r.video_settings) for r in C.clean_settings(df, "settings", 20, 40, 2000, 1000).collect()}
    assert cut[0] == ({}, {}) and len(cut[4][0]) == 20


def test_only_songs_that_moved_are_judged_again(spark):
    """Song 1 settles in the first round; from then on only song 2, where each refusal frees the request after it, is judged."""
    asked = [(1, r, None) for r in range(3)] + [(2, r, None) for r in range(3)]
    judged = []

    def judge(known):
        rows = known.collect()
        judged.append({r.song for r in rows})
        bad = {(2, 0), (2, 2)} if len(judged) > 1 else {(2, 0), (2, 1)}
        out = [(r.song, r.request, "gone" if (r.song, r.request) in bad else None, r.reason is None) for r in rows]
        return spark.createDataFrame(out, "song int, request int, reason string, _was boolean")

    start = spark.createDataFrame(asked, "song int, request int, reason string")
    got = {(r.song, r.request): r.reason for r in E.settled(start, judge, ["song"]).collect()}
    assert got == {(s, r): "gone" if s == 2 and r != 1 else None for s in (1, 2) for r in range(3)}
    assert judged == [{1, 2}, {2}, {2}]


def test_requests_on_songs_of_one_bar(spark):
    """Without bar columns a song is one bar, judged in one pass."""
    rows = [(s, b, 960, b > 1) for s in (1, None) for b in range(4)]
    beats = spark.createDataFrame(rows, "song int, beat long, ticks int, rest boolean")
    sent = [(s, 0, 0, 0, 960, 1920) for s in (1, None)] + [(1, 1, 0, 0, 960, 480), (1, 2, 0, 1, 960, 1920), (1, 3, 0, 1, 1920, 2880), (None, 1, 0, 0, 1920, 480)]
    e = spark.createDataFrame(sent, "song int, request long, seq int, beat long, expected int, new_ticks int")
    after, requests = E.apply_length_requests(beats, e, ["song"], [], "beat", "ticks", "rest", 3840, "request", "seq")
    reasons = {(r.song, r.request): (r.reason, r.missing_ticks) for r in requests.collect()}
    assert reasons == {(1, 0): (None, None), (1, 1): ("gone", None), (1, 2): (None, None), (1, 3): ("full", 960), (None, 0): (None, None), (None, 1): (None, None)}
    got = {(r.song, r.beat): (r.ticks, r.rest) for r in after.collect()}
    assert got == {(1, 0): (1920, False), (1, 1): (1920, False), (None, 0): (480, False), (None, 1): (960, False), (None, 2): (1920, True), (None, 3): (480, True)}
