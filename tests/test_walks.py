"""Staves, lyric placement and level ramps against known results or a loop."""

from __future__ import annotations

import random
from fractions import Fraction

import pytest

from tabspark.operators import attach as A
from tabspark.operators import layout as L
from tabspark.operators import lyrics as Y
from tabspark.operators import rhythm as R


def test_staves(spark):
    rows = [(1, i, 10.0 * i, 0.0, 100.0) for i in range(6)]
    rows += [(1, 10, 24.0, 10.0, 60.0)]  # a short line inside the staff is passed over
    rows += [(1, 20 + i, 200.0 + 8.0 * i, 0.0, 100.0) for i in range(4)] + [(1, 40, 400.0, 0.0, 100.0), (1, 41, 410.0, 0.0, 100.0)]
    got = L.find_staves(spark.createDataFrame(rows, "page int, line_no long, y double, x0 double, x1 double"), ["page"])
    assert [(r.strings, r.top, r.bottom) for r in got.orderBy("top").collect()] == [(6, 0.0, 50.0), (4, 200.0, 224.0)]


def test_lyrics_fall_on_played_beats(spark):
    quarters = [0.0, 0.25, 0.5, 0.75]
    beats = spark.createDataFrame([(1, bar, p) for bar in (1, 3) for p in quarters], "song int, bar long, place double")
    words = [(1, 0, 1, 0.0, False), (1, 1, 1, 0.5, True), (1, 2, 1, 0.6, False), (1, 3, 2, 0.0, False), (1, 4, 3, 0.3, False)]
    syllables = spark.createDataFrame(words, "song int, i long, bar long, place double, joins boolean")
    got = [r.beat for r in Y.assign_lyrics(syllables, beats, ["song"], "i").orderBy("i").collect()]
    assert got == [0, 2, 3, None, 5]  # the bar that rests keeps no syllable


def test_ramps(spark):
    notes = spark.createDataFrame([(1, i, float(x)) for i, x in enumerate((5, 10, 35, 60, 80))], "k int, nid long, x double")
    pins = spark.createDataFrame([(1, 0, 10.0, 60.0, 1)], "k int, pid long, x0 double, x1 double, direction int")
    marks = spark.createDataFrame([(1, 0, 2.0, 47)], "k int, mid long, x double, value int")
    got = [r.level for r in R.ramps(notes, pins, marks, ["k"], 0.5, 6.0).orderBy("nid").collect()]
    assert got == [None, 47, 63, 79, None]  # p, mp, mf over the hairpin


def bars_of(items, capacity):
    """(bar, start in 32nds, item, units, tuplet, tie) of items laid end to end, by a loop over exact fractions."""
    out, bar, filled = [], 0, Fraction(0)

    def plain(length, item, tied):
        at, rest = filled, int(length)
        for v in R.REPRESENTABLE_UNITS:
            while rest >= v:
                out.append((bar, at, item, v, False, tied))
                at, rest, tied = at + v, rest - v, tied or item is not None
        return tied

    for item, units, three in items:
        if three:
            out.append((bar, filled, item, units, True, False))
            filled += Fraction(2 * units, 3)
            if filled >= capacity:
                bar, filled = bar + 1, Fraction(0)
            continue
        left, tied = Fraction(units), False
        while left > 0:
            take = min(capacity - filled, left)
            tied = plain(take, item, tied)
            filled, left = filled + take, left - take
            if filled == capacity:
                bar, filled = bar + 1, Fraction(0)
    if any(b == bar for b, *_ in out):
        plain(capacity - filled, None, False)
    return out


@pytest.mark.parametrize("split", [None, "11"])
def test_triplets_fill_bars(spark, split):
    rnd = random.Random(12)
    lengths = {1: [(i, rnd.choice([1, 2, 3, 4, 6, 8, 40, 70]), rnd.random() < 0.4) for i in range(400)]}
    lengths |= {k: [(i, rnd.choice([1, 2, 4, 8]), rnd.random() < 0.5) for i in range(rnd.randint(1, 9))] for k in range(2, 40)}
    lengths[None] = [(0, 4, True), (1, 4, True), (2, 4, True), (3, 8, None), (4, 16, False)]
    rows = [(k, i, u, t) for k, items in lengths.items() for i, u, t in items] + [(50, 0, None, True), (50, 1, 0, False)]
    df = spark.createDataFrame(rows, "k int, i long, u int, t boolean")
    if split:
        spark.conf.set("spark.tabspark.splitRows", split)
    try:
        got = R.pack_triplet_bars(df, ["k"], "i", "u", "t", 32).collect()
    finally:
        spark.conf.unset("spark.tabspark.splitRows")
    want = [(k, b, int(3 * at), i, u, three, tie) for k, items in lengths.items() for b, at, i, u, three, tie in bars_of(items, 32)]
    assert sorted(map(repr, ((r.k, r.bar, r.at3, r.item, r.units, r.tuplet, r.tie) for r in got))) == sorted(map(repr, want))


def test_isolated_glyphs_overlap(spark, chunks):
    rows = [(1, 0, 0.0, 10.0), (1, 1, 1.0, 2.0), (1, 2, 10.2, 12.2), (1, 3, 40.0, 44.0), (1, 4, 46.5, 47.0), (2, 0, 5.0, 6.0)]
    got = A.isolated(spark.createDataFrame(rows, "line int, gid long, x0 double, x1 double"), ["line"], "x0", "x1", "gid")
    assert sorted((r.line, r.gid) for r in got.collect()) == [(1, 1), (1, 3), (1, 4), (2, 0)]


@pytest.mark.parametrize("split", [None, "11"])
def test_bends_over_ties(spark, split):
    rnd = random.Random(3)
    rows = [(k, i, rnd.random() < 0.7, rnd.choice([0, 0, 0, 2, 4]), rnd.random() < 0.3) for k in range(12) for i in range(30)]
    rows += [(99, 0, False, 2, True), (99, 1, True, 0, False), (99, 2, True, 2, False)]
    if split:
        spark.conf.set("spark.tabspark.splitRows", split)
    try:
        df = spark.createDataFrame(rows, "k int, i long, tie boolean, bend int, rel boolean")
        got = {(r.k, r.i): (r.held_bend, r.pre_bend) for r in R.hold_bends(df, ["k"], "i", "tie", "bend", "rel").collect()}
    finally:
        spark.conf.unset("spark.tabspark.splitRows")
    want, key, last = {}, None, None
    for k, i, tie, bend, rel in rows:
        last = last if k == key else (0, False)
        key, pre = k, False
        if tie and last[0]:
            pre = bend > 0 or not last[1]
            bend = bend or (0 if last[1] else last[0])
        want[k, i], last = (bend, pre), (bend, rel)
    assert got == want and got[99, 2] == (2, False)


def test_syllables_stay(spark):
    bars = spark.createDataFrame([(1, 0, 10.0, 20.0), (1, 1, 20.0, 40.0)], "song int, bar long, start double, end double")
    marks = spark.createDataFrame([(1, 0, 4.0), (1, 1, 15.0), (1, 2, 50.0), (2, 3, 1.0)], "song int, mid long, x double")
    got = Y.place_lyrics(marks, bars, ["song"], "x", "mid", "bar").orderBy("mid").collect()
    assert [(r.bar, r.place) for r in got] == [(0, 0.0), (0, 0.5), (1, 1.0), (None, 0.0)]
    dense = spark.createDataFrame([(1, i, i / 12) for i in range(12)], "bar int, i long, place double")
    got = Y.syllable_track(dense, ["bar"], ["place", "i"], "place", 8).orderBy("i").collect()
    assert len(got) == 12 and [r.onset for r in got] == [*range(8), 7, 7, 7, 7] and all(r.length == 1 for r in got)


def test_dense_bars_go_on_over_the_bar_line(spark):
    rows = [(1, i, 2.5 * i) for i in range(40)] + [(2, i, 3.0 * i) for i in range(32)]
    df = spark.createDataFrame(rows, "bar int, i long, x double").selectExpr("*", "0.0D as x0", "100.0D as x1")
    for found in (R.snap_fallback(df, ["bar"], "x", "i", "x0", "x1", 32), R.quantize(df, ["bar"], "x", "i", "x0", "x1", 32)):
        got = {(r.bar, r.i): r.onset for r in found.collect()}
        assert [got[1, i] for i in range(40)] == [*range(40)] and [got[2, i] for i in range(32)] == [*range(32)]
