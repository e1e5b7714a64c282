"""Scans give the same rows with plain windows and with keys cut into chunks."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from tabspark.functions import ordered as O
from tabspark.functions.asof import covered, nearest
from tabspark.operators.layout import anchored_groups
from tabspark.operators.vote import longest_increasing


def rows(n=150, seed=7):
    r = random.Random(seed)
    return [(1 if r.random() < 0.8 else 2, i, round(r.uniform(0, 30), 1), r.choice([None, i])) for i in range(n)]


def key(row):
    return tuple("" if v is None else str(v) for v in row)


def test_chunked_scans_equal_plain_windows(spark):
    plain, want = scanned_sorted(spark)
    assert not plain
    spark.conf.set("spark.tabspark.splitRows", "11")
    try:
        cut, got = scanned_sorted(spark)
    finally:
        spark.conf.unset("spark.tabspark.splitRows")
    assert cut
    assert got == want


def scanned_sorted(spark):
    df = spark.createDataFrame(rows(), "k int, id long, x double, v long")
    line = O.ordered(df, ["k"], ["x", "id"])
    line = line.add(
        n=O.number(), s=O.running_sum("id"), m=O.running_max("v", before=True), f=O.fill("v"), b=O.fill_back("v", after=True),
        lo=O.later_min("v"), p=O.lag("x"), q=O.lead("x"), t=O.total_sum("id"), c=O.total_count(),
    )
    out = line.df
    return line.chunked, sorted(key(r) for r in out.select(*sorted(out.columns)).collect())


def anchors(data, tol):
    found, anchor, last = {}, None, None
    for k, i, x, _ in sorted(data, key=lambda r: (r[0], r[2], r[1])):
        if k != last or x - anchor > tol:
            anchor, last = x, k
        found[i] = anchor
    return found


def test_anchored_groups_against_a_loop(spark, chunks):
    data = rows()
    df = spark.createDataFrame(data, "k int, id long, x double, v long")
    got = {r.id: r.anchor for r in anchored_groups(df, ["k"], "x", "id", 1.5).collect()}
    assert got == anchors(data, 1.5)


def test_ranged_against_a_loop(spark, chunks):
    data = rows()
    df = spark.createDataFrame(data, "k int, id long, x double, v long")
    line = O.ordered(df, ["k"], ["x", "id"])
    assert line.chunked
    got = {r.id: r.n for r in line.ranged(-2.0, 3.0, n="count(*)").collect()}
    for k, i, x, _ in data:
        assert got[i] == sum(1 for k2, _, y, _ in data if k2 == k and x - 2.0 <= y <= x + 3.0)


def test_nearest_and_covered_against_loops(spark, chunks):
    r = random.Random(3)
    points = [(1, i, r.randint(0, 80) / 2) for i in range(60)]
    marks = [(1, i, r.randint(0, 80) / 2, r.randint(0, 4)) for i in range(40)]
    p = spark.createDataFrame(points, "k int, pid long, x double")
    m = spark.createDataFrame(marks, "k int, mid long, y double, w int")
    got = {r.pid: r.near for r in nearest(p, m, ["k"], F.col("x"), "pid", F.col("y"), "mid", {"near": "y"}, "d").collect()}
    cover = {r.pid: r.c for r in covered(p, m, ["k"], F.col("x"), "pid", F.col("y"), F.col("y") + F.col("w"), "mid", "c").collect()}
    for _, i, x in points:
        assert got[i] == min((abs(y - x), y) for _, _, y, _ in marks)[1]
        assert cover[i] == any(y <= x <= y + w for _, _, y, w in marks)


def longest(values):
    best, back = [], []
    for i, v in enumerate(values):
        length, prev = 1, -1
        for j in range(i):
            if values[j] < v and best[j] + 1 > length:
                length, prev = best[j] + 1, j
        best.append(length)
        back.append(prev)
    at, kept = best.index(max(best)), []
    while at >= 0:
        kept.append(at)
        at = back[at]
    return sorted(kept)


def test_longest_increasing(spark):
    cases = {0: [50, 52, 63, 54, 6, 56]}
    r = random.Random(5)
    for n in range(1, 8):
        cases[n] = [r.randint(0, 30) for _ in range(40)]
    df = spark.createDataFrame([(k, i, v) for k, vs in cases.items() for i, v in enumerate(vs)], "k int, i int, v int")
    got: dict[int, list[int]] = {}
    for row in longest_increasing(df, ["k"], "i", "v").collect():
        got.setdefault(row.k, []).append(row.i)
    assert {k: sorted(v) for k, v in got.items()} == {k: longest(v) for k, v in cases.items()}
    assert sorted(got[0]) == [0, 1, 3, 5]


def test_null_keys_survive_in_chunks(spark, chunks):
    rows = [(None if i % 2 else 1, i) for i in range(200)]
    df = spark.createDataFrame(rows, "k int, i long")
    line = O.ordered(df, ["k"], ["i"])
    assert line.chunked
    got = {r["i"]: r["n"] for r in line.add(n=O.number()).df.collect()}
    assert got == {i: i // 2 + 1 for i in range(200)}


def test_many_small_keys_are_not_cut(spark, chunks):
    """Rows of small keys fall on the sampled hashes too, once there are enough of them; only the large key is cut."""
    small = spark.range(3000).selectExpr("id div 3 as k", "id as i")
    assert not O.ordered(small, ["k"], ["i"]).chunked
    large = spark.range(200).selectExpr("-1L as k", "id as i")
    line = O.ordered(small.unionByName(large), ["k"], ["i"])
    assert line.chunked and [r.k for r in line.cuts.collect()] == [-1]
    got = {(r.k, r.i): r.n for r in line.add(n=O.number()).df.collect()}
    assert got == {(i // 3, i): i % 3 + 1 for i in range(3000)} | {(-1, i): i + 1 for i in range(200)}
