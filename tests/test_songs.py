"""Playing orders, quantised onsets, packed bars, text tabs and edits against known results."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tabspark.operators import edits as E
from tabspark.operators import layout as L
from tabspark.operators import metadata as M
from tabspark.operators import rhythm as R
from tabspark.operators import structure as P
from tabspark.operators import tabtext as X
from tabspark.sources.text import explode_lines

# Bars as "|:" open, ":n" times, "[1,2]" endings, or a sign / jump name; then the bars played.
ORDERS = [
    ("|: / :2 [1] / [2] / |: / :3", "1 2 1 3 4 5 4 5 4 5"),
    ("|: / - / :3 [1,2] / [3] / -", "1 2 3 1 2 3 1 2 4 5"),
    ("|: / :2 / |: / :2 / -", "1 2 1 2 3 4 3 4 5"),
    ("- / :2 / - / :3", "1 2 1 2 3 4 1 2 1 2 3 4 1 2 1 2 3 4"),
    ("|: / |: / :2 / :2 / -", "1 2 3 2 3 4 1 2 3 2 3 4 5"),
    ("- / |: / - / -", "1 2 3 4"),
    ("- / :2 [1] / [2] / -", "1 2 1 3 4"),
    ("- / - / Da Capo / -", "1 2 3 1 2 3 4"),
    ("- / Fine / - / Da Capo al Fine / -", "1 2 3 4 1 2"),
    ("- / Segno / Da Coda / - / Da Segno al Coda / Coda / -", "1 2 3 4 5 2 3 6 7"),
    ("- / Da Coda / Da Capo al Coda / Coda / -", "1 2 3 1 2 4 5"),
    ("Segno |: / :2 / Fine / Da Segno al Fine", "1 2 1 2 3 4 1 2 3"),
    ("- / |: / :3 Da Coda / Da Capo al Coda / Coda", "1 2 3 2 3 2 3 4 1 2 3 5"),
    ("- / - / Da Segno / -", "1 2 3 4"),
    ("|: / :2 [1] / [2] / Da Capo / -", "1 2 1 3 4 1 3 4 5"),
    ("|: / :3 [1,2] / [3] / Da Capo", "1 2 1 2 1 3 4 1 3 4"),
    ("|: / [1] / :2 [1] / [2] / Da Capo", "1 2 3 1 4 5 1 4 5"),
    ("|: / :3 / Da Capo / -", "1 2 1 2 1 2 3 1 2 3 4"),
]
SIGNS = ("Segno", "Coda", "Fine")
BARS = "song int, bar long, repeat_open boolean, repeat_times int, endings array<int>, sign string, jump string"


def bars(song, text):
    out = []
    for i, cell in enumerate(text.split(" / ")):
        words = cell.replace("Da ", "Da_").replace(" al ", "_al_").split()
        opens = "|:" in words
        times = next((int(w[1:]) for w in words if w.startswith(":")), 0)
        endings = next(([int(n) for n in w[1:-1].split(",")] for w in words if w.startswith("[")), None)
        names = [w.replace("_", " ") for w in words if w[0].isalpha()]
        sign = next((n for n in names if n in SIGNS), None)
        jump = next((n for n in names if n not in SIGNS), None)
        out.append((song, i, opens, times, endings, sign, jump))
    return out


def played(spark, rows, **options):
    df = P.playback_order(spark.createDataFrame(rows, BARS), ["song"], **options)
    found: dict[int, list] = {}
    for r in sorted(df.collect(), key=lambda r: r.play_idx):
        found.setdefault(r.song, []).append((r.bar + 1, r.skips))
    return found


def test_playing_orders(spark):
    rows = [bar for i, (text, _) in enumerate(ORDERS) for bar in bars(i, text)]
    got = played(spark, rows)
    for i, (_, want) in enumerate(ORDERS):
        assert " ".join(str(b) for b, _ in got[i]) == want
    assert got[14][0][1] and not got[7][0][1]


def test_player_variant_and_limit(spark):
    rows = bars(0, ORDERS[14][0]) + bars(1, "|: / :32 / |: / :32 / |: / :32")
    got = played(spark, rows, last_ending_only=False, limit=50)
    assert " ".join(str(b) for b, _ in got[0]) == "1 2 1 3 4 1 2 3 4 5"
    assert len(got[1]) == 50


@pytest.mark.parametrize(
    "xs, origin, end, want",
    [([0, 4, 8, 12], 0, 16, [0, 8, 16, 24]), ([3, 7, 11, 13], 3, 17, [0, 8, 16, 20]), (list(range(16)), 0, 16, list(range(0, 32, 2)))],
)
def test_quantize(spark, xs, origin, end, want):
    rows = [(1, i, float(x), float(origin), float(end)) for i, x in enumerate(xs)]
    df = spark.createDataFrame(rows, "bar int, i int, x double, origin double, end double")
    got = R.quantize(df, ["bar"], "x", "i", "origin", "end", 32)
    assert [r.onset for r in got.orderBy("i").collect()] == want


def test_split_units_sums_and_values(spark):
    got = spark.range(1, 97).select("id", R.split_units(F.col("id")).alias("p")).collect()
    for r in got:
        assert sum(r.p) == r.id and set(r.p) <= set(R.REPRESENTABLE_UNITS)


def test_packed_bars_are_full(spark, chunks):
    import random

    r = random.Random(1234)
    rows = [(s, i, r.randint(1, 40)) for s in range(4) for i in range(30)]
    packed = R.pack_into_bars(spark.createDataFrame(rows, "s int, i long, u int"), ["s"], "i", "u", 24)
    sums = packed.groupBy("s", "bar").agg(F.sum("units").alias("t")).collect()
    assert {x.t for x in sums} == {24}
    per_item = {(x.s, x.item): x.t for x in packed.where("item is not null").groupBy("s", "item").agg(F.sum("units").alias("t")).collect()}
    assert per_item == {(s, i): u for s, i, u in rows}


TAB = """e|-0---3h5---7p5-|
B|---------------|
G|-----------4/6-|
D|-5b7r5--x------|
A|---(3)--7~-----|
E|---------------|
This is just text - not a tab ---"""


def test_text_tab(spark):
    lines = explode_lines(spark.createDataFrame([(1, TAB)], "doc int, text string"), ["doc"], "text")
    blocks = L.tab_blocks(lines, ["doc"], "line_no", "line")
    assert [r.label for r in blocks.orderBy("string").collect()] == ["e", "B", "G", "D", "A", "E"]
    notes = X.scan_notes(blocks, ["string"], "body").orderBy("string", "x").collect()
    by = {}
    for n in notes:
        by.setdefault(n.string, []).append(n)
    assert [(n.fret, n.link) for n in by[1]] == [(0, None), (3, None), (5, "h"), (7, None), (5, "p")]
    assert by[3][1].link == "/"
    assert (by[4][0].fret, by[4][0].bend, by[4][0].bend_release, by[4][1].dead) == (5, 2, True, True)
    assert by[5][0].parenthesized and by[5][1].vibrato and not by[5][0].vibrato
    assert X.scan_bars(blocks, ["string"], "body").where("string = 1").count() == 2


def test_stacked_systems_split_by_labels(spark):
    one = "\n".join(f"{c}|-0--3--5--7-|" for c in "GDAE")
    lines = explode_lines(spark.createDataFrame([(1, one + "\n" + one + "\n" + one)], "doc int, text string"), ["doc"], "text")
    got = L.tab_blocks(lines, ["doc"], "line_no", "line")
    assert [(r.part, r.n) for r in got.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect()] == [(0, 4), (1, 4), (2, 4)]


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_tempo_tuning_and_names(spark):
    tempo = {"Tempo: 96": 96, "Played at 140 BPM": 140, "= 999": None, "♩ = 90": 90, " = 120": 60}
    for text, want in tempo.items():
        assert value(spark, M.detect_tempo(F.lit(text))) == want
    assert value(spark, M.detect_tuning(F.lit("Tuning : D A D G B E"))) == ["E", "B", "G", "D", "A", "D"]
    assert value(spark, M.detect_tuning(F.lit("Tuning is great"))) is None
    assert value(spark, M.match_tuning(F.array(*[F.lit(c) for c in "EBGDAD"]))) == "drop_d"
    assert value(spark, M.custom_tuning(F.array(*[F.lit(c) for c in "ECGCGC"]))) == [64, 60, 55, 48, 43, 36]
    assert value(spark, M.match_tuning(F.array(*[F.lit(c) for c in "XBGDAE"]))) is None
    assert value(spark, M.safe_name(F.lit("AC/DC - Back: In Black?"), "x")) == "AC_DC - Back_ In Black_"
    assert value(spark, M.safe_name(F.lit("CON"), "x")) == "x" and value(spark, M.safe_name(F.lit("  ..  "), "x")) == "x"
    for text, want in {"x4": 4, "3x": 3, "3 vezes": 3, "play 3 times": 3, "x1": None, "x99": None}.items():
        assert value(spark, L.repeat_count(F.lit(text))) == want


NOTES = [(1, 0, 2, 5, False), (1, 1, 2, 7, False), (1, 1, 3, 6, False), (1, 2, 1, 3, False), (1, 3, 1, 3, True), (1, 4, 1, 3, True), (1, 5, 4, 0, False)]


@pytest.mark.parametrize(
    "edits, applied, want",
    [
        ([(0, 2, 5, 8)], True, {(0, 2): 8}),
        ([(0, 2, 6, 8)], False, {}),
        ([(0, 5, 5, 8)], False, {}),
        ([(0, 2, 5, 31)], False, {}),
        ([(3, 1, 3, 4)], True, {(2, 1): 4, (3, 1): 4, (4, 1): 4}),
        ([(0, 2, 5, 8), (0, 2, 8, 9)], True, {(0, 2): 9}),
        ([(0, 2, 5, 8), (2, 1, 9, 1)], False, {}),
        ([(2, 1, 3, None)], True, {(2, 1): None, (3, 1): None, (4, 1): None}),
    ],
)
def test_note_edits(spark, edits, applied, want):
    notes = spark.createDataFrame(NOTES, "song int, beat long, string int, fret int, tie boolean")
    sent = [(9, i, 1, s, b, expected, new) for i, (b, s, expected, new) in enumerate(edits)]
    sent = spark.createDataFrame(sent, "request int, seq int, song int, string int, beat long, expected int, fret int")
    after, requests = E.apply_note_edits(notes, sent, ["song"], "string", "beat", "tie", "fret", "request", "seq")
    assert requests.first().applied is applied
    before = {(n[1], n[2]): n[3] for n in NOTES}
    got = {(r.beat, r.string): r.fret for r in after.collect()}
    assert got == {k: v for k, v in (before | want).items() if v is not None}


def test_songs_stream_through_the_player(spark):
    """Songs with nested repeats are not made one pandas group each, and a song may lie over several batches."""
    rows = [(s, b, b in (0, 1), 2 if b in (2, 3) else 0, None, None, None) for s in (1, 2, None) for b in range(4)]
    bars = spark.createDataFrame(rows, "song int, bar long, repeat_open boolean, repeat_times int, endings array<int>, sign string, jump string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        order = P.playback_order(bars, ["song"])
        assert "FlatMapGroups" not in order._jdf.queryExecution().toString()
        got = sorted((r.song or 0, r.play_idx, r.bar) for r in order.collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    # The inner repeat counts again in each lap of the outer one.
    assert got == [(s, k, b) for s in (0, 1, 2) for k, b in enumerate([0, 1, 2, 1, 2, 3, 0, 1, 2, 1, 2, 3])]


LINES = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string, l_linestatus string, l_shipdate timestamp"


def lines_of(song, text, at=0):
    """Order lines of a song: "|:" opens a repeat, "?" may open one (null), ":n" ends one played 2 or 3 times."""
    for i, cell in enumerate(text.split(" / "), at):
        opens, times = "|:" in cell, 3 if ":3" in cell else 2 if ":2" in cell else 0
        yield song, None if "?" in cell else 5 if opens else 1, 4 if times else 1, i, float(times or 2), 1.0, "A", "O", None


def bar_by_bar(text):
    """The bars as they are played, one at a time."""
    cells, order, starts, sent, i = text.split(" / "), [], [0], {}, 0
    while i < len(cells):
        times = 3 if ":3" in cells[i] else 2 if ":2" in cells[i] else 0
        if "|:" in cells[i] and starts[-1] != i:
            starts.append(i)
        order.append(i)
        if sent.get(i, 0) < times - 1:
            sent[i] = sent.get(i, 0) + 1
            i = starts[-1]
            continue
        if times:
            sent[i] = 0
            starts = starts[:-1] if len(starts) > 1 else starts
        i += 1
    return order


def test_playback_flat_plays_every_song_to_its_end(spark, tmp_path):
    """songs with nested repeats, and the bars after the first 20 000, were left out."""
    import duckdb

    from tabspark.plans import load

    plays, sql = (x["playback_flat"] for x in load())
    short = {
        1: "- / |: / :2 / - / |: :3 / -", 2: "|: / |: / :2 / :3 / -", 3: "- / :2 / - / :3 / :2", 4: "- / |: / |: / - / :2",
        5: "- / ? :2 / ? :3", None: "|: / - / |: / :3 / :2 / - / :2", 7: "|: :2", 8: "-",
    }
    long = {11: "- / " * 7000 + ":3", 12: "- / " * 3000 + ":2 / " + "- / " * 5998 + ":2", 13: "|: / " + "- / |: / - / :3 / " * 4 + "- / :2 / " * 8 + "-"}
    for name, songs in (("short", short), ("long", long)):
        rows = [r for song, text in songs.items() for r in lines_of(song, text)]
        spark.createDataFrame(rows, LINES).write.parquet(f"{tmp_path}/{name}/lineitem.parquet")
        got: dict = {}
        for r in plays(spark, f"{tmp_path}/{name}").collect():
            got.setdefault(r.l_orderkey, []).append((r.play_idx, r.bar))
        want = {song: list(enumerate(bar_by_bar(text))) for song, text in songs.items()}
        assert {song: sorted(o) for song, o in got.items()} == want
    assert all(len(bar_by_bar(text)) > 20_000 for text in (long[11], long[12]))
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from '{tmp_path}/short/lineitem.parquet/*.parquet'")
    want = [(song, k, bar) for song, text in short.items() for k, bar in enumerate(bar_by_bar(text))]
    assert set(con.execute(sql).fetchall()) == set(want)


def test_a_song_without_an_end_is_told(spark):
    rows = bars(0, "Coda / Da Coda / Da Capo al Coda")
    assert len(played(spark, rows, limit=50)[0]) == 50
    with pytest.raises(Exception, match="never ends"):
        played(spark, rows, limit=None)


def test_long_walks_come_in_pieces(monkeypatch):
    signs = P.Signs([9], [(False, 3, None, 0, None, None)], None, None, 20)
    monkeypatch.setattr(P, "STRETCH", 4)
    for limit in (None, 23):
        found = list(P._walk(signs, limit, True, []))
        bars = [(start + b - first, b) for start, first, last in found for b in range(first, last + 1)]
        assert bars == list(enumerate([*range(10)] * 3 + [*range(10, 20)]))[:limit] and max(b - a for _, a, b in found) < 4
