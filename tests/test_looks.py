"""What large tables pay for: looks for large keys, repeated passes and rows made before they are gathered."""

import datetime

import pytest
from tabspark.functions import ordered as O
from tabspark.operators import layout as L
from tabspark.operators import rhythm as R
from tabspark.plans import load
from tabspark.plans.tabtext import tab_lines

DERIVED = [
    "apply_note_edits", "play_counts", "assign_lyrics", "repeat_signs", "bend_at", "unroll", "assign_bar", "grow_range", "slides",
    "pack_triplet_bars", "tie_arcs", "tidy_navigation", "unroll_notes", "pack_triplets", "playback_flat", "review_bars",
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    day = datetime.datetime(2024, 1, 1)
    rows = [(k, 7 * k + i, 3 * k + 2 * i, i, float(5 + i), 1.0 * i, "A", "O", day) for k in range(1, 9) for i in range(1, 6)]
    names = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string, l_linestatus string, l_shipdate timestamp"
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, names).write.parquet(f"{path}/lineitem.parquet")
    return path


@pytest.mark.parametrize("name", DERIVED)
def test_rows_of_an_order_are_looked_at_once(spark, folder, monkeypatch, name):
    """Each look runs all that was derived so far: the order lines are looked at, and nothing made from them."""
    looks = []
    plain = O.large_keys
    monkeypatch.setattr(O, "large_keys", lambda df, keys, every: looks.append(keys) or plain(df, keys, every))
    load()[0][name](spark, folder)
    assert looks == [["l_orderkey"]]


def test_triplets_are_placed_in_one_pass(spark):
    rows = spark.createDataFrame([(1, i, 5 + i, i % 3 == 0) for i in range(9)], "song int, i long, units int, three boolean")
    packed = R.pack_triplet_bars(rows, ["song"], "i", "units", "three", 32)
    assert "MapInPandas" not in packed._jdf.queryExecution().optimizedPlan().toString()
    assert packed.where("item is not null").select("item").distinct().count() == 9


def test_bars_of_triplets_are_the_same_in_chunks(spark, chunks):
    rows = spark.createDataFrame([(1, i, 1 + i % 30, i % 4 == 0) for i in range(200)], "song int, i long, units int, three boolean")
    cut = R.pack_triplets(rows, ["song"], "i", "units", "three", 32).orderBy("i").collect()
    spark.conf.unset("spark.tabspark.splitRows")
    assert R.pack_triplets(rows, ["song"], "i", "units", "three", 32).select(cut[0].__fields__).orderBy("i").collect() == cut


def test_marks_of_a_system_are_gathered_before_its_strings(spark, folder):
    plan = tab_lines(spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode") < plan.index("Aggregate")


def test_lines_above_take_nothing_else_of_a_line_along(spark, chunks, monkeypatch):
    """In large keys every scan stores and shuffles its rows: neither the line nor other columns are among them."""
    rows = [(None if k == 2 else k, i, 10.0 * i + 90 * (i // 7), 10.0, 3 * i + k, "long text") for k in range(3) for i in range(40)]
    lines = spark.createDataFrame(rows, "doc long, no int, y double, h double, t int, line string")
    carried = []
    plain = O.checkpoint
    monkeypatch.setattr(O, "checkpoint", lambda df: carried.append(df.columns) or plain(df))
    cut = {r[:2]: r[2:] for r in L.lines_above(lines, ["doc"], "no", "y", "h", "t", 2).collect()}
    scanned = [set(c) - {"doc", "no", O.CHUNK} for c in carried if O.CHUNK in c]
    assert scanned == [{"_r0"}, {"_r0", "_r1"}]
    spark.conf.unset("spark.tabspark.splitRows")
    assert {r[:2]: r[2:] for r in L.lines_above(lines, ["doc"], "no", "y", "h", "t", 2).collect()} == cut
    assert cut[(1, 8)] == (22, None) and cut[(1, 9)] == (25, 22) and cut[(1, 7)] == (None, None)


def test_digit_runs_scan_digits_alone(spark, tmp_path, monkeypatch):
    """every character of every text was shuffled and sorted, for the few that are digits."""
    texts = [(1, "play 12 times\n7th, then 305\n\nnone"), (2, "0 1 29 30 007 0007"), (None, "4x44"), (3, None), (4, "no number")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    scanned = []
    plain = L.ordered
    monkeypatch.setattr(L, "ordered", lambda df, *a, **b: scanned.append(df) or plain(df, *a, **b))
    got = {r[:2]: r[2:] for r in load()[0]["digit_runs"](spark, str(tmp_path)).collect()}
    assert got == {(1, 0): (1, 12), (1, 1): (4, 7 + 3 + 0 + 5), (2, 0): (3 + 2 + 2, 30 + 3 + 7 + 7), (None, 0): (3, 12)}
    assert [df.count() for df in scanned] == [sum(c.isdigit() for _, t in texts for c in t or "")]


def test_digits_apart_are_as_in_the_whole_line(spark, chunks):
    rows = [(k or None, c, x * 6.0, x * 6.0 + 5.5 + k / 10) for k in range(6) for x, c in enumerate("12-3 a45x9 99 30031 " * 3)]
    df = spark.createDataFrame(rows, "k int, c string, x double, e double")
    whole = sorted(map(tuple, L.digit_runs(df, ["k"], "c", "x", "e").select("x", "fret").collect()))
    assert sorted(map(tuple, L.digit_runs(df, ["k"], "c", "x", "e", apart=True).select("x", "fret").collect())) == whole
    assert len(whole) > 40


def test_tab_blocks_make_the_lines_once(spark, folder, monkeypatch):
    """the lines were rendered and read three times: for a look at their keys, for the flags of a block and for the result."""
    looks = []
    plain = O.large_keys
    monkeypatch.setattr(O, "large_keys", lambda df, keys, every: looks.append(keys) or plain(df, keys, every))
    blocks = load()[0]["tab_blocks"](spark, folder)
    plan = blocks._jdf.queryExecution().optimizedPlan().toString()
    assert looks == [["l_orderkey"]] and "Join" not in plan and plan.count("Relation") == 1
    assert blocks.groupBy("l_orderkey", "block").count().where("count = 6").count() == 8


def test_tab_blocks_are_the_same_in_chunks(spark, chunks):
    labels = ["EADGBE" * 4, "GDAE" * 9, "EADGBEB", "CGDA", "eB", "GDAE" * 2 + "C"]
    rows = [(None if k == 7 else k, no, f"{c}|-0--3--5--7-|") for k in range(8) for no, c in enumerate(" ".join(labels[k % 6 :])) if c != " "]
    lines = spark.createDataFrame(rows, "doc int, no int, line string")
    columns = ["doc", "block", "part", "string", "string_count", "no", "label", "body", "line"]
    cut = sorted(map(tuple, L.tab_blocks(lines, ["doc"], "no", "line").select(columns).collect()))
    spark.conf.unset("spark.tabspark.splitRows")
    assert sorted(map(tuple, L.tab_blocks(lines, ["doc"], "no", "line").select(columns).collect())) == cut
    assert {r[4] for r in cut if r[0] == 0} == {6, 4, 7} and {r[2] for r in cut if r[0] == 1 and r[1] == 1} == set(range(9))
