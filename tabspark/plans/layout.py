"""Queries of the layout operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import layout as L
from ..operators import tabtext as X
from ..sources import text as T
from .registry import query
from .tables import EVENTS_SQL, GLYPH_SQL, LINES_SQL, doc_lines, events, glyph_line, glyphs, item_line, table
from .tabtext import TAB_SQL, tab_lines

USER = ["user_id"]


@query(
    "shared_positions",
    f"""with e as ({EVENTS_SQL}), t as (select *, case when value - lag(value) over w <= 0.5 then 0 else 1 end as st
      from e window w as (partition by user_id order by value, event_id)),
    g as (select *, sum(st) over (partition by user_id order by value, event_id) as grp from t),
    n as (select user_id, count(distinct event_type) as total from e group by 1)
    select g.user_id, round(median(value), 6) as position, count(distinct event_type) as lanes, count(*) as n
    from g join n using (user_id) group by g.user_id, grp, total having count(distinct event_type) * 2 >= total""",
)
def shared_positions(spark, folder):
    found = L.shared_positions(events(spark, folder), USER, "event_type", "value", "event_id", 0.5)
    return found.withColumn("position", F.round("position", 6))


ANCHORS_SQL = f"""with recursive e as ({EVENTS_SQL}),
  a(user_id, anchor) as (select user_id, min(value) from e group by 1 union all
    select a.user_id, min(e.value) from a join e on e.user_id = a.user_id and e.value - a.anchor > 2.0 group by a.user_id),
  n as (select *, row_number() over (partition by user_id order by anchor) as group_no from a),
  m as (select e.*, n.anchor, n.group_no from e asof join n on e.user_id = n.user_id and e.value >= n.anchor)"""


def columns(spark, folder):
    return L.anchored_groups(events(spark, folder), USER, "value", "event_id", 2.0)


@query(
    "anchored_columns",
    ANCHORS_SQL + " select user_id, group_no, round(anchor, 6) as anchor, count(*) as n from m group by all",
)
def anchored_columns(spark, folder):
    return columns(spark, folder).groupBy("user_id", "group_no", F.round("anchor", 6).alias("anchor")).agg(
        F.count("*").alias("n")
    )


@query(
    "dedupe_in_group",
    ANCHORS_SQL
    + """ select user_id, group_no, event_type, min_by(event_id, (value, event_id)) as event_id, count(*) - 1 as dropped
      from m group by 1, 2, 3""",
)
def dedupe_in_group(spark, folder):
    kept = L.dedupe_in_group(columns(spark, folder), USER, "group_no", "event_type", ["value", "event_id"])
    return kept.select("user_id", "group_no", "event_type", "event_id", "dropped")


@query(
    "split_by_gap",
    f"""with g as ({GLYPH_SQL}), t as (select *, case when x0 - lag(x1) over w <= 0.6 * (bottom - top) then 0 else 1 end as st
      from g window w as (partition by l_orderkey order by x0, gid)),
    r as (select *, sum(st) over (partition by l_orderkey order by x0, gid) as token from t)
    select l_orderkey, token, count(*) as n, min(x0) as x0, max(x1) as x1 from r group by 1, 2""",
)
def split_by_gap(spark, folder):
    words = L.split_by_gap(glyphs(spark, folder), ["l_orderkey"], "x0", "x1", F.col("bottom") - F.col("top"), "gid", 0.6)
    return words.groupBy("l_orderkey", "token").agg(
        F.count("*").alias("n"), F.min("x0").alias("x0"), F.max("x1").alias("x1")
    )


@query(
    "line_text",
    f"""with g as ({GLYPH_SQL}), t as (select *, case when x0 - lag(x1) over w > 0.2 * (bottom - top)
        then ' ' || fret else '' || fret end as t from g window w as (partition by l_orderkey order by x0, gid))
    select l_orderkey, string_agg(t, '' order by x0, gid) as text from t group by 1""",
)
def line_text(spark, folder):
    marks = glyphs(spark, folder).withColumn("t", F.col("fret").cast("string"))
    return L.line_text(marks, ["l_orderkey"], "t", "x0", "x1", F.col("bottom") - F.col("top"), "gid")


# Staff strokes: four stroke heights per order, pieces of different lengths.
STROKES = """l_orderkey, gid, cast(gid % 4 * 40.0{d} + fret % 2 * 0.25{d} as double) as y0, x0 * 2 as x0, x0 * 2 + units as x1"""
STROKES_SQL = f"select {STROKES.format(d='')} from ({GLYPH_SQL})"


def strokes(spark, folder):
    base = glyphs(spark, folder).selectExpr(*[c.strip() for c in STROKES.format(d="D").split(",")])
    return base.withColumns({"top": F.col("y0"), "bottom": F.col("y0")})


@query(
    "merge_lines",
    f"""with recursive s as (select *, round_even(y0, 1) as rw from ({STROKES_SQL}) where x1 - x0 > 2.0),
    o as (select *, row_number() over (partition by l_orderkey order by rw, x0, gid) as rn from s),
    f(l_orderkey, rn, y, fx1, line_no) as (
      select l_orderkey, rn, y0, x1, 1 from o where rn = 1 union all
      select o.l_orderkey, o.rn, case when abs(f.y - o.y0) <= 0.5 and o.x0 <= f.fx1 + 10.0 then f.y else o.y0 end,
        case when abs(f.y - o.y0) <= 0.5 and o.x0 <= f.fx1 + 10.0 then greatest(f.fx1, o.x1) else o.x1 end,
        case when abs(f.y - o.y0) <= 0.5 and o.x0 <= f.fx1 + 10.0 then f.line_no else f.line_no + 1 end
      from f join o on o.l_orderkey = f.l_orderkey and o.rn = f.rn + 1)
    select l_orderkey, cast(line_no as bigint) as line_no, min(f.y) as y, min(o.x0) as x0, max(o.x1) as x1 from f join o using (l_orderkey, rn)
    group by 1, 2 having max(o.x1) - min(o.x0) > 8.0""",
)
def merge_lines(spark, folder):
    return L.merge_lines(strokes(spark, folder), ["l_orderkey"], F.lit(100.0), "gid")


@query("find_staves")
def find_staves(spark, folder):
    lines = glyphs(spark, folder).select(
        "l_orderkey",
        F.col("gid").alias("line_no"),
        (F.col("gid") * 10.0 + F.when(F.col("fret") > 22, 4.0).otherwise(0.0)).alias("y"),
        F.when(F.col("fret") == 1, 9.0).otherwise(0.0).alias("x0"),
        F.lit(400.0).alias("x1"),
    )
    return L.find_staves(lines, ["l_orderkey"])


@query(
    "explode_chars",
    f"""with l as ({LINES_SQL}) select doc_id, line_no, count(*) as n_chars, count(*) filter (ch = '-') as dashes from
      (select doc_id, line_no, unnest(string_split(line, '')) as ch from l where length(line) > 0) group by 1, 2""",
)
def explode_chars(spark, folder):
    chars = T.explode_chars(table(spark, folder, "documents"), ["doc_id"], "text")
    return chars.groupBy("doc_id", "line_no").agg(
        F.count("*").alias("n_chars"), F.count_if(F.col("char") == "-").alias("dashes")
    )


@query(
    "digit_runs",
    f"""with l as ({LINES_SQL}), r as (select doc_id, line_no, unnest(regexp_extract_all(line, '[0-9]+')) as d from l),
    v as (select doc_id, line_no, unnest(case when length(ltrim(d, '0')) <= 2 and try_cast(d as int) <= 29 then [d]
      else string_split(d, '') end) as f from r)
    select doc_id, line_no, count(*) as n, sum(cast(f as int)) as total from v group by 1, 2""",
)
def digit_runs(spark, folder):
    chars = T.explode_chars(table(spark, folder, "documents"), ["doc_id"], "text")
    chars = chars.withColumns({"x": F.col("x").cast("double"), "x1": F.col("x") + 1.0})
    runs = L.digit_runs(chars, ["doc_id", "line_no"], "char", "x", "x1", apart=True)  # a character fills its column
    return runs.groupBy("doc_id", "line_no").agg(F.count("*").alias("n"), F.sum("fret").alias("total"))


IS_TAB_SQL = r"""regexp_matches(rl, '[|-]') and (lb = '' or regexp_full_match(lb, '[A-Ga-g][#b]?'))
  and dashes >= 6 and dashes / len >= 0.35 and not regexp_matches(bd, '[A-Za-z]{3,}')
  and length(translate(replace(bd, ' ', ''), '-0123456789|hpbrs/\~xX()<>.:*^=+tTo', '')) / len <= 0.15"""
PARTS_SQL = r"""select *, length(replace(bd, ' ', '')) as len, length(bd) - length(replace(bd, '-', '')) as dashes from (
  select *, regexp_replace(regexp_extract(rl, '^[^|-]*([|-].*)$', 1), '   .*$', '') as bd,
  regexp_extract(rl, '^([^|-]*)[|-]', 1) as lb from (select *, rtrim(line) as rl from {src}))"""


@query(
    "tab_line_features",
    f"""with l as ({LINES_SQL}) select doc_id, line_no, length(line) as length, length(line) - length(replace(line, '-', '')) as dashes,
      len(regexp_extract_all(line, '[0-9]')) as digits, len(regexp_extract_all(line, '[A-Za-z]{{3,}}')) as words from l""",
)
def tab_line_features(spark, folder):
    return T.char_features(doc_lines(spark, folder), ["doc_id", "line_no"], "line")


@query(
    "tab_lines",
    f"""with d as (select l_orderkey, line_no, line from ({TAB_SQL}) union all select doc_id, -1 - line_no, line from ({LINES_SQL}))
    select l_orderkey, line_no, lb as label, length(bd) as length from ({PARTS_SQL.format(src="d")}) where {IS_TAB_SQL}""",
)
def tab_lines_query(spark, folder):
    lines = tab_lines(spark, folder).select("l_orderkey", "line_no", "line")
    prose = doc_lines(spark, folder).select(F.col("doc_id").alias("l_orderkey"), (-1 - F.col("line_no")).alias("line_no"), "line")
    found = lines.unionByName(prose).where(L.is_tab_line(F.col("line")))
    label, body = L.tab_line_parts(F.rtrim("line"))
    return found.select("l_orderkey", "line_no", label.alias("label"), F.length(body).alias("length"))


@query(
    "tab_blocks",
    f"""with t as (select *, line_no - row_number() over (partition by l_orderkey order by line_no) as isl
      from ({PARTS_SQL.format(src=f"({TAB_SQL})")}) where {IS_TAB_SQL}),
    b as (select *, dense_rank() over (partition by l_orderkey order by isl) as block,
      count(*) over (partition by l_orderkey, isl) as n, row_number() over (partition by l_orderkey, isl order by line_no) as rn from t)
    select l_orderkey, block, cast(rn as int) as string, cast(n as int) as string_count, line_no, lb as label from b where n between 4 and 8""",
)
def tab_blocks(spark, folder):
    line = item_line(spark, folder)
    blocks = L.tab_blocks(tab_lines(spark, folder, line), ["l_orderkey"], "line_no", "line", like=line)
    return blocks.select("l_orderkey", "block", "string", "string_count", "line_no", "label")


TOKENS_SQL = rf"""select * from (select *, lead(p) over w as after, coalesce(lead(n) over w, '') as nxt,
    coalesce(lag(n) over w, '') || coalesce(lag(t) over w, '') as cm, count(*) over (partition by l_orderkey, line_no) as cnt,
    coalesce(sum(length(p) + length(n) + length(t)) over (partition by l_orderkey, line_no order by i
      rows between unbounded preceding and 1 preceding), 0) + length(p) as x0
  from (select l_orderkey, line_no, unnest(range(len(ps))) as i, unnest(ps) as p, unnest(ns) as n, unnest(ts) as t from (
    select l_orderkey, line_no, regexp_extract_all(bd || 'x', '{X.TOKEN}', 1) as ps,
      regexp_extract_all(bd || 'x', '{X.TOKEN}', 2) as ns, regexp_extract_all(bd || 'x', '{X.TOKEN}', 3) as ts
    from ({PARTS_SQL.format(src=f"({TAB_SQL})")}))) window w as (partition by l_orderkey, line_no order by i)) where i < cnt - 1"""


@query(
    "scan_tab",
    rf"""with k as ({TOKENS_SQL}), c as (select *, regexp_matches(n, '^[0-9]') as dig, regexp_extract(p, '([^|]*)$', 1) as seg,
      case when p like '%|%' then '|' when i = 0 then '-' else right(cm, 1) end as came from k),
    d as (select *, came || seg || case when dig then '0' else 'x' end as ctx from c),
    v as (select *, regexp_extract_all(ctx, '{X.LINK_MARK}', 1) as lk, regexp_extract_all(ctx, '{X.SLIDE_IN_MARK}', 1) as si,
      regexp_extract(after || case when regexp_matches(nxt, '^[0-9]') then '0' else 'x' end, '^[)>]?([/\\])[^0-9(<]', 1) as so,
      try_cast(regexp_extract(t, 'b\(?([0-9]+)', 1) as int) - try_cast(n as int) as delta from d)
    select l_orderkey, line_no, cast(x0 as int) as x, try_cast(n as int) as fret, not dig as dead,
      dig and p like '%(' and starts_with(t || after, ')') as parenthesized, dig and p like '%<' and starts_with(t || after, '>') as harmonic,
      case when length(lk[-1]) = 3 then lk[-1][2] else lk[-1] end as link, case when dig then si[-1] end as slide_in,
      case when dig and so <> '' and (t = '' or regexp_matches(t, '[0-9)]$')) then so end as slide_out,
      dig and regexp_matches(seg, '[tT]$') as tapped, after like '%~%' as vibrato,
      case when dig and t like '%b%' then case when delta between 1 and 4 then delta else 2 end else 0 end as bend,
      dig and t like '%b%' and t like '%r%' as bend_release, dig and t like '%pb%' as bend_pre from v""",
)
def scan_tab(spark, folder):
    lines = tab_lines(spark, folder).withColumn("body", L.tab_line_parts(F.col("line"))[1])
    return X.scan_notes(lines, ["l_orderkey", "line_no"], "body")


@query(
    "scan_bars",
    f"""with t as ({PARTS_SQL.format(src=f"({TAB_SQL})")}), c as (select l_orderkey, line_no, bd, unnest(range(length(bd))) as x from t)
    select l_orderkey, line_no, cast(x as int) as x, regexp_matches(substr(bd, x + 2, 1), '^[:*o]$') as opens,
      x > 0 and regexp_matches(substr(bd, x, 1), '^[:*o]$') as closes from c where substr(bd, x + 1, 1) = '|'""",
)
def scan_bars(spark, folder):
    lines = tab_lines(spark, folder).withColumn("body", L.tab_line_parts(F.col("line"))[1])
    return X.scan_bars(lines, ["l_orderkey", "line_no"], "body")


@query(
    "trailing_count",
    f"""select l_orderkey, sys, cast(max(case when l_orderkey % 7 = 0 then 2 + l_orderkey % 3 end) as int) as times
      from ({TAB_SQL}) group by 1, 2""",
)
def trailing_count(spark, folder):
    lines = tab_lines(spark, folder)
    times = L.repeat_count(F.regexp_extract("line", r"   (.*)$", 1))
    return lines.groupBy("l_orderkey", "sys").agg(F.max(times).alias("times"))


EDGES_SQL = f"select l_orderkey, x0 as x from ({GLYPH_SQL}) where fret % 3 = 0"
# Marks are the glyphs that are no bar lines; a line of an order spans 0 .. 10 * number of glyphs.
INTERVALS_SQL = f"""with g as ({GLYPH_SQL}), e as (select distinct l_orderkey, x0 as x from g where fret % 3 = 0),
  m as (select l_orderkey, min(x0) as m0, max(x0) as m1, cast(-1.0 as double) as s, cast(max(gid) * 10.0 + 30 as double) as e from g where fret % 3 <> 0 group by 1),
  d as (select l_orderkey, min(x) as b0, max(x) as b1 from e group by 1),
  i as (select l_orderkey, s as x from m left join d using (l_orderkey) where b0 is null or m0 < b0 union all
    select l_orderkey, m.e as x from m left join d using (l_orderkey) where m1 > coalesce(b1, s)),
  bnd as (select * from e union select * from i),
  iv as (select * from (select l_orderkey, row_number() over w as bar, x as start, lead(x) over w as end from bnd
    window w as (partition by l_orderkey order by x)) where "end" is not null)"""


def intervals(line):
    g = line.df
    edges = g.where("fret % 3 = 0").select("l_orderkey", F.col("x0").alias("x"))
    spans = g.where("fret % 3 <> 0").groupBy("l_orderkey").agg(
        F.min("x0").alias("a"), F.max("x0").alias("b"), (F.max("gid") * 10.0 + 30).alias("e")
    )
    ends = spans.select("l_orderkey", F.explode(F.array("a", "b")).alias("mx"), F.lit(-1.0).alias("s"), "e")
    return L.bar_intervals(edges, ends, ["l_orderkey"], "x", "mx", "s", "e", like=line)


@query("bar_intervals", INTERVALS_SQL + ' select l_orderkey, bar, start, "end" from iv')
def bar_intervals(spark, folder):
    return intervals(glyph_line(spark, folder))


@query(
    "assign_bar",
    INTERVALS_SQL
    + """ select g.l_orderkey, g.gid, bar, case when bar is not null then round(least(greatest((x0 - start) / ("end" - start), 0.0), 1.0), 6) end as place
      from g left join iv on iv.l_orderkey = g.l_orderkey and x0 >= start and x0 < "end" """,
)
def assign_bar(spark, folder):
    line = glyph_line(spark, folder)
    found = L.assign_bar(line.df, intervals(line), ["l_orderkey"], "x0", "gid", "bar", like=line)
    return found.select("l_orderkey", "gid", "bar", F.round("place", 6).alias("place"))


@query(
    "lines_above",
    f"""with l as (select *, line_no * 10.0 + case when length(line) % 5 = 0 then 0 else floor(line_no / 3.0) * 90 end as y from ({LINES_SQL})),
    t as (select *, lag(y) over w as y1, lag(y, 2) over w as y2, lag(length(line)) over w as n1, lag(length(line), 2) over w as n2
      from l window w as (partition by doc_id order by line_no))
    select doc_id, line_no, case when y - y1 <= 40 then n1 end as above_1, case when y - y1 <= 40 and y1 - y2 <= 40 then n2 end as above_2 from t""",
)
def lines_above(spark, folder):
    lines = doc_lines(spark, folder).withColumns({"t": F.length("line"), "h": F.lit(10.0)})
    shift = F.when(F.col("t") % 5 == 0, 0.0).otherwise(F.floor(F.col("line_no") / 3) * 90.0)
    lines = lines.withColumn("y", F.col("line_no") * 10.0 + shift)
    return L.lines_above(lines, ["doc_id"], "line_no", "y", "h", "t", 2)
