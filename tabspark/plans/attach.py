"""Queries of the attach operators: user events and order glyphs as marks, the SQL as plain band joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import attach as A
from .registry import query
from .tables import EVENTS_SQL, GLYPH_SQL, ITEMS_SQL, events, glyph_line, glyphs, items, table

USER, PAGE = ["user_id"], ["l_orderkey"]
STRING = ["l_orderkey", "string"]


def kind(spark, folder, name):
    return events(spark, folder).where(F.col("event_type") == name)


@query(
    "nearest_exclusive",
    f"""with e as (select *, cast(floor(sec / 432000.0) as bigint) as bar from ({EVENTS_SQL})),
    l as (select * from e where event_type = 'click'), r as (select * from e where event_type = 'view'),
    c as (select l.user_id, l.bar, l.event_id as left_id, min_by(r.event_id, (abs(r.sec - l.sec), r.sec, r.event_id)) as rid, min(abs(r.sec - l.sec)) as d
      from l join r on l.user_id = r.user_id and l.bar = r.bar group by 1, 2, 3),
    m as (select l.user_id, l.bar, l.event_id as left_id, case when d <= 20000 then rid end as right_id, case when d <= 20000 then round(d, 3) end as dist
      from l left join c on c.left_id = l.event_id),
    t as (select user_id, bar, right_id, count(*) as n from m where right_id is not null group by all),
    f as (select user_id, bar, max(n) > 1 as refused from t group by 1, 2),
    u as (select *, case when right_id is null then 'whole' else 'stem' end as kind from m union all
      select user_id, bar, null, event_id, null, 'continued' from r where event_id not in (select right_id from t))
    select u.user_id, u.bar, left_id, right_id, dist, kind, coalesce(refused, false) as refused from u left join f on f.user_id = u.user_id and f.bar = u.bar""",
)
def nearest_exclusive(spark, folder):
    bar = F.floor(F.col("sec") / 432000.0).cast("long")
    found = A.nearest_exclusive(
        kind(spark, folder, "click").withColumn("bar", bar), kind(spark, folder, "view").withColumn("bar", bar),
        ["user_id", "bar"], "sec", "event_id", "sec", "event_id", 20000.0,
    )
    return found.withColumn("dist", F.round("dist", 3))


@query(
    "snap_to_bar",
    f"""with e as ({EVENTS_SQL}), c as (select l.user_id, l.event_id, min_by(r.value, (abs(r.value - l.value), r.value)) as x, min(abs(r.value - l.value)) as d
      from e l join e r on l.user_id = r.user_id and l.event_type = 'click' and r.event_type = 'purchase' group by 1, 2)
    select user_id, event_id, x as bar_x, round(d, 6) as dist from c where d <= 5.0""",
)
def snap_to_bar(spark, folder):
    found = A.snap(kind(spark, folder, "click"), kind(spark, folder, "purchase"), USER, "value", "event_id", "value", "event_id", 5.0)
    return found.where("bar_x is not null").select("user_id", "event_id", "bar_x", F.round("dist", 6).alias("dist"))


@query(
    "repeat_signs",
    f"""with recursive g as ({GLYPH_SQL}), dots as (select l_orderkey, gid, gid // 2 * 20 + fret % 4 as x from g where fret % 5 <> 0),
    bars as (select distinct l_orderkey, gid // 2 * 20 + 2 as bx from g where fret % 7 <> 3),
    a(l_orderkey, x) as (select l_orderkey, min(x) from dots group by 1 union all
      select a.l_orderkey, min(d.x) from a join dots d on d.l_orderkey = a.l_orderkey and d.x - a.x > 1.0 group by a.l_orderkey, a.x),
    cols as (select a.l_orderkey, a.x from dots d asof join a on d.l_orderkey = a.l_orderkey and d.x >= a.x group by 1, 2 having count(*) >= 2),
    n as (select c.l_orderkey, c.x, min_by(bx, (abs(bx - c.x), bx)) as bx from cols c join bars b using (l_orderkey) group by 1, 2)
    select distinct l_orderkey, cast(bx as double) as bar_x, case when x > bx then 'open' else 'close' end as kind from n where abs(bx - x) <= 4""",
)
def repeat_signs(spark, folder):
    line = glyph_line(spark, folder)
    g = line.df
    dots = g.where("fret % 5 <> 0").selectExpr("l_orderkey", "gid", "cast(gid div 2 * 20 + fret % 4 as double) as x")
    bars = g.where("fret % 7 <> 3").selectExpr("l_orderkey", "cast(gid div 2 * 20 + 2 as double) as bx", "gid div 2 as bid").distinct()
    return A.repeat_signs(dots, bars, PAGE, "x", "gid", "bx", "bid", 2.0, like=line)


@query(
    "cover_ranges",
    f"""with e as ({EVENTS_SQL}) select p.event_id, bool_or(r.event_id is not null) as covered from e p left join e r on r.user_id = p.user_id
      and r.event_type = 'view' and p.sec >= r.sec and p.sec <= r.sec + r.value * 1000 where p.event_type = 'click' group by 1""",
)
def cover_ranges(spark, folder):
    found = A.apply_ranges(
        kind(spark, folder, "click"), kind(spark, folder, "view"), USER, "sec", "event_id",
        F.col("sec"), F.col("sec") + F.col("value") * 1000, "event_id",
    )
    return found.select("event_id", "covered")


@query(
    "grow_range",
    f"""with g as (select *, case when fret % 4 = 0 then 'mark' else 'dash' end as k, gid * 10.0 as a, gid * 10.0 + 4 + units % 7 as b from ({GLYPH_SQL})),
    d as (select *, case when a - max(b) over (partition by l_orderkey order by a rows between unbounded preceding and 1 preceding) <= 3 then 0 else 1 end as st from g where k = 'dash'),
    r as (select *, sum(st) over (partition by l_orderkey order by a) as run from d),
    q as (select l_orderkey, run, max(b) as e from r group by 1, 2), s as (select r.l_orderkey, r.a, q.e from r join q using (l_orderkey, run)),
    n as (select m.l_orderkey, m.gid, m.b, min(s.a) as na, min_by(s.e, s.a) as ne from g m left join s on s.l_orderkey = m.l_orderkey and s.a >= m.b - 1 where m.k = 'mark' group by all)
    select l_orderkey, gid, cast(case when na - b <= 3 then greatest(b, ne) else b end as double) as range_end from n""",
)
def grow_range(spark, folder):
    line = glyph_line(spark, folder)
    g = line.df.selectExpr("l_orderkey", "gid", "fret", "gid * 10.0D as a", "gid * 10.0D + 4 + units % 7 as b")
    found = A.grow_range(g.where("fret % 4 = 0"), g.where("fret % 4 <> 0"), PAGE, "b", "gid", "a", "b", "gid", 3.0, like=line)
    return found.select("l_orderkey", "gid", "range_end")


@query(
    "nearest_owner",
    f"""with e as ({EVENTS_SQL}), c as (select m.event_id, s.event_id as owner, round(m.value - s.value, 6) as distance,
        row_number() over (partition by m.event_id order by s.value desc, s.event_id desc) as rn
      from e m join e s on s.user_id = m.user_id and m.event_type = 'error' and s.event_type = 'signup' and s.value < m.value)
    select m.event_id, case when distance < 8 then owner end as owner, case when distance < 8 then distance end as distance
      from e m left join c on c.event_id = m.event_id and rn = 1 where m.event_type = 'error'""",
)
def nearest_owner(spark, folder):
    found = A.nearest_owner(
        kind(spark, folder, "error"), kind(spark, folder, "signup"), USER, "value", "event_id", "value", "event_id", 8.0
    )
    return found.select("event_id", "owner", F.round("distance", 6).alias("distance"))


@query(
    "between_pair",
    f"""with g as ({GLYPH_SQL}), n as (select l_orderkey, string, gid, x0, lead(x0) over w as x1, lead(gid) over w as g1 from g where fret % 3 > 0
        window w as (partition by l_orderkey, string order by x0, gid)),
    c as (select m.l_orderkey, m.gid, min((abs((n.x0 + n.x1) / 2 - m.x0) + 0.5 * (n.x1 - n.x0), n.string, n.gid, n.g1)) as b from g m join n on n.l_orderkey = m.l_orderkey
      and m.fret % 3 = 0 and n.x0 < m.x0 and m.x0 < n.x1 and n.x1 - n.x0 <= 40 group by 1, 2)
    select l_orderkey, gid, round(b[1], 6) as cost, b[2] as string, b[3] as first_id, b[4] as second_id from c""",
)
def between_pair(spark, folder):
    g = glyphs(spark, folder)
    found = A.between_pair(
        g.where("fret % 3 = 0"), g.where("fret % 3 > 0").withColumnRenamed("gid", "nid"), PAGE, "x0", "gid", "string", "x0", "nid", 40.0
    )
    return found.select("l_orderkey", "gid", F.round("cost", 6).alias("cost"), "string", "first_id", "second_id")


@query(
    "isolated_marks",
    f"""with g as ({GLYPH_SQL}) select l_orderkey, gid from g where not exists (select 1 from g o where o.l_orderkey = g.l_orderkey and o.gid <> g.gid
      and ((o.x0 - g.x1 >= 0 and o.x0 - g.x1 < 0.5 * (g.x1 - g.x0)) or (g.x0 - o.x1 >= 0 and g.x0 - o.x1 < 0.5 * (g.x1 - g.x0))))""",
)
def isolated_marks(spark, folder):
    return A.isolated(glyphs(spark, folder), PAGE, "x0", "x1", "gid").select("l_orderkey", "gid")


@query(
    "attach_next",
    f"""with e as ({EVENTS_SQL}), n as (select * from e where event_type <> 'signup'), a as (select m.user_id, m.event_id, m.value, m.props, min(n.value) as to_x
      from e m join n on n.user_id = m.user_id and n.value > m.value where m.event_type = 'signup' group by all),
    b as (select * from a where to_x - value <= 2.5),
    c as (select n.event_id, max_by(b, (b.to_x, b.event_id)) as b from n join b on b.user_id = n.user_id and b.to_x <= n.value group by 1)
    select n.event_id, case when n.value - c.b.to_x <= 0.5 and n.value - c.b.value <= 2.5 then c.b.props end as attached from n left join c using (event_id)""",
)
def attach_next(spark, folder):
    found = A.attach_next(
        kind(spark, folder, "signup"), events(spark, folder).where("event_type <> 'signup'"), USER, "value", "event_id",
        "value", "event_id", "props", 2.5, 0.5,
    )
    return found.select("event_id", "attached")


SLIDE_SQL = f"""with g as ({GLYPH_SQL}), n as (select l_orderkey, string, gid as nid, gid * 4.0 as x, 1.0 + fret % 2 as half from g where fret % 3 > 0),
  s as (select l_orderkey, string, gid as sid, gid * 4.0 - 2 as x0, gid * 4.0 + units % 3 * 2 as x1, units % 2 = 0 as rising from g where fret % 3 = 0),
  ar as (select l_orderkey, string, gid as aid, gid * 4.0 as x0, gid * 4.0 + 4 * (1 + units % 3) as x1 from g where units % 5 < 3)"""


@query(
    "slides",
    SLIDE_SQL
    + """, b as (select s.l_orderkey, s.sid, max_by(n, (n.x + n.half, n.nid)) as b from s join n on n.l_orderkey = s.l_orderkey and n.string = s.string and n.x + n.half <= s.x0 + 0.6 group by 1, 2),
    a as (select s.l_orderkey, s.sid, min_by(n, (n.x - n.half, n.nid)) as a from s join n on n.l_orderkey = s.l_orderkey and n.string = s.string and n.x - n.half >= s.x1 - 0.6 group by 1, 2),
    j as (select s.*, case when s.x0 - (b.b.x + b.b.half) <= 1.6 then b.b.nid end as before_id, case when s.x0 - (b.b.x + b.b.half) <= 1.6 then b.b.x end as bx,
      case when (a.a.x - a.a.half) - s.x1 <= 1.6 then a.a.nid end as after_id, case when (a.a.x - a.a.half) - s.x1 <= 1.6 then a.a.x end as ax
      from s left join b on b.l_orderkey = s.l_orderkey and b.sid = s.sid left join a on a.l_orderkey = s.l_orderkey and a.sid = s.sid),
    k as (select j.*, exists (select 1 from ar where ar.l_orderkey = j.l_orderkey and ar.string = j.string and abs(ar.x0 - j.bx) <= 1.6 and abs(ar.x1 - j.ax) <= 1.6) as slur from j),
    z as (select l_orderkey, string, sid, before_id, after_id, case when before_id is not null and after_id is not null then case when slur then 'legato' else 'shift' end
      when before_id is not null and x1 - x0 <= 5 then case when rising then 'out_up' else 'out_down' end
      when after_id is not null and x1 - x0 <= 5 then case when rising then 'in_below' else 'in_above' end end as kind from k)
    select * from z where kind is not null""",
)
def slides(spark, folder):
    line = glyph_line(spark, folder)
    g = line.df
    notes = g.where("fret % 3 > 0").selectExpr("l_orderkey", "string", "gid as nid", "gid * 4.0D as x", "1.0D + fret % 2 as half")
    strokes = g.where("fret % 3 = 0").selectExpr(
        "l_orderkey", "string", "gid as sid", "gid * 4.0D - 2 as x0", "gid * 4.0D + units % 3 * 2 as x1", "units % 2 = 0 as rising"
    )
    arcs = g.where("units % 5 < 3").selectExpr(
        "l_orderkey", "string", "gid as aid", "gid * 4.0D as x0", "gid * 4.0D + 4 * (1 + units % 3) as x1"
    )
    return A.slides(strokes, notes, arcs, STRING, 2.0, like=line)


@query(
    "bends",
    f"""with g as (select *, gid * 3.0 as x from ({GLYPH_SQL})), n as (select * from g where fret % 3 > 0),
    h as (select *, units % 4 = 1 as straight, units % 5 = 0 as down, case fret % 4 when 0 then 2 when 1 then 1 when 2 then 3 else 2 end as amount from g where fret % 3 = 0),
    u as (select h.l_orderkey, h.string, h.gid, any_value(straight) as straight, any_value(amount) as amount, min_by(n.gid, (abs(n.x - h.x), n.x)) as nid, min(abs(n.x - h.x)) as d
      from h join n on n.l_orderkey = h.l_orderkey and n.string = h.string where not down group by 1, 2, 3),
    b as (select l_orderkey, string, nid, max_by(amount, gid) as semitones, max_by(straight, gid) as pre_bend from u where d <= case when straight then 1.5 else 5.4 end group by 1, 2, 3),
    dn as (select * from h where down),
    be as (select dn.l_orderkey, dn.string, dn.gid, min_by(b.nid, (abs(b.nid * 3.0 - dn.x), b.nid)) as bid, min(abs(b.nid * 3.0 - dn.x)) as d from dn join b on b.l_orderkey = dn.l_orderkey and b.string = dn.string group by 1, 2, 3),
    la as (select dn.l_orderkey, dn.string, dn.gid, max(n.gid) as lid from dn join n on n.l_orderkey = dn.l_orderkey and n.string = dn.string and n.x <= dn.x group by 1, 2, 3),
    r as (select dn.l_orderkey, dn.string, coalesce(case when be.d <= 5.4 then be.bid end, lid) as nid from dn left join be using (l_orderkey, string, gid) left join la using (l_orderkey, string, gid))
    select b.l_orderkey, b.string, b.nid, semitones, pre_bend, exists (select 1 from r where r.l_orderkey = b.l_orderkey and r.string = b.string and r.nid = b.nid) as release from b""",
)
def bends(spark, folder):
    g = glyphs(spark, folder).withColumn("x", F.col("gid") * 3.0)
    heads = g.where("fret % 3 = 0").selectExpr(
        "l_orderkey", "string", "gid as hid", "x", "units % 4 = 1 as straight", "units % 5 = 0 as down",
        "case fret % 4 when 0 then 'full' when 1 then '1/2' when 2 then '11/2' else '?' end as label",
    )
    notes = g.where("fret % 3 > 0").selectExpr("l_orderkey", "string", "gid as nid", "x")
    return A.bends(heads, notes, STRING, 3.0)


@query(
    "tie_arcs",
    f"""with g as (select *, gid * 3.0 as x from ({GLYPH_SQL})), n0 as (select *, fret % 4 = 0 as par, (select max(o.x) from g o where o.l_orderkey = g.l_orderkey and o.string = g.string and o.x < g.x - 1) as prev from g),
    n as (select *, coalesce(prev, 4.0 - 2) - 3 as st from n0), ar as (select l_orderkey, string, x - case when fret % 5 = 0 then units % 3 + 1.5 else 6 end as a0, x - units % 3 as a1 from g where units % 3 > 0),
    t as (select n.l_orderkey, n.string, n.gid, exists (select 1 from ar where ar.l_orderkey = n.l_orderkey and ar.string = n.string and (a1 - a0 > 2 or (prev is null and a1 - a0 > 0.4 and a0 <= 8))
      and n.x - 5 <= a1 and a1 <= n.x + 0.6 and a0 >= st) as arc from n where par),
    p as (select l_orderkey, bool_or(arc) as anyarc from t group by 1)
    select t.l_orderkey, string, gid as nid, case when anyarc then arc end as tie_arc from t join p using (l_orderkey)""",
)
def tie_arcs(spark, folder):
    line = glyph_line(spark, folder)
    g = line.df.withColumn("x", F.col("gid") * 3.0)
    notes = g.selectExpr("l_orderkey", "string", "gid as nid", "x", "fret % 4 = 0 as parenthesized", "4.0D as left")
    arcs = g.where("units % 3 > 0").selectExpr("l_orderkey", "string", "gid as aid", "x - if(fret % 5 = 0, units % 3 + 1.5D, 6.0D) as x0", "x - units % 3 as x1")
    return A.tie_arcs(notes, arcs, STRING, PAGE, 2.0, like=line)


@query(
    "hairpins",
    f"""with g as ({GLYPH_SQL}), s as (select l_orderkey, gid as sid, gid // 2 * 20.0 + fret % 3 as x0, gid // 2 * 20.0 + 15 as x1, gid % 2 = 0 as rising, 1.0 * (fret % 5) as top, 1.0 * (fret % 5 + 1 + units % 4) as bottom from g),
    j as (select u.l_orderkey, u.x0 as ux, d.x0 as dx, u.x1 as ue, d.x1 as de, abs(u.bottom - d.top) as lf, abs(u.top - d.bottom) as rt from s u join s d on u.l_orderkey = d.l_orderkey and u.rising and not d.rising
      where abs(u.x0 - d.x0) <= 1 and abs(u.x1 - d.x1) <= 1)
    select distinct l_orderkey, cast(least(ux, dx) as double) as x0, cast(greatest(ue, de) as double) as x1, case when rt > lf then 1 else -1 end as direction from j where abs(rt - lf) >= 0.6 and least(lf, rt) <= 2""",
)
def hairpins(spark, folder):
    s = glyphs(spark, folder).selectExpr(
        "l_orderkey", "gid as sid", "gid div 2 * 20.0D + fret % 3 as x0", "gid div 2 * 20.0D + 15 as x1", "gid % 2 = 0 as rising",
        "1.0D * (fret % 5) as top", "1.0D * (fret % 5 + 1 + units % 4) as bottom",
    )
    return A.hairpins(s, PAGE, 2.0)


@query(
    "decode_symbols",
    "select c_custkey, case lower(replace(c_mktsegment, ' ', '')) when 'building' then 79 when 'machinery' then 95 when 'household' then 111 end as meaning from customer",
)
def decode_symbols(spark, folder):
    segments = {"building": 79, "machinery": 95, "household": 111}
    return A.decode_symbols(table(spark, folder, "customer"), F.col("c_mktsegment"), segments).select("c_custkey", "meaning")


@query(
    "read_stems",
    f"""with g as (select *, gid * 6.0 as x from ({GLYPH_SQL})), st as (select l_orderkey, gid as sid, x, 0.0 as top, 1.0 * (2 + units % 5) as bottom from g),
    bm as (select l_orderkey, x - 1 as x0, x + 7 * (units % 3) as x1, fret % 3 * 2.0 as top from g where fret % 4 = 1),
    fl as (select l_orderkey, x + 0.5 as x, case when units % 2 = 0 then 4 else 2 end as u from g where fret % 4 = 2),
    dt as (select l_orderkey, x + 1 + units % 3 as x from g where fret % 6 = 0),
    md as (select l_orderkey, median(bottom - top) as typ from st group by 1),
    cv as (select sid, st.l_orderkey, count(distinct round_even(bm.top, 0)) as n from st join bm on bm.l_orderkey = st.l_orderkey and bm.x0 - 2 <= x and x <= bm.x1 + 2 group by 1, 2),
    ff as (select sid, st.l_orderkey, min(u) as u from st join fl on fl.l_orderkey = st.l_orderkey and fl.x - st.x between -1.0 and 2.0 group by 1, 2),
    a as (select st.*, n, u, typ, exists (select 1 from dt where dt.l_orderkey = st.l_orderkey and dt.x > st.x and dt.x <= st.x + 3.0) as dot
      from st left join cv using (l_orderkey, sid) left join ff using (l_orderkey, sid) join md using (l_orderkey)),
    b as (select *, case when n is not null then case n when 1 then 4 when 2 then 2 when 3 then 1 end
      else coalesce(u, case when bottom - top <= 0.7 * greatest(typ, 3.0) then 16 else 8 end) end as un from a)
    select l_orderkey, sid, cast(case when dot then case when un in (2, 4, 8, 16, 32) then un * 3 // 2 end else un end as int) as units from b""",
)
def read_stems(spark, folder):
    g = glyphs(spark, folder).withColumn("x", F.col("gid") * 6.0)
    stems = g.selectExpr("l_orderkey", "gid as sid", "x", "0.0D as top", "1.0D * (2 + units % 5) as bottom")
    beams = g.where("fret % 4 = 1").selectExpr("l_orderkey", "gid as bid", "x - 1 as x0", "x + 7 * (units % 3) as x1", "fret % 3 * 2.0D as top")
    flags = g.where("fret % 4 = 2").selectExpr("l_orderkey", "gid as fid", "x + 0.5D as x", "if(units % 2 = 0, 4, 2) as units")
    dots = g.where("fret % 6 = 0").selectExpr("l_orderkey", "gid as did", "x + 1 + units % 3 as x")
    return A.read_stems(stems, beams, flags, dots, PAGE, 2.0)


@query(
    "time_signatures",
    f"""with g as (select *, gid // 3 * 30.0 + gid % 3 * 2.0 as x, case when gid % 3 = 2 or units % 4 = 0 then 8.0 else 0.0 end as y, units % 5 + 1 as dg from ({GLYPH_SQL})),
    t as (select *, case when x - lag(x) over w <= 4 then 0 else 1 end as st from g window w as (partition by l_orderkey order by x, gid)),
    r as (select *, sum(st) over (partition by l_orderkey order by x, gid) as sign from t),
    s as (select l_orderkey, sign, y, string_agg(dg::varchar, '' order by x, gid) as n, min(x) as x from r group by 1, 2, 3),
    q as (select l_orderkey, sign, min(x) as x, count(*) as c, cast(min_by(n, y) as int) as num, cast(max_by(n, y) as int) as den from s group by 1, 2)
    select l_orderkey, cast(x as double) as x, num, den from q where c = 2 and num between 1 and 32 and den in (1, 2, 4, 8, 16, 32)""",
)
def time_signatures(spark, folder):
    g = glyphs(spark, folder).selectExpr(
        "l_orderkey", "gid", "gid div 3 * 30.0D + gid % 3 * 2.0D as x", "if(gid % 3 = 2 or units % 4 = 0, 8.0D, 0.0D) as y", "units % 5 + 1 as dg"
    )
    return A.time_signatures(g, PAGE, "x", "y", "dg", "gid", 4.0, 10.0)


@query(
    "bar_numbers",
    f"""with e as ({EVENTS_SQL}), n as (select b.event_id, count(v.event_id) as c, max(v.event_id) as m from e b left join e v on v.user_id = b.user_id
      and v.event_type = 'view' and v.value between b.value - 1.5 and b.value + 1.5 where b.event_type = 'purchase' group by 1)
    select event_id, case when c = 1 then m end as number from n""",
)
def bar_numbers(spark, folder):
    views = kind(spark, folder, "view").withColumnRenamed("event_id", "n")
    found = A.bar_numbers(kind(spark, folder, "purchase"), views, USER, "value", "event_id", "value", "n", 1.5)
    return found.select("event_id", "number")


@query(
    "staff_labels",
    f"""with g as (select l_orderkey, string, substr('EADGBHCF', cast(min(fret % 8) as int) + 1, 1) as l from ({GLYPH_SQL}) group by 1, 2)
    select l_orderkey, case when bool_and(regexp_matches(l, '^[A-G]')) then string_agg(l, ' ' order by string) end as labels from g group by 1""",
)
def staff_labels(spark, folder):
    lines = glyphs(spark, folder).groupBy("l_orderkey", "string").agg(F.min(F.col("fret") % 8).alias("f"))
    lines = lines.withColumn("l", F.expr("substr('EADGBHCF', f + 1, 1)"))
    return A.staff_labels(lines, PAGE, "string", F.col("l"))


@query(
    "bar_counts",
    f"""with g as (select *, gid * 10.0 as x from ({GLYPH_SQL})), b as (select l_orderkey, gid as bid, x as s, x + 10 as e from g where gid % 2 = 0),
    n as (select l_orderkey, x + 3 as x from g where fret % 3 = 0), c as (select l_orderkey, gid - gid % 2 as p, (gid - gid % 2) * 10.0 + 4 as x, 2 + units % 9 as v from g where fret % 5 < 2),
    j as (select b.l_orderkey, b.bid, count(*) as k, max(v) as v from b join c on c.l_orderkey = b.l_orderkey and c.x >= b.s and c.x < b.e group by 1, 2)
    select l_orderkey, bid, v as rest_bars from j where k = 1 and not exists (select 1 from n where n.l_orderkey = j.l_orderkey and n.x >= j.bid * 10.0 and n.x < j.bid * 10.0 + 10)""",
)
def bar_counts(spark, folder):
    g = glyphs(spark, folder).withColumn("x", F.col("gid") * 10.0)
    bars = g.where("gid % 2 = 0").selectExpr("l_orderkey", "gid as bid", "x as start", "x + 10 as end")
    notes = g.where("fret % 3 = 0").selectExpr("l_orderkey", "gid as nid", "x + 3 as x")
    counts = g.where("fret % 5 < 2").selectExpr("l_orderkey", "gid as cid", "(gid - gid % 2) * 10.0D + 4 as x", "2 + units % 9 as v")
    return A.bar_counts(bars, notes, counts, PAGE, "bid", "x", "nid", "x", "cid", "v")


@query(
    "volta_passes",
    f"""with t as (select l_orderkey, item, case l_partkey % 4 when 0 then '1.' when 1 then '1., 2.' when 2 then concat(units, '. ') else 'x3' end as label from ({ITEMS_SQL}))
    select l_orderkey, item, case when regexp_matches(replace(label, ' ', ''), '^[0-9]([.,][0-9])*\\.$') or regexp_matches(replace(label, ' ', ''), '^[0-9](\\.,[0-9])*\\.$')
      then array_to_string(list_sort(list_distinct(regexp_extract_all(label, '[0-9]'))), ',') end as passes from t""",
)
def volta_passes(spark, folder):
    label = F.expr("case l_partkey % 4 when 0 then '1.' when 1 then '1., 2.' when 2 then concat(units, '. ') else 'x3' end")
    return items(spark, folder).select("l_orderkey", "item", F.array_join(A.volta_passes(label), ",").alias("passes"))


@query(
    "zone_text",
    f"""with e as ({EVENTS_SQL}), c as (select w.event_id, max_by(s.event_id, (s.value, s.event_id)) as sid, max(s.value) as sv from e w join e s on s.user_id = w.user_id
      and s.event_type = 'signup' and w.event_type = 'error' and s.value <= w.value - 0.5 group by 1)
    select e.event_id, sid as staff from e join c using (event_id) where e.value - sv <= 8""",
)
def zone_text(spark, folder):
    found = A.zone_text(
        kind(spark, folder, "error"), kind(spark, folder, "signup"), USER, "value", "event_id", "value", "event_id", 0.5, 8.0
    )
    return found.select("event_id", "staff")


@query(
    "without_techniques",
    f"""with w as (select l_orderkey, item, list_value('let', 'ring', 'la', 'P', 'p.m.', 'palm', 'mute', 'so')[cast(l_partkey % 8 as int) + 1] as word from ({ITEMS_SQL})),
    k as (select *, lower(regexp_replace(word, '[.-]', '', 'g')) as k from w),
    t as (select *, lead(k) over v as nx, lag(k) over v as pv from k window v as (partition by l_orderkey order by item))
    select l_orderkey, item, word from t where not (word in ('H', 'P') or k in ('letring', 'lr', 'pm', 'palmmute')
      or concat_ws(' ', k, nx) in ('let ring', 'palm mute', 'p m') or concat_ws(' ', pv, k) in ('let ring', 'palm mute', 'p m'))""",
)
def without_techniques(spark, folder):
    word = F.expr("element_at(array('let', 'ring', 'la', 'P', 'p.m.', 'palm', 'mute', 'so'), cast(l_partkey % 8 as int) + 1)")
    words = items(spark, folder).select("l_orderkey", "item", word.alias("word"))
    return A.without_techniques(words, PAGE, "item", "word")


@query(
    "sized_numbers",
    f"""with g as (select *, bottom - top as h from ({GLYPH_SQL})), r as (select *, row_number() over (partition by l_orderkey order by h) - 1 as rn, count(*) over (partition by l_orderkey) as n from g),
    t as (select l_orderkey, max(case when rn = 3 * n // 4 then h end) as typ from r group by 1)
    select g.l_orderkey, g.gid, h < 0.85 * typ as small from g join t using (l_orderkey)""",
)
def sized_numbers(spark, folder):
    found = A.sized_numbers(glyphs(spark, folder), PAGE, F.col("bottom") - F.col("top"))
    return found.select("l_orderkey", "gid", "small")


@query(
    "bracketed",
    f"""with g as (select l_orderkey, gid, x0, case fret % 3 when 0 then '(' when 1 then ')' else fret::varchar end as t from ({GLYPH_SQL})),
    w as (select *, lag(t) over v = '(' and lead(t) over v = ')' as b from g window v as (partition by l_orderkey order by x0, gid))
    select l_orderkey, gid, coalesce(b, false) as bracketed from w""",
)
def bracketed(spark, folder):
    marks = glyphs(spark, folder).selectExpr("l_orderkey", "gid", "x0", "case fret % 3 when 0 then '(' when 1 then ')' else cast(fret as string) end as t")
    return A.bracketed(marks, PAGE, ["x0", "gid"], "t").select("l_orderkey", "gid", "bracketed")


@query(
    "strum_marks",
    f"""with recursive g as (select l_orderkey, gid, gid // 4 * 20.0 + fret % 2 as x, string * 1.0 as y, units % 5 = 0 as arrow from ({GLYPH_SQL})),
    a(l_orderkey, ax) as (select l_orderkey, min(x) from g group by 1 union all select a.l_orderkey, min(g.x) from a join g on g.l_orderkey = a.l_orderkey and g.x - a.ax > 1.0 group by a.l_orderkey, a.ax),
    n as (select *, row_number() over (partition by l_orderkey order by ax) as group_no from a),
    q as (select g.l_orderkey, group_no, avg(x) as x, avg(y) filter (not arrow) as mid, min_by(y, (x, gid)) filter (arrow) as head from g asof join n on g.l_orderkey = n.l_orderkey and g.x >= n.ax group by 1, 2)
    select l_orderkey, group_no, round(x, 6) as x, case when head > mid then 'up' else 'down' end as stroke from q where mid is not null""",
)
def strum_marks(spark, folder):
    parts = glyphs(spark, folder).selectExpr(
        "l_orderkey", "gid", "gid div 4 * 20.0D + fret % 2 as x", "string * 1.0D as y", "units % 5 = 0 as arrow"
    )
    return A.strum_marks(parts, PAGE, "x", "y", "gid", "arrow", 2.0).withColumn("x", F.round("x", 6))


@query(
    "candidate_positions",
    f"""with g as ({GLYPH_SQL}) select l_orderkey, gid, round(unnest([(top + bottom) / 2, top - 0.9 * (bottom - top)]), 6) as y from g""",
)
def candidate_positions(spark, folder):
    both = A.candidate_positions(glyphs(spark, folder), F.col("top"), F.col("bottom"))
    return both.select("l_orderkey", "gid", F.round("y", 6).alias("y"))
