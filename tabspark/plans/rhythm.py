"""Queries of the vote and rhythm operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rhythm as R
from ..operators import vote as V
from .registry import query
from .tables import BARS_SQL, EVENTS_SQL, ITEMS_SQL, LINES_SQL, bars, doc_lines, events, item_line, items, table

ORDER, USER, CUST = ["l_orderkey"], ["user_id"], ["o_custkey"]
GREEDY = "case " + " ".join(f"when rest >= {v} then {v}" for v in R.REPRESENTABLE_UNITS) + " end"
# Every length 1..200 as its parts: sp(u, k, part).
SPLIT_SQL = f"""sp0(u, k, part, rest) as (select cast(range as int), -1, 0, cast(range as int) from range(1, 201) union all
    select u, k + 1, {GREEDY}, rest - {GREEDY} from sp0 where rest > 0),
  sp as (select u, k, part from sp0 where k >= 0)"""


@query(
    "majority_filter",
    f"""with i as (select *, units % 3 as v, l_partkey % 4 > 0 as votes from ({ITEMS_SQL})),
    c as (select l_orderkey, v, count(*) filter (votes) as n, min(item) filter (votes) as f from i group by 1, 2),
    b as (select l_orderkey, min_by(v, (-n, f)) as v, sum(n) - max(n) as dropped from c where n > 0 group by 1)
    select i.l_orderkey, i.item, i.v, cast(dropped as bigint) as dropped from i join b on b.l_orderkey = i.l_orderkey and b.v = i.v""",
)
def majority_filter(spark, folder):
    rows = items(spark, folder).withColumn("v", F.col("units") % 3)
    return V.majority_filter(rows, ORDER, "v", ["item"], F.col("l_partkey") % 4 > 0).select("l_orderkey", "item", "v", "dropped")


@query(
    "consensus",
    """with r as (select conv_id, case when turn % 4 = 3 then 'x' else cast(length(text) % 3 as varchar) end as reading from conversations),
    c as (select conv_id, reading, count(*) as n, rank() over (partition by conv_id order by count(*) desc) as rk from r where reading <> 'x' group by 1, 2),
    w as (select conv_id, case when count(*) = 1 then min(reading) end as agreed from c where rk = 1 group by 1)
    select distinct r.conv_id, coalesce(agreed, '') as agreed from r left join w using (conv_id)""",
)
def consensus(spark, folder):
    reading = F.when(F.col("turn") % 4 == 3, "x").otherwise((F.length("text") % 3).cast("string"))
    return V.consensus(table(spark, folder, "conversations").withColumn("reading", reading), ["conv_id"], "reading")


@query("longest_increasing")
def longest_increasing(spark, folder):
    kept = V.longest_increasing(bars(spark, folder).select("o_custkey", "bar", "o_totalprice"), CUST, "bar", "o_totalprice")
    return kept.select("o_custkey", "bar", "o_totalprice")


@query(
    "repair_readings",
    f"select doc_id, line_no, length(r) as n, r <> line as changed from (select *, regexp_replace(translate(line, 'Oo。lI|', '000111'), '[^0-9()xX]', '', 'g') as r from ({LINES_SQL}))",
)
def repair_readings(spark, folder):
    repaired = V.repair_reading(F.col("line"))
    return doc_lines(spark, folder).select("doc_id", "line_no", F.length(repaired).alias("n"), (repaired != F.col("line")).alias("changed"))


@query(
    "split_units",
    f"with recursive {SPLIT_SQL} select l_orderkey, item, k as part, sp.part as units from ({ITEMS_SQL}) i join sp on sp.u = i.units",
)
def split_units(spark, folder):
    return items(spark, folder).select("l_orderkey", "item", F.posexplode(R.split_units(F.col("units"))).alias("part", "units"))


@query(
    "pack_bars",
    f"""with recursive {SPLIT_SQL}, i as (select l_orderkey, item, units, cast(sum(units) over (partition by l_orderkey order by item) - units as bigint) as s from ({ITEMS_SQL})),
    b as (select *, unnest(range(s // 32, (s + units - 1) // 32 + 1)) as bar from i),
    c as (select l_orderkey, item, bar, bar > s // 32 as later, least(s + units, (bar + 1) * 32) - greatest(s, bar * 32) as len from b),
    t as (select l_orderkey, cast(sum(units) as bigint) as total from i group by 1 having sum(units) % 32 > 0)
    select l_orderkey, cast(bar as bigint) as bar, item, k as part, sp.part as units, k > 0 or later as tie from c join sp on sp.u = c.len union all
    select l_orderkey, cast(total // 32 as bigint), null, k, sp.part, false from t join sp on sp.u = 32 - total % 32""",
)
def pack_bars(spark, folder):
    return R.pack_into_bars(items(spark, folder), ORDER, "item", "units", 32)


# Where plain and triplet items begin: f(l_orderkey, item, units, three, start3, nxt, bar, nbar), of which nxt and nbar come after the item.
TRIPLET_SQL = f"""i as (select *, l_partkey % 4 = 0 as three from ({ITEMS_SQL})),
    f(l_orderkey, item, units, three, start3, nxt, bar, nbar) as (select l_orderkey, item, units, three, 0, case when three then case when 2 * units >= 96 then 0 else 2 * units end else 3 * units % 96 end, 0,
        case when three then case when 2 * units >= 96 then 1 else 0 end else 3 * units // 96 end from i where item = 0 union all
      select i.l_orderkey, i.item, i.units, i.three, f.nxt, case when i.three then case when f.nxt + 2 * i.units >= 96 then 0 else f.nxt + 2 * i.units end else (f.nxt + 3 * i.units) % 96 end, f.nbar,
        f.nbar + case when i.three then case when f.nxt + 2 * i.units >= 96 then 1 else 0 end else (f.nxt + 3 * i.units) // 96 end
      from f join i on i.l_orderkey = f.l_orderkey and i.item = f.item + 1)"""


def triplet_items(spark, folder):
    line = item_line(spark, folder)
    return line.df.select("l_orderkey", "item", "units", (F.col("l_partkey") % 4 == 0).alias("three")), line


@query("pack_triplets", f"with recursive {TRIPLET_SQL} select l_orderkey, item, cast(bar as bigint) as bar, cast(start3 as bigint) as start3 from f")
def pack_triplets(spark, folder):
    rows, line = triplet_items(spark, folder)
    return R.pack_triplets(rows, ORDER, "item", "units", "three", 32, like=line).select("l_orderkey", "item", "bar", "start3")


@query(
    "pack_triplet_bars",
    f"""with recursive {SPLIT_SQL}, {TRIPLET_SQL},
    so as (select u, k, part, coalesce(sum(part) over (partition by u order by k rows between unbounded preceding and 1 preceding), 0) as before from sp),
    p as (select *, unnest(range(0, (start3 + 3 * units - 1) // 96 + 1)) as j from f where not three),
    c as (select l_orderkey, item, bar + j as bar, greatest(start3, 96 * j) as low, j, (least(start3 + 3 * units, 96 * j + 96) - greatest(start3, 96 * j)) // 3 as u, j > 1 or (j = 1 and 96 - start3 >= 3) as later from p),
    n as (select l_orderkey, bar, low - 96 * j + 3 * before as at3, item, k as part, so.part as units, false as tuplet, k > 0 or later as tie from c join so using (u)
      union all select l_orderkey, bar, start3, item, 0, units, true, false from f where three),
    l as (select l_orderkey, max_by(nbar, item) as bar, max_by(nxt, item) as fill from f group by 1),
    g as (select * from l where fill > 0 and exists (select 1 from n where n.l_orderkey = l.l_orderkey and n.bar = l.bar))
    select l_orderkey, cast(bar as bigint) as bar, cast(at3 as bigint) as at3, item, part, cast(units as int) as units, tuplet, tie from n union all
    select l_orderkey, bar, cast(fill + 3 * before as bigint), null, k, so.part, false, false from g join so on so.u = (96 - fill) // 3""",
)
def pack_triplet_bars(spark, folder):
    rows, line = triplet_items(spark, folder)
    return R.pack_triplet_bars(rows, ORDER, "item", "units", "three", 32, like=line)


# One bar per user and day; a point's place is the minute of the day.
POINTS_SQL = f"""select user_id, event_id, cast(floor(sec / 86400.0) as bigint) as day, cast(floor(sec / 60.0) - floor(sec / 86400.0) * 1440 as double) as x,
  cast(0 as double) as origin, cast(1440 as double) as "end" from ({EVENTS_SQL})"""


def points(spark, folder):
    return events(spark, folder).select(
        "user_id",
        "event_id",
        F.floor(F.col("sec") / 86400.0).alias("day"),
        (F.floor(F.col("sec") / 60.0) - F.floor(F.col("sec") / 86400.0) * 1440).cast("double").alias("x"),
        F.lit(0.0).alias("origin"),
        F.lit(1440.0).alias("end"),
    )


def fallback_sql(slots):
    """Points in proportion, in a bar of so many slots; more points than slots are 32nds one after another."""
    return f"""p as ({POINTS_SQL}), p1 as (select *, row_number() over w as i, count(*) over (partition by user_id, day) as n from p window w as (partition by user_id, day order by x, event_id)),
  p2 as (select *, case when n * 2 <= {slots} then 2 else 1 end as g from p1), p3 as (select *, least(greatest(round_even((x - origin) / ("end" - origin) * {slots} / g, 0) * g, 0), {slots} - g) as q from p2),
  p4 as (select *, max(q - i * g) over (partition by user_id, day order by i) + i * g as pushed from p3),
  fb as (select *, cast(case when n > {slots} then i - 1 else least(pushed, {slots} - (n - i + 1) * g) end as int) as fallback from p4)"""


@query("snap_fallback", f"with {fallback_sql(4)} select user_id, day, event_id, fallback as onset from fb")
def snap_fallback(spark, folder):
    found = R.snap_fallback(points(spark, folder), ["user_id", "day"], "x", "event_id", "origin", "end", 4)
    return found.select("user_id", "day", "event_id", "onset")


@query(
    "quantize_onsets",
    f"""with {fallback_sql(32)}, gp as (select user_id, day, x - lag(x) over (partition by user_id, day order by i) as gap from fb),
    b as (select user_id, day, n, list(x order by i) as xs from fb group by 1, 2, 3),
    gr(g, pen) as (values (4, 0.0::double), (2, 0.05::double), (1, 0.12::double)),
    s as (select distinct user_id, day, g, pen, s from (select user_id, day, g, pen, 32 / 1440.0::double as s from b, gr where n * g <= 32 union all
      select b.user_id, b.day, g, pen, g * k / gap from b join gp on gp.user_id = b.user_id and gp.day = b.day and gap > 0, gr, (select unnest(range(1, 9)) as k) where n * g <= 32)),
    t as (select s.*, fb.i, fb.event_id, x * s.s / s.g as spot, round_even(x * s.s / s.g, 0) as step from s join fb on fb.user_id = s.user_id and fb.day = s.day),
    u as (select *, lag(step) over (partition by user_id, day, g, s order by i) as pv from t),
    v as (select user_id, day, g, s, abs(1440 * s - 32) / 32 + 0.5 * max(abs(spot - step)) + pen as cost from u group by user_id, day, g, pen, s
      having bool_and(pv is null or step > pv) and min(step) >= 0 and max(step) * g <= 32 - g and max(abs(spot - step)) <= 0.25),
    w as (select user_id, day, min_by((g, s), (cost, -g, s)) as best from v group by 1, 2)
    select fb.user_id, fb.day, fb.event_id, cast(coalesce(t.step * t.g, fallback) as int) as onset from fb left join w on w.user_id = fb.user_id and w.day = fb.day
      left join t on t.user_id = fb.user_id and t.day = fb.day and t.event_id = fb.event_id and (t.g, t.s) = w.best""",
)
def quantize_onsets(spark, folder):
    found = R.quantize(points(spark, folder), ["user_id", "day"], "x", "event_id", "origin", "end", 32)
    return found.select("user_id", "day", "event_id", "onset")


# Bars of up to four items and three 32nds; a fifth of the orders print no rhythm.
CHOICE_SQL = f"""i as (select *, item // 4 as bar, case when l_partkey % 10 > 0 and l_orderkey % 5 > 0 then (1 + l_suppkey % 2) * 3 end as n3 from ({ITEMS_SQL})),
    s as (select l_orderkey, bar, sum(n3) = 9 and count(*) = count(n3) as exact, count(*) = 1 and count(n3) = 0 and bool_or(l_suppkey % 2 = 0) as lone, count(*) > 3 as many from i group by 1, 2),
    c as (select i.l_orderkey, i.bar, item, cast(case when exact then n3 when lone then 9 when many then 3 else units * 3 end as int) as len3, not coalesce(exact, false) and not lone as estimated,
      not coalesce(exact, false) and not lone and many as crowded from i join s on s.l_orderkey = i.l_orderkey and s.bar = i.bar)"""


def rhythm_choices(spark, folder):
    rows = items(spark, folder).selectExpr(
        "l_orderkey", "item", "item div 4 as bar", "units", "l_suppkey % 2 = 0 as bare", "cast(if(l_partkey % 10 > 0 and l_orderkey % 5 > 0, (1 + l_suppkey % 2) * 3, null) as int) as n3"
    )
    found = R.choose_rhythm(rows, ["l_orderkey", "bar"], "item", "n3", "units", 3, F.col("bare"))
    return found.select("l_orderkey", "bar", "item", F.col("len3").cast("int").alias("len3"), F.coalesce("estimated", F.lit(True)).alias("estimated"), F.coalesce("crowded", F.lit(False)).alias("crowded"))


@query("choose_rhythm", f"with {CHOICE_SQL} select * from c")
def choose_rhythm(spark, folder):
    return rhythm_choices(spark, folder)


@query(
    "rhythm_counters",
    f"with {CHOICE_SQL}, b as (select l_orderkey, bar, bool_or(estimated) as e from c group by 1, 2) select l_orderkey, count(*) filter (not e) as notated, count(*) filter (e) as estimated from b group by 1",
)
def rhythm_counters(spark, folder):
    return R.rhythm_counters(rhythm_choices(spark, folder), ORDER, ["bar"])


PRINTED_SQL = f"""pb as (select *, bar * 2 + 1 + case when o_orderkey % 9 = 0 then 1 else 0 end as num, o_orderstatus = 'F' as empty,
  case when o_orderkey % 11 = 0 then 2 + o_orderkey % 5 end as xn from ({BARS_SQL})), pn as (select *, case when o_orderkey % 7 > 0 then num end as number from pb)"""


def printed_bars(spark, folder):
    b = bars(spark, folder).selectExpr(
        "*", "bar * 2 + 1 + if(o_orderkey % 9 = 0, 1, 0) as num", "o_orderstatus = 'F' as empty", "if(o_orderkey % 11 = 0, 2 + o_orderkey % 5, null) as xn"
    )
    return b.withColumn("number", F.when(F.col("o_orderkey") % 7 > 0, F.col("num"))).drop("num")


@query(
    "expand_rest_bars",
    f"""with {PRINTED_SQL}, n as (select *, lead(number) over (partition by o_custkey order by bar) - number as gap from pn),
    s as (select *, case when not empty then 1 when gap between 2 and 64 then gap else coalesce(xn, 1) end as span from n),
    c as (select *, unnest(range(span)) as copy from s)
    select o_custkey, bar, cast(copy as int) as copy, case when copy = 0 or empty then number + copy end as number from c""",
)
def expand_rest_bars(spark, folder):
    found = R.expand_rest_bars(printed_bars(spark, folder), CUST, "bar", "number", F.col("empty"), F.col("xn"))
    return found.select("o_custkey", "bar", "copy", "number")


@query(
    "fixed_rhythm",
    f"""with recursive {SPLIT_SQL}, p as (select *, event_id % 997 as lines from ({EVENTS_SQL})), l as (select user_id from p group by 1 having not bool_and(lines >= 10)),
    i as (select user_id, event_id as item, (row_number() over (partition by user_id order by event_id) - 1) * 4 as s, count(*) over (partition by user_id) * 4 as total from p where user_id in (select user_id from l))
    select user_id, s // 32 as bar, item, 0 as part, 4 as units, false as tie from i union all
    select user_id, total // 32, null, k, sp.part, false from (select distinct user_id, total from i) join sp on sp.u = 32 - total % 32 where total % 32 > 0""",
)
def fixed_rhythm(spark, folder):
    cols = events(spark, folder).select("user_id", "event_id", (F.col("event_id") % 997 - 8).alias("lines"))
    return R.fixed_rhythm(cols, USER, "event_id", "lines", 8, 32)


MARK_KIND = "case o_orderkey % 5 when 0 then 'signature' when 1 then 'tempo' when 2 then 'sign' when 3 then 'jump' else 'section' end"


@query(
    "bar_attributes",
    f"""with b as (select *, bar * 10.0 as start, bar * 10.0 + 10 as "end" from ({BARS_SQL}) where o_orderkey % 3 > 0),
    m as (select o_custkey, o_orderkey as mid, cast(bar * 10 + o_orderkey % 13 as double) as x, {MARK_KIND} as kind, case when o_orderkey % 4 = 0 then 'Fine' else o_orderpriority end as sval,
      cast(60 + o_orderkey % 90 as int) as ival from ({BARS_SQL})),
    e as (select *, kind = 'jump' or (kind = 'sign' and sval = 'Fine') as late from m),
    a as (select e.*, (select min(b.bar) from b where b.o_custkey = e.o_custkey and b.end > e.x - case when late then 2 else 0 end) as nb,
      (select max(b.bar) from b where b.o_custkey = e.o_custkey) as lb from e),
    p as (select *, coalesce(nb, case when late then lb end) as bar from a),
    g as (select o_custkey, bar, max_by(ival, (x, mid)) filter (kind = 'signature') as sig, max_by(ival, (x, mid)) filter (kind = 'tempo') as tempo,
      max_by(sval, (x, mid)) filter (kind = 'sign') as sign, max_by(sval, (x, mid)) filter (kind = 'jump') as jump, string_agg(sval, ' / ' order by x, mid) filter (kind = 'section') as marker from p where bar is not null group by 1, 2)
    select b.o_custkey, b.bar, tempo, sign, jump, marker, last_value(sig ignore nulls) over (partition by b.o_custkey order by b.bar) as signature from b left join g on g.o_custkey = b.o_custkey and g.bar = b.bar""",
)
def bar_attributes(spark, folder):
    every = bars(spark, folder)
    b = every.where("o_orderkey % 3 > 0").selectExpr("o_custkey", "bar", "bar * 10.0D as start", "bar * 10.0D + 10 as end")
    m = every.selectExpr(
        "o_custkey", "o_orderkey as mid", "cast(bar * 10 + o_orderkey % 13 as double) as x", f"{MARK_KIND} as kind",
        "if(o_orderkey % 4 = 0, 'Fine', o_orderpriority) as sval", "cast(60 + o_orderkey % 90 as int) as ival",
    )
    found = R.bar_attributes(b, m, CUST, "bar", 2.0)
    return found.select("o_custkey", "bar", "tempo", "sign", "jump", "marker", "signature")


@query(
    "fill_ties",
    """with c as (select conv_id, turn, length(text) % 5 = 0 as rest, length(text) % 5 in (1, 2) as tied, cast(length(text) as varchar) as notes from conversations),
    k as (select *, case when not tied then case when rest then '-' else notes end end as s from c),
    f as (select *, last_value(s ignore nulls) over (partition by conv_id order by turn) as b from k)
    select conv_id, turn, case when tied then nullif(b, '-') else notes end as sounding from f""",
)
def fill_ties(spark, folder):
    n = F.length("text")
    beats = table(spark, folder, "conversations").withColumn("notes", n.cast("string"))
    return R.fill_ties(beats, ["conv_id"], "turn", (n % 5).isin(1, 2), n % 5 == 0, "notes").select("conv_id", "turn", "sounding")


NOTES_SQL = f"""select l_orderkey, cast(l_suppkey % 3 as int) as string, item, cast(l_partkey % 4 as int) as fret, units % 2 = 0 as paren, l_partkey % 7 = 0 as dead,
  case units % 5 when 0 then true when 1 then false end as arc, case l_partkey % 6 when 0 then 'h' when 1 then 'p' when 2 then 'sl' when 3 then '/' end as link,
  units % 3 = 0 as tie, cast(case when l_partkey % 3 = 0 then 2 else 0 end as int) as bend, units % 7 = 0 as released from ({ITEMS_SQL})"""


def string_notes(spark, folder):
    return items(spark, folder).selectExpr(
        "l_orderkey", "cast(l_suppkey % 3 as int) as string", "item", "cast(l_partkey % 4 as int) as fret", "units % 2 = 0 as paren",
        "l_partkey % 7 = 0 as dead", "case units % 5 when 0 then true when 1 then false end as arc",
        "case l_partkey % 6 when 0 then 'h' when 1 then 'p' when 2 then 'sl' when 3 then '/' end as link",
        "units % 3 = 0 as tie", "cast(if(l_partkey % 3 = 0, 2, 0) as int) as bend", "units % 7 = 0 as released",
    )


@query(
    "resolve_links",
    f"""with n as ({NOTES_SQL}), w as (select *, lag(item) over s as pi, lag(fret) over s as pf, lag(dead) over s as pd, lead(link) over s as nl from n window s as (partition by l_orderkey, string order by item)),
    t as (select *, paren and coalesce(pi is not null and not pd and pf = fret and pi = item - 1, false) and coalesce(arc, true) as tied from w)
    select l_orderkey, string, item, tied as tie, paren and not tied as ghost, case when not dead then case when nl in ('h', 'p') then 'hammer' when nl = 'sl' then 'shift' when nl is not null then 'slide' end end as starts from t""",
)
def resolve_links(spark, folder):
    found = R.resolve_links(string_notes(spark, folder).drop("tie"), ["l_orderkey", "string"], "item", "fret", "paren", "arc", "link", "dead")
    return found.select("l_orderkey", "string", "item", "tie", "ghost", "starts")


@query(
    "hold_bends",
    f"""with recursive n as (select *, row_number() over (partition by l_orderkey, string order by item) as rn from ({NOTES_SQL})),
    f(l_orderkey, string, item, rn, held, pre, cur, rel) as (select l_orderkey, string, item, rn, bend, false, bend, released from n where rn = 1 union all
      select n.l_orderkey, n.string, n.item, n.rn,
        case when n.tie and f.cur > 0 and not f.rel and n.bend = 0 then f.cur else n.bend end,
        n.tie and f.cur > 0 and ((n.bend = 0 and not f.rel) or n.bend > 0),
        case when n.tie and n.bend = 0 then case when f.rel then 0 else f.cur end else n.bend end, n.released
      from f join n on n.l_orderkey = f.l_orderkey and n.string = f.string and n.rn = f.rn + 1)
    select l_orderkey, string, item, held as held_bend, pre as pre_bend from f""",
)
def hold_bends(spark, folder):
    found = R.hold_bends(string_notes(spark, folder), ["l_orderkey", "string"], "item", "tie", "bend", "released")
    return found.select("l_orderkey", "string", "item", "held_bend", "pre_bend")


@query(
    "carry_state",
    f"""with e as ({EVENTS_SQL}), n as (select * from e where event_type = 'click'), m as (select * from e where event_type = 'view'),
    j as (select n.event_id, max_by(m.value, (m.sec, m.event_id)) as state from n join m on m.user_id = n.user_id and m.sec <= n.sec + 600 group by 1)
    select n.event_id, state from n left join j using (event_id)""",
)
def carry_state(spark, folder):
    e = events(spark, folder)
    found = R.carry_forward(
        e.where("event_type = 'click'"), e.where("event_type = 'view'"), USER, F.col("sec"), "event_id", F.col("sec"), "event_id", "value", 600.0
    )
    return found.select("event_id", "state")


@query("ramps")
def ramps(spark, folder):
    e = events(spark, folder).withColumn("x", F.col("sec") / 3600)
    notes = e.where("event_type = 'click'").select("user_id", F.col("event_id").alias("nid"), "x")
    pins = e.where("event_type = 'view'").selectExpr("user_id", "event_id as pid", "x as x0", "x + 6.0D as x1", "if(value > 20, 1, -1) as direction")
    marks = e.where("event_type = 'error'").selectExpr("user_id", "event_id as mid", "x", "cast(15 + 16 * (event_id % 8) as int) as value")
    return R.ramps(notes, pins, marks, USER, 0.5, 6.0).select("user_id", "nid", "level")


@query(
    "fit_bar",
    f"""with recursive {SPLIT_SQL}, i as (select *, item // 4 as bar from ({ITEMS_SQL})), r as (select *, sum(units) over (partition by l_orderkey, bar order by item) as e from i),
    t as (select l_orderkey, bar, sum(units) as total from i group by 1, 2 having sum(units) < 96)
    select l_orderkey, bar, item as beat, 0 as part, units, false as cut from r where e <= 96 union all
    select l_orderkey, bar, case when k = 0 then item end, k, sp.part, true from r join sp on sp.u = 96 - (e - units) where e > 96 and e - units < 96 union all
    select l_orderkey, bar, null, k, sp.part, false from t join sp on sp.u = 96 - total""",
)
def fit_bar(spark, folder):
    rows = items(spark, folder).withColumn("bar", F.expr("item div 4"))
    return R.fit_bar(rows, ["l_orderkey", "bar"], "item", "units", 96)


@query(
    "align_numbers",
    f"""with b as (select o_custkey, o_orderkey, bar, bar + 1, case when o_orderkey % 13 > 0 then bar + 1 + case when bar >= 4 then o_custkey % 3 else 0 end + case when o_custkey % 10 = 0 and o_orderkey % 4 = 0 then -2 else 0 end end as num from ({BARS_SQL})),
    r as (select *, row_number() over (partition by o_custkey order by bar) as i, count(*) over (partition by o_custkey) as n, count(num) over (partition by o_custkey) as known, max(num) over (partition by o_custkey) as mx from b),
    f as (select *, i + coalesce(last_value(num - i ignore nulls) over (partition by o_custkey order by i), 0) as place from r),
    s as (select *, place - coalesce(lag(place) over (partition by o_custkey order by i), 0) as step from f),
    k as (select *, coalesce(known >= 0.8 * n and mx <= 2 * n + 64 and min(step) over (partition by o_custkey) > 0, false) as ok from s)
    select o_custkey, bar, case when ok then place else i end as position from k union all
    select o_custkey, null, unnest(range(place - step + 1, place)) from k where ok and step > 1""",
)
def align_numbers(spark, folder):
    num = "if(o_orderkey % 13 > 0, bar + 1 + if(bar >= 4, o_custkey % 3, 0) + if(o_custkey % 10 = 0 and o_orderkey % 4 = 0, -2, 0), null) as num"
    return R.align_by_number(bars(spark, folder).selectExpr("o_custkey", "bar", num), CUST, "bar", "num")


TRACKS_SQL = f"""select l_orderkey, cast(l_suppkey % 3 as int) as track, item, units, l_partkey, row_number() over (partition by l_orderkey, l_suppkey % 3 order by item) - 1 as bar from ({ITEMS_SQL})"""


def track_line(spark, folder):
    """Bars of tracks, and the lines they come from."""
    from ..functions.ordered import number, ordered

    line = item_line(spark, folder)
    rows = line.df.withColumn("track", (F.col("l_suppkey") % 3).cast("int"))
    numbered = ordered(rows, ["l_orderkey", "track"], ["item"], like=line).add(bar=number()).df
    return numbered.select("l_orderkey", "track", "item", "units", "l_partkey", (F.col("bar") - 1).alias("bar")), line


def track_bars(spark, folder):
    return track_line(spark, folder)[0]


@query(
    "pad_tracks",
    f"""with t as ({TRACKS_SQL}), e as (select l_orderkey, track, max(bar) as last from t group by 1, 2), m as (select *, max(last) over (partition by l_orderkey) as al from e)
    select l_orderkey, track, unnest(range(last + 1, al + 1)) as bar from m""",
)
def pad_tracks(spark, folder):
    return R.pad_tracks(track_bars(spark, folder), ORDER, "track", "bar")


UNIFY = """l_orderkey, bar, track, {c}(l_partkey % 4 = 0, 3 + units % 3, null) as signature, l_partkey % 9 = 0 as repeat_open, cast(l_partkey % 3 as int) as repeat_times,
  {c}(l_partkey % 8 = 1, '1', null) as endings, {c}(l_partkey % 10 < 2, 60 + units, null) as tempo, {c}(l_partkey % 12 = 5, 'Segno', null) as sign, {c}(l_partkey % 12 = 7, 'Da Capo', null) as jump"""
UNIFY_SQL = f"""t as (select {UNIFY.format(c="if")} from ({TRACKS_SQL})), ub0 as (select l_orderkey, bar, min_by(signature, track) filter (signature is not null) as sg, bool_or(repeat_open) as repeat_open, max(repeat_times) as repeat_times,
    min_by(endings, track) filter (endings is not null) as endings, min_by(tempo, track) filter (tempo is not null) as tempo, min_by(sign, track) filter (sign is not null) as sign, min_by(jump, track) filter (jump is not null) as jump from t group by 1, 2),
  ub as (select * exclude (sg), last_value(sg ignore nulls) over (partition by l_orderkey order by bar) as signature from ub0)"""


def unified(spark, folder):
    import re

    exprs = [e.strip() for e in re.split(r",\s*(?![^(]*\))", UNIFY.format(c="if"))]
    tracks, line = track_line(spark, folder)
    return R.unify_bars(tracks.selectExpr(*exprs), ORDER, "bar", "track", like=line), line


@query("unify_bars", f"with {UNIFY_SQL} select * from ub")
def unify_bars(spark, folder):
    return unified(spark, folder)[0]


@query(
    "tidy_navigation",
    f"""with {UNIFY_SQL}, v as (select *, coalesce(last_value(tempo ignore nulls) over (partition by l_orderkey order by bar rows between unbounded preceding and 1 preceding), 120) as bf from ub),
    m as (select l_orderkey, bar, 0 as rk, sign as nm from ub where sign is not null union all select l_orderkey, bar, 1, jump from ub where jump is not null),
    f as (select *, row_number() over (partition by l_orderkey, nm order by bar, rk) as rn from m)
    select v.l_orderkey, v.bar, case when tempo <> bf then tempo end as tempo_change, a.nm as kept_sign, b.nm as kept_jump from v
      left join f a on a.l_orderkey = v.l_orderkey and a.bar = v.bar and a.rk = 0 and a.rn = 1 left join f b on b.l_orderkey = v.l_orderkey and b.bar = v.bar and b.rk = 1 and b.rn = 1""",
)
def tidy_navigation(spark, folder):
    bars, line = unified(spark, folder)
    kept, _ = R.tidy_navigation(bars, ORDER, "bar", "tempo", "sign", "jump", F.lit(120), like=line)
    return kept.select("l_orderkey", "bar", "tempo_change", "kept_sign", "kept_jump")


@query(
    "drop_opening",
    f"""with e as ({EVENTS_SQL}), f as (select *, row_number() over (partition by user_id, event_type order by us, event_id) as rn from e)
    select user_id, event_id from f where not (event_type = 'view' and rn = 1)""",
)
def drop_opening(spark, folder):
    left = R.drop_opening(events(spark, folder), USER, ["us", "event_id"], F.col("event_type") == "view")
    return left.select("user_id", "event_id")
