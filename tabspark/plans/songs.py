"""Queries of the structure, lyrics, note and quality operators: one order is a song, its lines are bars or beats."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.ordered import Ordered, number, ordered
from ..operators import lyrics as Y
from ..operators import notes as N
from ..operators import quality as Q
from ..operators import structure as P
from .registry import query
from .rhythm import CUST, ORDER, TRACKS_SQL, USER, track_bars
from .tables import BARS_SQL, EVENTS_SQL, ITEMS_SQL, bars, events, item_line, items, table

# Bars of a song with plain repeats: some songs nest them, so both paths are used.
SONG_EXPRS = (
    "l_orderkey", "item as bar", "l_partkey % 5 = 0 as repeat_open", "cast({c}(l_suppkey % 4 = 0, 2 + units % 2, 0) as int) as repeat_times",
    "3 + units % 2 as num", "4 as den", "{c}(l_partkey % 7 = 0, 60 + units, null) as tempo", "{c}(units % 5 = 0, concat('part ', l_partkey % 4), null) as name",
)
SONG_COLUMNS = ["l_orderkey", "bar", "repeat_open", "repeat_times", "num", "den", "tempo", "name", "endings", "sign", "jump"]
SONG_SQL = f"select {', '.join(SONG_EXPRS).format(c='if')} from ({ITEMS_SQL})"


def song_line(spark, folder, line=None):
    line = line or item_line(spark, folder)
    rows = line.df.selectExpr(*[e.format(c="if") for e in SONG_EXPRS])
    rows = rows.withColumns(
        {"endings": F.lit(None).cast("array<int>"), "sign": F.lit(None).cast("string"), "jump": F.lit(None).cast("string")}
    )
    return Ordered(rows, line.keys, ["bar"], line.cuts)


def song_bars(spark, folder):
    return song_line(spark, folder).df


FLAT_SQL = f"""s as ({SONG_SQL}), ev as (select *, case when repeat_times > 1 then 'c' when repeat_open then 'o' end as ev from s),
  la as (select *, last_value(ev ignore nulls) over (partition by l_orderkey order by bar rows between unbounded preceding and 1 preceding) as le from ev),
  fl as (select l_orderkey from la group by 1 having bool_and(not (repeat_open and coalesce(le = 'o', false)) and not (repeat_times > 1 and not repeat_open and coalesce(le = 'c', false)))),
  fb as (select s.* from s join fl using (l_orderkey)),
  po(l_orderkey, play_idx, bar, start, lap) as (select l_orderkey, 0, bar, bar, 0 from fb where bar = 0 union all
    select po.l_orderkey, po.play_idx + 1, n.bar, case when n.repeat_open then n.bar else po.start end,
      case when c.repeat_times > 1 and po.lap < c.repeat_times - 1 then po.lap + 1 when c.repeat_times > 1 or (n.repeat_open and n.bar <> po.start) then 0 else po.lap end
    from po join fb c on c.l_orderkey = po.l_orderkey and c.bar = po.bar
      join fb n on n.l_orderkey = po.l_orderkey and n.bar = case when c.repeat_times > 1 and po.lap < c.repeat_times - 1 then po.start else po.bar + 1 end)"""


def flat_parts(spark, folder, line=None):
    """Songs whose repeats lie side by side (the SQL walks them bar by bar), with their parts."""
    b = song_line(spark, folder, line)
    return P.repeat_parts(b.df, ORDER, like=b).map(lambda d: d.where("_walked = 0"))


def flat_bars(spark, folder):
    return flat_parts(spark, folder).df.select(*SONG_COLUMNS)


# All songs, bar by bar: a list of the bars that open repeats go back to, and of the repeat ends that sent back, once for each time.
PLAY_SQL = f"""s as (select l_orderkey, bar, coalesce(repeat_open, false) as opens, coalesce(repeat_times, 0) as times from ({SONG_SQL})),
  po(l_orderkey, play_idx, bar, starts, sent) as (select l_orderkey, 0::bigint, bar, [bar], [bar][:0] from s where bar = 0 union all
    select n.l_orderkey, play_idx + 1, n.bar, case when n.opens and n.bar <> kept[-1] then list_append(kept, n.bar) else kept end, sent
    from (select l_orderkey, play_idx, case when again then starts[-1] else bar + 1 end as next,
        case when times > 1 and not again and len(starts) > 1 then starts[:-2] else starts end as kept,
        case when again then list_append(sent, bar) when times > 1 then list_filter(sent, lambda b: b <> bar) else sent end as sent
      from (select po.*, times, times > 1 and len(list_filter(sent, lambda b: b = po.bar)) < times - 1 as again
        from po join s c on c.l_orderkey is not distinct from po.l_orderkey and c.bar = po.bar)) p
      join s n on n.l_orderkey is not distinct from p.l_orderkey and n.bar = p.next)"""


@query("playback_flat", f"with recursive {PLAY_SQL} select l_orderkey, play_idx, bar from po")
def playback_flat(spark, folder):
    """All songs, nested repeats too, to their end."""
    b = song_line(spark, folder).with_columns(repeat_open=F.coalesce("repeat_open", F.lit(False)))
    order = P.playback_order(b.df, ORDER, limit=None, parts=P.repeat_parts(b.df, ORDER, like=b))
    return order.select("l_orderkey", "play_idx", "bar")


@query("playback_order")
def playback_order(spark, folder):
    b = items(spark, folder).selectExpr(
        "l_orderkey", "item as bar", "l_partkey % 5 = 0 as repeat_open", "cast(if(l_suppkey % 4 = 0, 2 + units % 2, 0) as int) as repeat_times",
        "if(l_partkey % 11 = 3, array(1 + units % 2), cast(null as array<int>)) as endings",
        "case l_partkey % 17 when 0 then 'Segno' when 1 then 'Coda' when 2 then 'Fine' end as sign",
        "case l_suppkey % 19 when 0 then 'Da Capo al Fine' when 1 then 'Da Segno al Coda' when 2 then 'Da Coda' when 3 then 'Da Capo' end as jump",
    )
    return P.playback_order(b, ORDER)


@query(
    "last_endings",
    f"""with b as (select l_orderkey, item as bar, l_partkey % 3 < 2 as volta, 1 + units % 3 as pass from ({ITEMS_SQL})),
    r as (select *, bar - row_number() over (partition by l_orderkey, volta order by bar) as run from b)
    select l_orderkey, bar, case when volta then max(pass) over (partition by l_orderkey, volta, run) else 0 end as last_ending from r""",
)
def last_endings(spark, folder):
    b = items(spark, folder).selectExpr("l_orderkey", "item as bar", "if(l_partkey % 3 < 2, array(1 + units % 3), cast(null as array<int>)) as endings")
    return P.last_endings(b, ORDER, "bar", "endings").select("l_orderkey", "bar", "last_ending")


def flat_order(spark, folder, line=None):
    """Bars, their playing order, and what is known of large songs."""
    parts = flat_parts(spark, folder, line)
    b = parts.df.select(*SONG_COLUMNS)
    return b, P.playback_order(b, ORDER, parts=parts).select("l_orderkey", "play_idx", "bar"), parts


@query(
    "unroll",
    f"""with recursive {FLAT_SQL}, f as (select *, coalesce(last_value(tempo ignore nulls) over (partition by l_orderkey order by bar), 120) as force from fb),
    j as (select po.l_orderkey, po.play_idx, po.bar, tempo, force, lag(force) over (partition by po.l_orderkey order by play_idx) as pv from po join f on f.l_orderkey = po.l_orderkey and f.bar = po.bar)
    select l_orderkey, cast(play_idx as bigint) as play_idx, bar, case when play_idx = 0 then tempo when force <> pv then force end as tempo from j""",
)
def unroll(spark, folder):
    b, order, line = flat_order(spark, folder)
    return P.unrolled_tempo(order, b, ORDER, "tempo", F.lit(120), like=line)


@query(
    "unroll_notes",
    f"""with recursive {FLAT_SQL} select po.l_orderkey, cast(play_idx as bigint) as play_idx, i.item, i.l_partkey % 25 as fret from po join ({ITEMS_SQL}) i on i.l_orderkey = po.l_orderkey and i.item = po.bar""",
)
def unroll_notes(spark, folder):
    line = item_line(spark, folder)
    _, order, _ = flat_order(spark, folder, line)
    notes = line.df.selectExpr("l_orderkey", "item", "l_partkey % 25 as fret")
    return P.unroll(notes, order, ORDER, "item").select("l_orderkey", "play_idx", "item", "fret")


@query("play_counts", f"with recursive {FLAT_SQL} select fb.l_orderkey, fb.bar, count(po.play_idx) as plays from fb left join po on po.l_orderkey = fb.l_orderkey and po.bar = fb.bar group by 1, 2")
def play_counts(spark, folder):
    b, order, _ = flat_order(spark, folder)
    return P.play_counts(b, order, ORDER).select("l_orderkey", "bar", "plays")


MAP_SQL = f"""{FLAT_SQL}, tm0 as (select po.l_orderkey, play_idx, po.bar, 3840 * num / den as len, coalesce(last_value(tempo ignore nulls) over (partition by po.l_orderkey order by play_idx), 120)::double as tempo
    from po join fb on fb.l_orderkey = po.l_orderkey and fb.bar = po.bar),
  tm as (select l_orderkey, play_idx, bar, tempo, cast(coalesce(sum(len) over w, 0) as bigint) as tick, coalesce(sum(len / 960 * 60000 / tempo) over w, 0.0) as ms from tm0
    window w as (partition by l_orderkey order by play_idx rows between unbounded preceding and 1 preceding))"""


def tempo_table(spark, folder):
    b, order, line = flat_order(spark, folder)
    return P.tempo_map(order, b, ORDER, "num", "den", "tempo", F.lit(120), like=line)


@query("tempo_map", f"with recursive {MAP_SQL} select l_orderkey, cast(play_idx as bigint) as play_idx, bar, tick, round(ms, 4) as ms, tempo from tm")
def tempo_map(spark, folder):
    return tempo_table(spark, folder).withColumn("ms", F.round("ms", 4))


@query(
    "to_ms",
    f"""with recursive {MAP_SQL}, p as (select l_orderkey, item, item * 1000 - 500 as tick from ({ITEMS_SQL}) where l_orderkey in (select l_orderkey from fl)),
    j as (select p.*, (select max_by(tm, tm.tick) from tm where tm.l_orderkey = p.l_orderkey and tm.tick <= p.tick) as a, (select min_by(tm, tm.play_idx) from tm where tm.l_orderkey = p.l_orderkey) as b from p)
    select l_orderkey, item, round(coalesce(a, b).ms + (tick - coalesce(a, b).tick) * 60000 / (coalesce(a, b).tempo * 960), 4) as at_ms from j""",
)
def to_ms(spark, folder):
    tempos = tempo_table(spark, folder)
    points = items(spark, folder).selectExpr("l_orderkey", "item", "cast(item * 1000 - 500 as double) as tick")
    points = points.join(flat_bars(spark, folder).select("l_orderkey").distinct(), "l_orderkey", "left_semi")
    found = P.to_ms(points, tempos, ORDER, "tick", "item")
    return found.select("l_orderkey", "item", F.round("at_ms", 4).alias("at_ms"))


@query(
    "to_tick",
    f"""with recursive {MAP_SQL}, p as (select l_orderkey, item, item * 1100.0::double - 500 as ms from ({ITEMS_SQL}) where l_orderkey in (select l_orderkey from fl)),
    j as (select p.*, (select max_by(tm, tm.play_idx) from tm where tm.l_orderkey = p.l_orderkey and tm.ms <= p.ms) as a, (select min_by(tm, tm.play_idx) from tm where tm.l_orderkey = p.l_orderkey) as b from p)
    select l_orderkey, item, round(coalesce(a, b).tick + (ms - coalesce(a, b).ms) * coalesce(a, b).tempo * 960 / 60000, 3) as at_tick from j""",
)
def to_tick(spark, folder):
    tempos = tempo_table(spark, folder)
    points = items(spark, folder).selectExpr("l_orderkey", "item", "cast(item * 1100 - 500 as double) as ms")
    points = points.join(flat_bars(spark, folder).select("l_orderkey").distinct(), "l_orderkey", "left_semi")
    found = P.to_tick(points, tempos, ORDER, "ms", "item")
    return found.select("l_orderkey", "item", F.round("at_tick", 3).alias("at_tick"))


@query(
    "media_time",
    f"""with e as ({EVENTS_SQL}), s as (select user_id, (user_id % 50 - 25)::double as o, (case user_id % 3 when 0 then 0.5 when 1 then 1 else 2 end)::double as f, case when user_id % 3 > 0 then max(value) end as d from e group by 1)
    select event_id, round(case when d is not null then least(greatest(o + value * 1000 / 1000 / f, 0), d) else greatest(o + value * 1000 / 1000 / f, 0) end, 4) as media_s from e join s using (user_id)""",
)
def media_time(spark, folder):
    e = events(spark, folder)
    settings = e.groupBy("user_id").agg(F.max("value").alias("mx")).selectExpr(
        "user_id", "cast(user_id % 50 - 25 as double) as offset", "case user_id % 3 when 0 then 0.5D when 1 then 1D else 2D end as tempo_factor",
        "if(user_id % 3 > 0, mx, null) as duration",
    )
    found = P.media_time(e.withColumn("ms", F.col("value") * 1000), settings, USER, "ms")
    return found.select("event_id", F.round("media_s", 4).alias("media_s"))


@query(
    "sections",
    f"""with s as ({SONG_SQL}), g as (select *, sum(case when bar = 0 or name is not null then 1 else 0 end) over (partition by l_orderkey order by bar) as section from s)
    select l_orderkey, cast(section as bigint) as section, coalesce(max(name), 'start') as name, min(bar) as start, max(bar) + 1 as "end" from g group by 1, 2""",
)
def sections(spark, folder):
    b = song_bars(spark, folder).withColumns({"start": F.col("bar"), "end": F.col("bar") + 1})
    return P.sections(b, ORDER, "bar", "name", "start", "end")


@query(
    "runs",
    f"""with n as (select distinct o_custkey, bar from ({BARS_SQL}) where o_orderstatus <> 'F'), r as (select *, bar - row_number() over (partition by o_custkey order by bar) as g from n),
    x as (select o_custkey, min(bar) as first, max(bar) as last, count(*) as n from r group by o_custkey, g)
    select o_custkey, row_number() over (partition by o_custkey order by first) as run, first, last, n, case when n > 1 then first || '–' || last else '' || first end as label from x""",
)
def runs(spark, folder):
    return P.runs(bars(spark, folder).where("o_orderstatus <> 'F'"), CUST, "bar")


@query(
    "review_bars",
    f"""with recursive {FLAT_SQL}, pc as (select l_orderkey, bar, count(*) as plays from po group by 1, 2), e as (select *, num = 3 as est from fb),
    k as (select l_orderkey from e group by 1 having bool_or(not est)) select e.l_orderkey, e.bar, plays, plays <> 1 as says_passes from e join k using (l_orderkey) join pc on pc.l_orderkey = e.l_orderkey and pc.bar = e.bar where est""",
)
def review_bars(spark, folder):
    b, order, _ = flat_order(spark, folder)
    b = b.withColumn("est", F.col("num") == 3)
    plays = P.play_counts(b, order, ORDER).select("l_orderkey", "bar", "plays")
    return P.review_bars(b, plays, ORDER, "est").select("l_orderkey", "bar", "plays", "says_passes")


# --- Lyrics ---
@query(
    "place_lyrics",
    f"""with e as ({EVENTS_SQL}), b as (select *, row_number() over w as bar, value as start, lead(value) over w as "end" from e where event_type = 'purchase' window w as (partition by user_id order by value, event_id)),
    m as (select * from e where event_type = 'view'), f as (select user_id, min_by(b, b.bar) as b from b where b.end is not null group by 1),
    j0 as (select m.event_id, m.user_id, m.value, max_by(b, b.bar) as b from m left join b on b.user_id = m.user_id and b.start <= m.value and b.end is not null group by 1, 2, 3),
    j as (select event_id, value, case when j0.b is null then f.b else j0.b end as b from j0 left join f using (user_id))
    select event_id, b.bar as bar, round(case when b.end > b.start then least(greatest((value - b.start) / (b.end - b.start), 0), 1) else 0 end, 6) as place from j""",
)
def place_lyrics(spark, folder):
    from ..functions.ordered import lead

    e = events(spark, folder)
    b = ordered(e.where("event_type = 'purchase'").select("user_id", "value", "event_id"), USER, ["value", "event_id"])
    b = b.add(bar=number(), end=lead("value")).df.where(F.col("end").isNotNull()).select("user_id", "bar", F.col("value").alias("start"), "end")
    found = Y.place_lyrics(e.where("event_type = 'view'").select("user_id", "event_id", "value"), b, USER, "value", "event_id", "bar")
    return found.select("event_id", "bar", F.round("place", 6).alias("place"))


@query(
    "pick_carrier",
    f"""with t as ({TRACKS_SQL}), l as (select * from t where l_partkey % 4 = 0), n as (select l_orderkey, track, count(*) as n from l group by 1, 2),
    s as (select l_orderkey, max_by(track, (n, -track)) as source from n group by 1), w as (select l.l_orderkey, l.bar, count(*) as w from l join s on s.l_orderkey = l.l_orderkey and s.source = l.track group by 1, 2),
    p as (select l_orderkey, track, bar, count(*) as k from t where units % 3 > 0 group by 1, 2, 3), nn as (select l_orderkey, track, sum(k) as notes from p group by 1, 2),
    c as (select p.l_orderkey, p.track, sum(w) as cover from p join w on w.l_orderkey = p.l_orderkey and w.bar = p.bar group by 1, 2),
    b as (select nn.l_orderkey, max_by(nn.track, (coalesce(cover, 0), notes, -nn.track)) as carrier from nn left join c on c.l_orderkey = nn.l_orderkey and c.track = nn.track group by 1)
    select s.l_orderkey, source, carrier from s left join b using (l_orderkey)""",
)
def pick_carrier(spark, folder):
    t = track_bars(spark, folder)
    return Y.pick_carrier(t.where("l_partkey % 4 = 0"), t, ORDER, "track", "bar", F.col("units") % 3 == 0)


def lyric_parts(spark, folder):
    line = item_line(spark, folder)
    base = line.df
    s = base.where("l_partkey % 2 = 0").selectExpr("l_orderkey", "item", "item div 3 as bar", "(item % 3) / 3.0D as place", "units % 4 = 0 as joins")
    b = base.where("l_suppkey % 3 > 0").selectExpr("l_orderkey", "item div 3 as bar", "(item % 3) / 3.0D as place")
    return s, b, line


@query(
    "assign_lyrics",
    f"""with recursive s0 as (select l_orderkey, item, item // 3 as bar, (item % 3) / 3.0::double as place, units % 4 = 0 as joins from ({ITEMS_SQL}) where l_partkey % 2 = 0),
    b as (select l_orderkey, item // 3 as bar, (item % 3) / 3.0::double as place, row_number() over (partition by l_orderkey order by item) - 1 as i, count(*) over (partition by l_orderkey) - 1 as last from ({ITEMS_SQL}) where l_suppkey % 3 > 0),
    n as (select s0.l_orderkey, s0.item, min_by(i, (abs(b.place - s0.place), i)) as near from s0 join b on b.l_orderkey = s0.l_orderkey and b.bar = s0.bar group by 1, 2),
    s as (select s0.*, near, (select any_value(last) from b where b.l_orderkey = s0.l_orderkey) as last, row_number() over (partition by l_orderkey order by item) as k from s0 left join n using (l_orderkey, item)),
    w(l_orderkey, item, bar, joins, beat, k, prev, word) as (
      select l_orderkey, -1::bigint, 0::bigint, false, null::bigint, 0::bigint, -1::bigint, false from s where k = 1 and last is not null
      union all select s.l_orderkey, s.item, s.bar, s.joins, x.beat, s.k, coalesce(x.beat, w.prev), case when x.beat is null then w.word else s.joins end
      from w join s on s.l_orderkey = w.l_orderkey and s.k = w.k + 1,
      lateral (select case when s.near is null and not w.word then null when w.word then least(w.prev + 1, s.last) else greatest(s.near, w.prev) end as beat) x)
    select l_orderkey, item, bar, joins, beat from w where k > 0""",
)
def assign_lyrics(spark, folder):
    s, b, line = lyric_parts(spark, folder)
    return Y.assign_lyrics(s, b, ORDER, "item", like=line)


@query(
    "syllable_track",
    f"""with i as (select l_orderkey, item // 5 as bar, item, (item % 5) / 5.0::double as place from ({ITEMS_SQL})),
    n as (select *, row_number() over w as i, count(*) over (partition by l_orderkey, bar) as n from i window w as (partition by l_orderkey, bar order by place, item)),
    g as (select *, case when n <= 2 then 2 else 1 end as g from n), q as (select *, least(4 - g, round_even(place * 4 / g, 0) * g) as q from g),
    o as (select *, cast(max(q - i * g) over (partition by l_orderkey, bar order by i) + i * g as int) as onset from q),
    t as (select *, max(onset) filter (onset < 4) over (partition by l_orderkey, bar) as top, lead(onset) over (partition by l_orderkey, bar order by i) as nx from o),
    z as (select l_orderkey, bar, item, least(onset, top) as onset, case when onset < top then nx else 4 end - least(onset, top) as rest from t)
    select l_orderkey, bar, item, onset, case when rest >= 4 then 4 when rest >= 3 then 3 when rest >= 2 then 2 else 1 end as length from z""",
)
def syllable_track(spark, folder):
    s = items(spark, folder).selectExpr("l_orderkey", "item div 5 as bar", "item", "(item % 5) / 5.0D as place")
    return Y.syllable_track(s, ["l_orderkey", "bar"], ["place", "item"], "place", 4).select("l_orderkey", "bar", "item", "onset", "length")


@query(
    "lyric_line",
    """with c as (select conv_id, turn, length(text) % 3 = 0 as joins, turn // 2 * 2 + case when length(text) % 7 = 0 then 1 else 0 end as beat, regexp_replace(substr(text, 1, 4), '[\\s\\[\\]+-]', '', 'g') as t from conversations),
    m as (select *, max(beat) over (partition by conv_id order by turn) as b2 from c),
    w as (select *, lag(b2) over v as pb, lag(joins) over v as pj from m window v as (partition by conv_id order by turn))
    select conv_id, turn, case when pb is null then '' when b2 = pb then case when pj then '' else '+' end when pj then repeat(' ', cast(b2 - pb - 1 as int)) else repeat(' ', cast(b2 - pb as int)) end || t || case when joins then '-' else '' end as piece from w""",
)
def lyric_line(spark, folder):
    from ..functions.ordered import running_max

    n = F.length("text")
    c = table(spark, folder, "conversations").withColumns(
        {"joins": n % 3 == 0, "beat": F.expr("turn div 2") * 2 + F.when(n % 7 == 0, 1).otherwise(0), "t": F.substring("text", 1, 4)}
    )
    c = ordered(c, ["conv_id"], ["turn"]).add(b=running_max("beat")).df
    return Y.lyric_line(c, ["conv_id"], "turn", "t", "joins", "b").select("conv_id", "turn", "piece")


# --- Notes ---
@query(
    "sounding_notes",
    f"""with i as (select l_orderkey, cast(l_suppkey % 3 as int) as string, item, units % 3 = 0 as tie, l_partkey % 9 as fret, units, case l_partkey % 4 when 0 then 'h' when 1 then 'p' end as link from ({ITEMS_SQL})),
    w as (select *, lag(fret) over v as pf, lag(link) over v as pl, sum(case when tie then 0 else 1 end) over v as chain from i window v as (partition by l_orderkey, string order by item))
    select l_orderkey, string, chain::bigint as chain, min(item) as item, min_by(fret, item) as fret, min_by(case when pl in ('h', 'p') then case when fret >= pf then 'H' else 'P' end else '' end, item) as legato, sum(units)::bigint as sustain from w where chain > 0 group by 1, 2, 3""",
)
def sounding_notes(spark, folder):
    n = items(spark, folder).selectExpr(
        "l_orderkey", "cast(l_suppkey % 3 as int) as string", "item", "units % 3 = 0 as tie", "l_partkey % 9 as fret", "units",
        "case l_partkey % 4 when 0 then 'h' when 1 then 'p' end as link",
    )
    return N.sounding_notes(n, ["l_orderkey", "string"], "item", "tie", "fret", "units", "link")


CHORDS = "(values " + ", ".join(f"('{s}', '{n}', {i})" for i, (n, s) in enumerate(N.CHORD_TYPES.items())) + ") as ct(shape, nm, rk)"
NAMES = "['" + "', '".join(N.NOTE_NAMES) + "']"


@query(
    "chord_names",
    f"""with n as (select l_orderkey, item // 3 as tick, cast(l_partkey as bigint) as pitch from ({ITEMS_SQL})),
    s as (select l_orderkey, tick, list(distinct pitch % 12) as pcs, min(pitch) % 12 as bass from n group by 1, 2),
    r as (select *, unnest(pcs) as root from s), k as (select *, array_to_string(list_sort(list_transform(pcs, lambda p: (p - root + 12) % 12)), ',') as shape from r),
    b as (select l_orderkey, tick, bass, min((case when root = bass then 0 else 100 end + rk, root, nm)) as b from k join {CHORDS} using (shape) group by 1, 2, 3)
    select s.l_orderkey, s.tick, case when len(pcs) >= 2 and b is not null then {NAMES}[b[2] + 1] || b[3] || case when b[2] = s.bass then '' else '/' || {NAMES}[s.bass + 1] end else '' end as name
    from s left join b on b.l_orderkey = s.l_orderkey and b.tick = s.tick""",
)
def chord_names(spark, folder):
    notes = items(spark, folder).selectExpr("l_orderkey", "item div 3 as tick", "l_partkey as pitch")
    return N.chord_names(notes, ["l_orderkey", "tick"], "pitch")


@query(
    "chord_spans",
    f"""select l_orderkey, item // 3 as tick, coalesce(max(f) - min(f) + 1, 1) as span from (select *, case when l_partkey % 9 > 0 and l_suppkey % 5 > 0 then l_partkey % 9 end as f from ({ITEMS_SQL})) group by 1, 2""",
)
def chord_spans(spark, folder):
    n = items(spark, folder).selectExpr("l_orderkey", "item div 3 as tick", "l_partkey % 9 as fret", "l_suppkey % 5 = 0 as dead")
    return N.chord_spans(n, ["l_orderkey", "tick"], "fret", F.col("dead"))


@query(
    "hand_windows",
    f"""with e as (select user_id, event_id, us // 60000000 as tick, case when event_id % 25 > 0 and event_type <> 'error' then event_id % 25 end as f from ({EVENTS_SQL})),
    w as (select e.user_id, e.event_id, e.tick, min(o.f) as lo, max(o.f) as hi from e join e o on o.user_id = e.user_id and o.tick between e.tick - 960 and e.tick + 2880 group by 1, 2, 3),
    h as (select *, case when lo is not null then (lo, case when hi - lo + 1 < 4 then least(24, lo + 3) else hi end) end as h from w),
    f as (select *, last_value(h ignore nulls) over (partition by user_id order by tick, event_id) as hf from h)
    select user_id, event_id, tick, coalesce(hf[1], 1) as low, coalesce(hf[2], 4) as high from f""",
)
def hand_windows(spark, folder):
    n = events(spark, folder).selectExpr("user_id", "event_id", "us div 60000000 as tick", "event_id % 25 as fret", "event_type = 'error' as dead")
    return N.hand_windows(n, USER, "tick", "event_id", "fret", F.col("dead"))


@query(
    "joined_slides",
    f"""with e as (select user_id, event_type, event_id, us // 1000000 as tick, event_id % 25 as fret, cast(value * 2000 as bigint) as length, case event_id % 5 when 0 then 'below' when 1 then 'above' end as slide_in,
      event_id % 7 = 0 as dead, event_id % 11 = 0 as bent, event_id % 13 = 0 as so from ({EVENTS_SQL})),
    w as (select *, lag(event_id) over v as pid, lag(tick) over v as pt, lag(fret) over v as pf, lag(length) over v as pl, lag(dead) over v as pd, lag(bent) over v as pb, lag(so) over v as ps from e window v as (partition by user_id, event_type order by tick, event_id)),
    k as (select *, least(5000.0, (tick - pt) / 2) as run from w where slide_in is not null and not pd and pf > 0 and not pb and not ps and pt < tick and case when slide_in = 'below' then pf < fret else pf > fret end and pl >= 1000 and pt + pl >= tick - 480)
    select user_id, event_type, event_id, pid as from_id, pf as from_fret, cast(run as double) as run, cast(tick - run - pt as double) as cut_ticks from k""",
)
def joined_slides(spark, folder):
    n = events(spark, folder).selectExpr(
        "user_id", "event_type", "event_id", "us div 1000000 as tick", "event_id % 25 as fret", "cast(round(value * 2000) as bigint) as length",
        "case event_id % 5 when 0 then 'below' when 1 then 'above' end as slide_in", "event_id % 7 = 0 as dead", "event_id % 11 = 0 as bent",
        "if(event_id % 13 = 0, 'up', null) as slide_out",
    )
    return N.joined_slides(n, ["user_id", "event_type"], "tick", "event_id", 5000.0, 1000.0, 480.0)


CURVE_SQL = f"""i as (select l_orderkey, item, item * 100 as tick, 100 as len, units % 3 > 0 as none, units % 5 as v from ({ITEMS_SQL})),
  a as (select *, coalesce(last_value(case when not none then v end ignore nulls) over (partition by l_orderkey order by item rows between unbounded preceding and 1 preceding), 0) as bf from i where l_orderkey in (select l_orderkey from i where not none)),
  cv as (select l_orderkey, item, unnest([0, 1]) as pt, cast(tick + unnest(case when none then [0, 60] else [0, 30] end) / 60 * len as double) as tick, cast(unnest(case when none then [bf, bf] else [bf, v] end) as double) as value from a)"""


def curve(spark, folder):
    """Curve points of the chains, and the lines they come from."""
    line = item_line(spark, folder)
    parts = line.df.selectExpr("l_orderkey", "item", "item * 100.0D as tick", "100.0D as len", "units % 3 > 0 as none", "cast(units % 5 as double) as v")
    from ..functions.ordered import fill

    parts = ordered(parts, ORDER, ["item"], like=line).add(bf=fill(F.when(~F.col("none"), F.col("v")), before=True)).df
    pts = F.array(
        F.struct(F.lit(0.0).alias("offset"), F.coalesce("bf", F.lit(0.0)).alias("value")), F.struct(F.lit(30.0).alias("offset"), F.col("v").alias("value"))
    )
    return N.bend_curve(parts.withColumn("pts", F.when(~F.col("none"), pts)), ORDER, "item", "tick", "len", "pts", like=line), line


@query("bend_curve", f"with {CURVE_SQL} select * from cv")
def bend_curve(spark, folder):
    return curve(spark, folder)[0]


@query(
    "bend_at",
    f"""with {CURVE_SQL}, c as (select *, item * 2 + pt as cid from cv), p as (select l_orderkey, item, item * 97.0::double - 20 as x from ({ITEMS_SQL}) where l_orderkey in (select l_orderkey from cv)),
    j as (select p.*, (select max_by(c, c.cid) from c where c.l_orderkey = p.l_orderkey and c.tick < p.x) as a, (select min_by(c, c.cid) from c where c.l_orderkey = p.l_orderkey and c.tick >= p.x) as b from p)
    select l_orderkey, item, round(case when a is null then b.value when b is null then a.value when b.tick > a.tick then a.value + (b.value - a.value) * (x - a.tick) / (b.tick - a.tick) else b.value end, 6) as bend from j""",
)
def bend_at(spark, folder):
    c, line = curve(spark, folder)
    c = c.withColumn("cid", F.col("item") * 2 + F.col("pt"))
    p = line.df.selectExpr("l_orderkey", "item", "item * 97.0D - 20 as x").join(c.select("l_orderkey").distinct(), "l_orderkey", "left_semi")
    found = N.bend_at(p, c.drop("item", "pt"), ORDER, "x", "item", "cid", like=line)
    return found.select("l_orderkey", "item", F.round("bend", 6).alias("bend"))


@query(
    "bend_class",
    f"""select event_id, case when event_type = 'error' then 'release' when value <= 2 then 'bend:1' when value <= 4 then 'bend:2' else 'bend:3' end as mark from ({EVENTS_SQL})""",
)
def bend_class(spark, folder):
    return events(spark, folder).select("event_id", N.bend_class(F.col("value"), F.col("event_type") == "error").alias("mark"))


@query(
    "peaks",
    f"""with s as (select event_type, floor(sec / 3600.0) as slot, max(abs(value)) as p from ({EVENTS_SQL}) group by 1, 2)
    select event_type, cast(slot as bigint) as slot, round(p / max(p) over (partition by event_type), 6) as peak from s""",
)
def peaks(spark, folder):
    return N.peaks(events(spark, folder), ["event_type"], "sec", "value", 3600.0).withColumn("peak", F.round("peak", 6))


# --- Quality ---
@query(
    "track_report",
    f"""with n as (select l_orderkey, cast(l_suppkey % 3 as int) as track, item // 4 as bar, item // 2 as beat, units % 4 = 0 as tie, l_returnflag as src, units > 40 as est, cast(4 + l_partkey % 4 as int) as strings from ({ITEMS_SQL})),
    b as (select l_orderkey, track, bar, beat, count(*) as n, bool_or(not tie) as struck from n group by 1, 2, 3, 4), t as (select l_orderkey, track, sum(case when struck then n else 0 end) as notes from b group by 1, 2),
    m as (select l_orderkey, track, bar, bool_or(est) as e from n group by 1, 2, 3), r as (select l_orderkey, track, count(*) as measures, count(*) filter (not e) as notated, count(*) filter (e) as estimated from m group by 1, 2),
    s as (select l_orderkey, track, max(strings) as strings, array_to_string(list_sort(list(distinct src)), ',') as sources from n group by 1, 2)
    select l_orderkey, track, notes::bigint as notes, measures, strings, notated, estimated, sources, case when strings <= 5 then 'bass' else 'steel' end as instrument from t join r using (l_orderkey, track) join s using (l_orderkey, track)""",
)
def track_report(spark, folder):
    n = items(spark, folder).selectExpr(
        "l_orderkey", "cast(l_suppkey % 3 as int) as track", "item div 4 as bar", "item div 2 as beat", "units % 4 = 0 as tie",
        "l_returnflag as src", "units > 40 as est", "cast(4 + l_partkey % 4 as int) as strings",
    )
    return Q.track_report(n, ["l_orderkey", "track"], "bar", "beat", F.col("tie"), "src", F.col("est"), "strings")


@query(
    "song_report",
    f"""with t as (select o_custkey, o_orderstatus as name, min(bar) as track, count(*) as measures, sum(o_orderkey % 50)::bigint as notes, case when count(*) > 4 then 'long' end as warn from ({BARS_SQL}) group by 1, 2),
    s as (select *, count(*) over (partition by o_custkey) as k from t)
    select o_custkey, count(*) as n_tracks, max(measures) as measures, sum(notes)::bigint as notes, string_agg(name, ',' order by track) as names,
      coalesce(string_agg(case when k > 1 then name || ': ' || warn else warn end, '; ' order by track), '') as warnings from s group by 1""",
)
def song_report(spark, folder):
    t = bars(spark, folder).groupBy("o_custkey", F.col("o_orderstatus").alias("name")).agg(
        F.min("bar").alias("track"), F.count("*").alias("measures"), F.sum(F.col("o_orderkey") % 50).alias("notes"), F.when(F.count("*") > 4, "long").alias("warn")
    )
    return Q.song_report(t, CUST, "track", "name", "measures", "notes", "warn")


@query(
    "change_points",
    f"""with e as ({EVENTS_SQL}), w as (select *, lag(event_type) over (partition by user_id order by us, event_id) as p from e) select user_id, event_id, event_type from w where p is null or p <> event_type""",
)
def change_points(spark, folder):
    return Q.change_points(events(spark, folder), USER, ["us", "event_id"], "event_type").select("user_id", "event_id", "event_type")


@query(
    "compare_readings",
    f"""with i as (select l_orderkey, item // 4 as bar, item % 4 as beat, l_partkey % 25 as f, units from ({ITEMS_SQL})), a as (select * from i where units % 10 > 0), b as (select l_orderkey, bar, beat, case when units % 9 = 0 then f + 1 else f end as f from i where units % 8 > 0),
    j as (select coalesce(a.l_orderkey, b.l_orderkey) as l_orderkey, coalesce(a.bar, b.bar) as bar, a.f as fa, b.f as fb from a full join b on a.l_orderkey = b.l_orderkey and a.bar = b.bar and a.beat = b.beat),
    r as (select l_orderkey, bar, count(fa) as n, count(*) filter (fa is not null and fb is not null) as f, count(*) filter (fa = fb) as r, count(*) filter (fa is null) as x, bool_and(coalesce(fa = fb, false)) as eq from j group by 1, 2)
    select l_orderkey, sum(n)::bigint as notes, sum(f)::bigint as found, sum(r)::bigint as right_fret, sum(x)::bigint as extra, count(*) as bars, count(*) filter (eq) as bars_equal from r group by 1""",
)
def compare_readings(spark, folder):
    i = items(spark, folder).selectExpr("l_orderkey", "item div 4 as bar", "item % 4 as beat", "l_partkey % 25 as f", "units")
    b = i.where("units % 8 > 0").withColumn("f", F.expr("if(units % 9 = 0, f + 1, f)"))
    return Q.compare_readings(i.where("units % 10 > 0"), b, ORDER, ["bar", "beat"], "f", "bar")


@query(
    "i18n_coverage",
    """with t as (select doc_id // 3 as k, lang, case when n_chars % 11 = 0 then ' ' else '{p' || (n_chars % 3) || '} x' end as text from documents), langs as (select unnest(['en', 'de', 'fr', 'es']) as lang),
    f as (select k, lang, min(text) as text from t group by 1, 2), c as (select distinct k, langs.lang from t, langs), j as (select c.k, c.lang, f.text, b.text as bt from c left join f on f.k = c.k and f.lang = c.lang left join f b on b.k = c.k and b.lang = 'en'),
    p as (select k, lang, case when text is null then 'missing' when trim(text) = '' then 'empty' when bt is not null and list_sort(list_distinct(regexp_extract_all(text, '\\{(\\w+)\\}', 1))) <> list_sort(list_distinct(regexp_extract_all(bt, '\\{(\\w+)\\}', 1))) then 'placeholders' end as problem from j)
    select * from p where problem is not null""",
)
def i18n_coverage(spark, folder):
    text = F.expr("if(n_chars % 11 = 0, ' ', concat('{p', n_chars % 3, '} x'))")
    t = table(spark, folder, "documents").select(F.expr("doc_id div 3").alias("k"), "lang", text.alias("text"))
    t = t.groupBy("k", "lang").agg(F.min("text").alias("text"))
    return Q.i18n_coverage(t, "k", "lang", "text", ["en", "de", "fr", "es"])
