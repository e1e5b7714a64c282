"""Queries of the metadata, catalog, edit, source and sink operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.ordered import Ordered, keyed, number, ordered, total_min
from ..functions.session import checkpoint
from ..operators import catalog as C
from ..operators import edits as E
from ..operators import metadata as M
from ..sources import files as S
from ..sources import geometry as G
from ..sources import sinks as K
from .registry import query
from .rhythm import CUST, ORDER, TRACKS_SQL, track_bars
from .tables import BARS_SQL, GLYPH_SQL, ITEMS_SQL, LINES_SQL, bars, doc_lines, events, glyphs, item_line, items, table


def q(pattern: str) -> str:
    """A pattern inside a SQL string."""
    return pattern.replace("'", "''")


# --- Metadata ---
HEAD_LINES = """doc_id, line_no, case when doc_id % 3 = 0 and line_no = 3 then concat('Title : ', substr(line, 1, 30)) when doc_id % 5 = 0 and line_no = 2 then concat('Band - ', substr(line, 1, 20))
  when line_no % 4 = 1 then concat('by ', substr(line, 1, 12)) when doc_id % 7 = 0 and line_no = 4 then 'www.tabs.com' else substr(line, 1, 40) end as text,
  cast(line_no * 20 as double) as top, cast(10 + (doc_id + line_no * 3) % 7 as double) as height"""
HEAD_SQL = f"select {HEAD_LINES} from ({LINES_SQL})"


def head_lines(spark, folder):
    return doc_lines(spark, folder).selectExpr(
        "doc_id", "line_no",
        "case when doc_id % 3 = 0 and line_no = 3 then concat('Title : ', substr(line, 1, 30)) when doc_id % 5 = 0 and line_no = 2 then concat('Band - ', substr(line, 1, 20)) "
        "when line_no % 4 = 1 then concat('by ', substr(line, 1, 12)) when doc_id % 7 = 0 and line_no = 4 then 'www.tabs.com' else substr(line, 1, 40) end as text",
        "cast(line_no * 20 as double) as top", "cast(10 + (doc_id + line_no * 3) % 7 as double) as height",
    )


VISUAL_SQL = f"""hl as ({HEAD_SQL}), pl as (select * from hl where not regexp_matches(text, '{q(M.WEB_ADDRESS)}')), md as (select doc_id, median(height) as med from pl group by 1),
  cd as (select * from pl where top < 90.0 and regexp_matches(text, '[A-Za-zÀ-ÿ]{{2,}}')), bs as (select doc_id, max_by(cd, (height, -line_no)) as t from cd group by 1),
  ok as (select bs.* from bs join md using (doc_id) where t.height >= 1.3 * med),
  ar as (select cd.doc_id, min_by(nullif(trim(regexp_extract(text, '{q(M.CREDIT)}', 1)), ''), line_no) filter (nullif(trim(regexp_extract(text, '{q(M.CREDIT)}', 1)), '') is not null) as cr,
    min_by(text, line_no) filter (nullif(trim(regexp_extract(text, '{q(M.CREDIT)}', 1)), '') is null and not regexp_matches(text, '{q(M.NOT_ARTIST)}')) as pn from cd join ok using (doc_id) where cd.top > ok.t.top group by 1),
  vh as (select ok.doc_id, t.text as heading, coalesce(cr, pn) as heading_artist from ok left join ar using (doc_id))"""


def headings(spark, folder):
    return M.visual_heading(head_lines(spark, folder), ["doc_id"], "line_no", "text", "top", "height", F.lit(300.0))


@query("visual_heading", f"with {VISUAL_SQL} select * from vh")
def visual_heading(spark, folder):
    return headings(spark, folder)


@query(
    "extract_fields",
    f"""with {VISUAL_SQL}, inf as (select doc_id, case when doc_id % 4 = 0 then source || ' TABS by ' || lang || ' @ Site.com' when doc_id % 4 = 1 then source end as info_title, lang as info_author from documents),
    lb as (select doc_id, min_by(trim(regexp_extract(text, '{q(M.TITLE_LABEL)}', 1)), line_no) filter (trim(regexp_extract(text, '{q(M.TITLE_LABEL)}', 1)) <> '') as lt,
      min_by(trim(regexp_extract(text, '{q(M.ARTIST_LABEL)}', 1)), line_no) filter (trim(regexp_extract(text, '{q(M.ARTIST_LABEL)}', 1)) <> '') as la from hl group by 1),
    st as (select *, nullif(trim(regexp_extract(info_title, '{q(M.SITE_TITLE)}', 1)), '') as s1, nullif(trim(regexp_extract(info_title, '{q(M.SITE_TITLE)}', 2)), '') as s2 from inf)
    select st.doc_id, nullif(left(regexp_replace(coalesce(lt, heading, s1, info_title), '{q(M.QUOTES)}', '', 'g'), 100), '') as title,
      left(coalesce(la, heading_artist, s2, case when s1 is null then info_author end), 100) as artist from st left join vh using (doc_id) left join lb using (doc_id)""",
)
def extract_fields(spark, folder):
    info = table(spark, folder, "documents").selectExpr(
        "doc_id", "case when doc_id % 4 = 0 then concat(source, ' TABS by ', lang, ' @ Site.com') when doc_id % 4 = 1 then source end as info_title", "lang as info_author"
    ).join(headings(spark, folder), "doc_id", "left")
    return M.extract_fields(head_lines(spark, folder), ["doc_id"], "line_no", "text", info)


TEMPO_TEXT = """case l_partkey % 6 when 0 then concat('♩ = ', units * 10) when 1 then concat('♩. = ', units + 20) when 2 then concat('= ', units * 9) when 3 then concat('Tempo: ', units + 50)
  when 4 then concat('Played at ', units * 3, ' BPM') else 'andante' end"""


@query(
    "detect_tempo",
    f"""with t as (select l_orderkey, item, {TEMPO_TEXT} as s from ({ITEMS_SQL})),
    n as (select *, case when s like '♩%' then cast(regexp_extract(s, '= ([0-9]{{2,3}})$', 1) as varchar) when regexp_matches(s, '^= [0-9]{{2,3}}$') then s[3:] else regexp_extract(s, '(?:Tempo: |at )([0-9]{{2,3}})(?: BPM)?$', 1) end as d from t),
    b as (select *, try_cast(d as double) * case when s like '♩.%' then 1.5 else 1 end as bpm from n)
    select l_orderkey, item, case when bpm between 20 and 400 then cast(round_even(bpm, 0) as int) end as bpm from b""",
)
def detect_tempo(spark, folder):
    return items(spark, folder).select("l_orderkey", "item", M.detect_tempo(F.expr(TEMPO_TEXT)).alias("bpm"))


TUNE_TEXT = """case l_partkey % 5 when 0 then 'Tuning: Drop D' when 1 then 'Tuning : D A D G B E' when 2 then 'Afinação: EADGBE' when 3 then concat('Tuning - ', substr('CDEFGAB', cast(units % 7 as int) + 1, 1), ' A# D G') else 'Tuning is great' end"""


@query(
    "detect_tuning",
    f"""select l_orderkey, item, case l_partkey % 5 when 0 then 'E,B,G,D,A,D' when 1 then 'E,B,G,D,A,D' when 2 then 'E,B,G,D,A,E' when 3 then 'G,D,A#,' || substr('CDEFGAB', cast(units % 7 as int) + 1, 1) end as labels from ({ITEMS_SQL})""",
)
def detect_tuning(spark, folder):
    return items(spark, folder).select("l_orderkey", "item", F.array_join(M.detect_tuning(F.expr(TUNE_TEXT)), ",").alias("labels"))


# Labels of 4, 5, 6 or 7 strings: now and then a preset, else letters by part number.
LABEL_SETS = """case l_partkey % 6 when 0 then 'E,B,G,D,A,D' when 1 then 'e,B,G,D,A,E' when 2 then 'G,D,A,E' when 3 then concat(substr('CDEFGABX', cast(units % 8 as int) + 1, 1), ',A#,Gb,D')
  when 4 then concat(substr('CDEFGAB', cast(units % 7 as int) + 1, 1), ',B,F#,D,A,Eb') else '' end"""
PRESETS_SQL = "(values " + ", ".join(f"('{n}', '{','.join(map(str, m))}', {i})" for i, (n, m) in enumerate(M.TUNINGS.items())) + ") as ps(nm, midi, rk)"
PC_SQL = "case when regexp_full_match(x, '[A-Ga-g][#b]*') then ((case upper(x[1]) when 'C' then 0 when 'D' then 2 when 'E' then 4 when 'F' then 5 when 'G' then 7 when 'A' then 9 else 11 end) + length(x) - length(replace(x, '#', '')) - (length(x[2:]) - length(replace(x[2:], 'b', ''))) + 12) % 12 end"
RESOLVE_SQL = f"""i as (select l_orderkey, item, {LABEL_SETS} as ls, 4 + item % 4 as strings, case when l_suppkey % 4 = 0 then 'drop_d' else 'auto' end as req from ({ITEMS_SQL})),
  p as (select *, case when ls = '' then [] else string_split(ls, ',') end as lb from i), c as (select *, list_transform(lb, lambda x: {PC_SQL}) as pc from p),
  pp as (select nm, rk, cast(string_split(midi, ',') as int[]) as midi from {PRESETS_SQL}), mt as (select l_orderkey, item, arg_min(midi, rk) as m, arg_min(nm, rk) as mn from c join pp on list_transform(midi, lambda m: m % 12) = pc group by 1, 2),
  df as (select len(midi) as n, arg_min(midi, case nm when 'bass_4' then 0 when 'bass_5' then 0 when 'standard' then 0 when 'standard_7' then 0 else 1 end) as dm from pp group by 1),
  cu as (select c.*, case when len(list_filter(pc, lambda z: z is null)) = 0 and dm is not null then list_transform(list_zip(dm, pc), lambda z: z[1] + case when (z[2] - z[1] % 12 + 12) % 12 < 6 then (z[2] - z[1] % 12 + 12) % 12 else (z[2] - z[1] % 12 + 12) % 12 - 12 end) end as cust
    from c left join df on df.n = len(lb)),
  rs as (select cu.*, mt.mn, mt.m, d2.dm as def, case when req = 'drop_d' and strings = 6 then [64, 59, 55, 50, 45, 38] when req = 'auto' and len(lb) = strings then coalesce(mt.m, cust) end as ch
    from cu left join mt on mt.l_orderkey = cu.l_orderkey and mt.item = cu.item left join df d2 on d2.n = cu.strings)"""


def labelled(spark, folder):
    i = items(spark, folder).selectExpr("l_orderkey", "item", f"{LABEL_SETS} as ls", "cast(4 + item % 4 as int) as strings", "if(l_suppkey % 4 = 0, 'drop_d', 'auto') as req")
    return i.withColumn("lb", F.when(F.col("ls") == "", F.array().cast("array<string>")).otherwise(F.split("ls", ",")))


@query("match_tuning", f"with {RESOLVE_SQL} select l_orderkey, item, mn as preset, array_to_string(cust, ',') as custom from rs")
def match_tuning(spark, folder):
    i = labelled(spark, folder)
    return i.select("l_orderkey", "item", M.match_tuning(F.col("lb")).alias("preset"), F.array_join(M.custom_tuning(F.col("lb")), ",").alias("custom"))


@query(
    "resolve_tuning",
    f"""with {RESOLVE_SQL} select l_orderkey, item, array_to_string(coalesce(ch, def), ',') as tuning, coalesce((select arg_min(nm, rk) from pp where pp.midi = coalesce(ch, def)), 'custom') as tuning_name,
      case when req <> 'auto' and strings <> 6 then 'strings' when req = 'auto' and len(lb) > 0 and len(lb) = strings and m is null and cust is null then 'unknown' when req = 'auto' and len(lb) > 0 and len(lb) <> strings then 'labels' end as reason from rs""",
)
def resolve_tuning(spark, folder):
    found = M.resolve_tuning(labelled(spark, folder), "req", "strings", "lb")
    return found.select("l_orderkey", "item", F.array_join("tuning", ",").alias("tuning"), "tuning_name", "reason")


@query(
    "merge_first",
    """with c as (select *, case when length(text) % 3 > 0 then left(text, 10) end as title, case when length(text) % 4 = 0 then length(text) end as num, case when length(text) % 8 < 5 then 4 end as den from conversations)
    select conv_id, min_by(title, turn) filter (title is not null) as title, min_by(num, turn) filter (num is not null and den is not null) as num, min_by(den, turn) filter (num is not null and den is not null) as den from c group by 1""",
)
def merge_first(spark, folder):
    c = table(spark, folder, "conversations").selectExpr(
        "conv_id", "turn", "if(length(text) % 3 > 0, left(text, 10), null) as title", "if(length(text) % 4 = 0, length(text), null) as num", "if(length(text) % 8 < 5, 4, null) as den"
    )
    return M.merge_first(c, ["conv_id"], "turn", ["title"], ("num", "den"))


@query(
    "fill_from",
    """with a as (select p_partkey, case when p_partkey % 3 > 0 then replace(p_name, ' ', '') end as title, case when p_partkey % 4 > 0 then upper(p_type) end as kind from part),
    b as (select p_partkey, upper(p_name) as title, p_type as kind from part where p_partkey % 5 > 0)
    select a.p_partkey, case when a.title is null or (b.title is not null and lower(replace(b.title, ' ', '')) = lower(a.title)) then coalesce(b.title, a.title) else a.title end as title,
      case when a.kind is null then b.kind else a.kind end as kind from a left join b using (p_partkey)""",
)
def fill_from(spark, folder):
    p = table(spark, folder, "part")
    a = p.selectExpr("p_partkey", "if(p_partkey % 3 > 0, replace(p_name, ' ', ''), null) as title", "if(p_partkey % 4 > 0, upper(p_type), null) as kind")
    b = p.where("p_partkey % 5 > 0").selectExpr("p_partkey", "upper(p_name) as title", "p_type as kind")
    return M.fill_from(a, b, ["p_partkey"], ["title", "kind"])


@query(
    "apply_overrides",
    """with c as (select c_custkey, case when c_custkey % 3 = 0 then '  ' when c_custkey % 3 = 1 then c_name end as u, case when c_custkey % 2 = 0 then c_mktsegment end as d from customer)
    select c_custkey, coalesce(nullif(trim(u), ''), nullif(trim(d), ''), 'none') as title, nullif(trim(u), '') is null as title_auto from c""",
)
def apply_overrides(spark, folder):
    c = table(spark, folder, "customer").selectExpr(
        "c_custkey", "case when c_custkey % 3 = 0 then '  ' when c_custkey % 3 = 1 then c_name end as u", "if(c_custkey % 2 = 0, c_mktsegment, null) as d"
    )
    return M.apply_overrides(c, "u", "d", F.lit("none"), "title").select("c_custkey", "title", "title_auto")


PART_TEXT = "case when doc_id % 4 = 0 and line_no = 2 then 'Track: Rhythm (old) - X' when doc_id % 3 = 0 and line_no = 1 then 'bass 2' when line_no = 0 then 'guitar' else substr(line, 1, 50) end"


@query(
    "part_name",
    f"""with l as (select doc_id, line_no, {PART_TEXT} as t, 'guitar' as title from ({LINES_SQL})), n as (select *, case when t = 'Track: Rhythm (old) - X' then 'Rhythm' when t = 'bass 2' then 'Bass 2'
      when t <> title and length(t) <= 40 then nullif(trim(regexp_extract(t, '{q(M.PART_NAME)}', 0)), '') end as nm from l) select doc_id, min_by(nm, line_no) filter (nm is not null) as part from n group by 1""",
)
def part_name(spark, folder):
    lines = doc_lines(spark, folder).selectExpr("doc_id", "line_no", f"{PART_TEXT} as t", "'guitar' as title")
    return M.part_name(lines, ["doc_id"], "line_no", "t", ["title"])


@query(
    "residue_name",
    """select p_partkey, case p_partkey % 4 when 0 then nullif(p_brand, '') when 1 then null when 2 then 'x y' else p_name || ' - x' end as track_name from part""",
)
def residue_name(spark, folder):
    p = table(spark, folder, "part").selectExpr(
        "p_partkey", "p_name", "p_type",
        "case p_partkey % 4 when 0 then concat('in/', replace(p_name, ' ', '_'), '_-_', p_type, ' - ', p_brand, '.pdf') when 1 then concat(upper(p_name), ' - ', p_type, '.PNG') when 2 then concat('x_y – ', p_type, '.jpg') else concat(p_name, ' - x') end as filename",
        "if(p_partkey % 4 = 3, null, p_name) as title",
    )
    return M.residue_name(p, "filename", ["title", "p_type"]).select("p_partkey", "track_name")


@query(
    "match_candidates",
    """with s as (select c_custkey, 'The ' || c_mktsegment as artist, 'Song ' || (c_custkey % 7) as title from customer),
    r as (select p_partkey as rk, ['building', 'MACHINERY', 'Household!', 'other'][cast(p_partkey % 4 as int) + 1] as artist, case when p_partkey % 3 = 0 then 'song ' || (p_partkey % 9) || ' (live)' else p_name end as title,
      case when p_partkey % 5 = 0 then 'http' else 'https' end || '://a' || (p_partkey % 3) || '.img.example/' || p_partkey || '/100x100bb.jpg' as url from part),
    k as (select *, regexp_replace(regexp_replace(lower(artist), '[^a-z0-9]+', '', 'g'), '^the', '') as ak, regexp_replace(lower(title), '[^a-z0-9]+', '', 'g') as tk, case when url like 'https%' then replace(url, '/100x100bb.jpg', '/600x600bb.jpg') end as u from r),
    w as (select *, regexp_replace(regexp_replace(lower(artist), '[^a-z0-9]+', '', 'g'), '^the', '') as ak, regexp_replace(lower(title), '[^a-z0-9]+', '', 'g') as tk from s),
    d as (select distinct ak, tk from w), j as (select d.ak, d.tk, k.rk, k.u, contains(d.tk, k.tk) or contains(k.tk, d.tk) as same from d join k on k.ak = d.ak),
    b as (select ak, tk, case when bool_or(same) then min_by(u, rk) filter (same and u is not null) else min_by(u, rk) filter (u is not null) end as cover_url from j group by 1, 2)
    select c_custkey, cover_url from w left join b on b.ak = w.ak and b.tk = w.tk""",
)
def match_candidates(spark, folder):
    s = table(spark, folder, "customer").selectExpr("c_custkey", "concat('The ', c_mktsegment) as artist", "concat('Song ', c_custkey % 7) as title")
    r = table(spark, folder, "part").selectExpr(
        "p_partkey as rk", "element_at(array('building', 'MACHINERY', 'Household!', 'other'), cast(p_partkey % 4 as int) + 1) as ra",
        "if(p_partkey % 3 = 0, concat('song ', p_partkey % 9, ' (live)'), p_name) as rt",
        "concat(if(p_partkey % 5 = 0, 'http', 'https'), '://a', p_partkey % 3, '.img.example/', p_partkey, '/100x100bb.jpg') as url",
    )
    return M.match_candidates(s, r, "c_custkey", "artist", "title", "ra", "rt", "rk", "url", ".img.example")


@query(
    "search",
    f"""select doc_id from documents where contains(strip_accents(lower(text)), 'ouque') and contains(strip_accents(lower(text)), 'elle')""",
)
def search(spark, folder):
    return M.search(table(spark, folder, "documents"), F.col("text"), " Ouqué  ELLE", by_word=True).select("doc_id")


NAME_TEXT = "case p_partkey % 5 when 0 then concat('AC/DC - ', p_name, ': In ', p_type, '?') when 1 then 'CON' when 2 then '  ..  ' when 3 then concat(' ', p_name, '  x . ') else p_brand end"


@query(
    "safe_name",
    """select p_partkey, case p_partkey % 5 when 0 then 'AC_DC - ' || p_name || '_ In ' || p_type || '_' when 1 then 'none' when 2 then 'none' when 3 then p_name || ' x' else p_brand end as name,
      case p_partkey % 5 when 0 then 'AC_DC - ' || p_name || '_ In ' || p_type when 1 then 'CON' when 2 then '' when 3 then p_name || '  x' else replace(p_brand, '#', '_') end as ascii from part""",
)
def safe_name(spark, folder):
    p = table(spark, folder, "part").withColumn("t", F.expr(NAME_TEXT))
    return p.select("p_partkey", M.safe_name(F.col("t"), "none").alias("name"), M.ascii_name(F.col("t")).alias("ascii"))


LINK_TEXT = """case page_id % 9 when 0 then concat('https://www.youtube.com/watch?v=abcDEF', 10000 + page_id % 20, '&t=12s') when 1 then concat('https://youtu.be/abcDEF', 10000 + page_id % 20) when 2 then 'https://www.youtube.com/playlist?list=x'
  when 3 then 'javascript:alert(1)' when 4 then concat('http://me:pw@', page_id % 3, '.example.com/') when 5 then 'https://a b.example' else url end"""


@query(
    "clean_links",
    f"""with u as (select page_id, {LINK_TEXT} as u, page_id % 9 as k from pages), c as (select *, case k when 2 then 'not a video' when 3 then 'scheme' when 4 then 'credentials' when 5 then 'characters' end as reason,
      case when k in (0, 1) then 'v=abcDEF' || (10000 + page_id % 20) when k < 6 then null else regexp_replace(u, '#.*$', '') end as link from u)
    select link, reason, count(*) as n, min(page_id) as first_seen from c group by 1, 2""",
)
def clean_links(spark, folder):
    return M.clean_links(table(spark, folder, "pages").selectExpr("page_id", f"{LINK_TEXT} as u"), "u", "page_id")


@query(
    "classify_permission",
    """with p as (select *, regexp_extract(url, '^https?://([^/]+)', 1) as host from pages) select page_id, case when page_id % 4 = 0 then 'licence' when page_id % 4 = 1 and page_id % 3 = 0 then 'personal' when page_id % 5 = 0 and not (page_id % 4 = 1) then 'direct'
      when page_id % 4 <> 1 and host like '%.example.org' then 'declared' else 'refused' end as permission from p""",
)
def classify_permission(spark, folder):
    p = table(spark, folder, "pages").selectExpr(
        "page_id", "if(page_id % 4 = 1, 'www.youtube.com', regexp_extract(url, '^https?://([^/]+)', 1)) as host", "if(page_id % 4 = 0, 'CC BY 4.0', 'all rights') as licence",
        "page_id % 3 = 0 as personal", "page_id % 5 = 0 as direct",
    )
    return M.classify_permission(p, "host", "licence", "personal", "direct", ["example.org"]).select("page_id", "permission")


@query(
    "classify_messages",
    """with m as (select conv_id, case length(text) % 9 when 0 then 'Sign in to confirm you are not a bot' when 1 then 'No supported JavaScript runtime' when 2 then 'Private video' when 3 then 'Read timed out' else '' end as t from conversations)
    select conv_id, case min(case when t like 'No%' then 1 when t like 'Sign%' then 2 when t like 'Priv%' then 3 when t like 'Read%' then 4 end) when 1 then 'runtime' when 2 then 'bot' when 3 then 'private' when 4 then 'network' end as cause from m group by 1""",
)
def classify_messages(spark, folder):
    m = table(spark, folder, "conversations").selectExpr(
        "conv_id", "concat(text, case length(text) % 9 when 0 then 'Sign in to confirm you are not a bot' when 1 then 'No supported JavaScript runtime' when 2 then 'Private video' when 3 then 'Read timed out' else '' end) as t"
    )
    return M.classify_messages(m, ["conv_id"], "t")


@query(
    "localise",
    """with t as (select doc_id // 3 as k, lang, min(left(text, 8)) as text from documents group by 1, 2), k as (select distinct k from t)
    select k.k, coalesce(max(text) filter (lang = 'fr'), max(text) filter (lang = 'en'), max(text) filter (lang = 'de')) as text from k left join t using (k) group by 1""",
)
def localise(spark, folder):
    t = table(spark, folder, "documents").groupBy(F.expr("doc_id div 3").alias("k"), "lang").agg(F.min(F.left("text", F.lit(8))).alias("text"))
    return M.localise(t.select("k").distinct(), t, "k", "lang", "text", "fr", ["en", "de"])


# --- Catalog ---
def catalog(spark, folder):
    c = table(spark, folder, "customer")
    return c.select(
        C.song_key(F.col("c_mktsegment"), F.expr("concat('Song ', c_custkey)")).alias("key"),
        F.col("c_name").alias("title"),
        (F.col("c_custkey") * 10).alias("saved_at"),
        F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("a"), F.col("c_custkey"), F.lit(".mp3"))).alias("audio"),
        "c_custkey",
    ).where("c_custkey % 4 > 0")


CAT_SQL = "cat as (select lower(c_mktsegment || ' - Song ' || c_custkey) as key, c_name as title, c_custkey * 10 as saved_at, case when c_custkey % 3 = 0 then 'a' || c_custkey || '.mp3' end as audio, c_custkey from customer where c_custkey % 4 > 0)"
BATCH_SQL = "bat as (select lower(c_mktsegment || ' - Song ' || c_custkey) as key, 'new ' || c_name || o as title, 5000 + c_custkey * 7 % 11000 + o as saved_at, o from customer, (select unnest([1, 2]) as o) where c_custkey % 5 < 2)"


def batch(spark, folder):
    c = table(spark, folder, "customer").where("c_custkey % 5 < 2").withColumn("o", F.explode(F.array(F.lit(1), F.lit(2))))
    return c.select(
        C.song_key(F.col("c_mktsegment"), F.expr("concat('Song ', c_custkey)")).alias("key"),
        F.expr("concat('new ', c_name, o)").alias("title"), F.expr("5000 + c_custkey * 7 % 11000 + o").alias("saved_at"), "o",
    )


@query(
    "upsert_catalog",
    f"""with {CAT_SQL}, {BATCH_SQL}, l as (select key, max_by(title, o) as title, max_by(saved_at, o) as saved_at from bat group by 1)
    select coalesce(cat.key, l.key) as key, coalesce(l.title, cat.title) as title, coalesce(l.saved_at, cat.saved_at) as saved_at, audio, l.key is not null as written from cat full join l on l.key = cat.key""",
)
def upsert_catalog(spark, folder):
    return C.upsert(catalog(spark, folder), batch(spark, folder), "key", ["title", "saved_at"], ["audio"], "o")


@query(
    "assign_names",
    """with recursive r as (select p_partkey, p_name, lower(p_name) as b, row_number() over (partition by lower(p_name) order by p_partkey) as k from part where p_partkey % 3 > 0),
    t as (select distinct case when p_partkey % 4 = 0 then lower(p_name) else lower(p_name) || ' (' || (2 + p_partkey % 6) || ')' end as nm from part where p_partkey % 3 = 0 and p_partkey % 7 < 3),
    n as (select b, unnest(range(1, cnt + 10)) as no from (select b, count(*) as cnt from r group by 1)), f as (select b, no, row_number() over (partition by b order by no) as k from n where case when no = 1 then b else b || ' (' || no || ')' end not in (select nm from t))
    select p_partkey, case when no = 1 then p_name else p_name || ' (' || no || ')' end as unique_name from r join f on f.b = r.b and f.k = r.k""",
)
def assign_names(spark, folder):
    p = table(spark, folder, "part")
    taken = p.where("p_partkey % 3 = 0 and p_partkey % 7 < 3").selectExpr("if(p_partkey % 4 = 0, upper(p_name), concat(p_name, ' (', 2 + p_partkey % 6, ')')) as p_name")
    return C.assign_names(p.where("p_partkey % 3 > 0").select("p_partkey", "p_name"), taken, "p_name", "p_partkey").select("p_partkey", "unique_name")


@query(
    "list_catalog",
    f"select o_orderkey, o_custkey, us as saved_at, coalesce(case when o_orderkey % 5 = 0 then null else o_orderstatus end, '') as title, coalesce(case when o_orderkey % 7 > 0 then bar end, 0) as measures from ({BARS_SQL})",
)
def list_catalog(spark, folder):
    c = bars(spark, folder).selectExpr("o_orderkey", "o_custkey", "us as saved_at", "if(o_orderkey % 5 = 0, null, o_orderstatus) as title", "if(o_orderkey % 7 > 0, bar, null) as measures")
    return C.list_catalog(c, "saved_at", {"title": F.lit(""), "measures": F.lit(0)})


@query("import_preview", f"with {CAT_SQL}, {BATCH_SQL} select bat.key, bat.title, o, cat.saved_at as existing_saved_at, cat.key is not null as exists from bat left join cat using (key)")
def import_preview(spark, folder):
    return C.import_preview(catalog(spark, folder), batch(spark, folder).drop("saved_at"), "key", "saved_at")


@query(
    "import_songs",
    f"""with {CAT_SQL}, {BATCH_SQL} select bat.key, o, case when cat.key is null then 'imported' when bat.saved_at % 2 = 0 then 'replaced' else 'skipped' end as action from bat left join cat using (key) where bat.saved_at % 3 > 0 and o = 1""",
)
def import_songs(spark, folder):
    b = batch(spark, folder).where("o = 1")
    found = C.import_songs(catalog(spark, folder), b, b.where("saved_at % 3 > 0"), b.where("saved_at % 2 = 0"), "key")
    return found.select("key", "o", "action")


@query(
    "merge_newest",
    f"""with {CAT_SQL}, {BATCH_SQL}, b as (select key, title, saved_at from bat where o = 1) select coalesce(cat.key, b.key) as key, case when b.key is null or cat.saved_at >= b.saved_at then cat.title else b.title end as title,
      greatest(cat.saved_at, b.saved_at) as saved_at from cat full join b on b.key = cat.key""",
)
def merge_newest(spark, folder):
    return C.merge_newest(catalog(spark, folder).select("key", "title", "saved_at"), batch(spark, folder).where("o = 1").select("key", "title", "saved_at"), "key", "saved_at", ["title"])


@query(
    "validate_bundle",
    """with m as (select o_custkey as bundle, o_orderkey as folder, o_orderkey % 97 as key from orders), f as (select o_custkey as bundle, o_orderkey as folder, o_totalprice as size from orders where o_orderkey % 41 > 0),
    k as (select bundle, count(*) as songs, max(n) as same from (select bundle, key, count(*) as n from m group by 1, 2) group by 1), s as (select bundle, sum(n)::bigint as songs from (select bundle, count(*) as n from m group by 1) group by 1),
    g as (select distinct m.bundle from m anti join f on f.bundle = m.bundle and f.folder = m.folder), z as (select bundle, max(size) as mx from f group by 1)
    select s.bundle, s.songs, case when s.songs > 1000 then 'songs' when same > 1 then 'duplicate' when g.bundle is not null then 'missing' when mx > 480000 then 'size' end as refused from s join k using (bundle) left join g on g.bundle = s.bundle left join z on z.bundle = s.bundle""",
)
def validate_bundle(spark, folder):
    o = table(spark, folder, "orders")
    m = o.selectExpr("o_custkey as bundle", "o_orderkey as folder", "o_orderkey % 97 as key")
    f = o.where("o_orderkey % 41 > 0").selectExpr("o_custkey as bundle", "o_orderkey as folder", "o_totalprice as size")
    return C.validate_bundle(m, f, "bundle", "folder", "key", "size", 480000)


@query(
    "clean_settings",
    """select event_id, case when event_id % 3 = 0 then '' else cast(json_extract(props, '$.k') as varchar) end as tempo, '[' || event_type || ']' as label, 'NaN' as "offset", 1 as others from events""",
)
def clean_settings(spark, folder):
    made = F.expr(
        "concat('{\"audio\": {\"offset\": \"NaN\", ', if(event_id % 3 = 0, '', concat('\"tempo\": ', get_json_object(props, '$.k'), ', ')), '\"label\": \"[', event_type, ']\", \"x\": {\"y\": 1}, \"z\": [1], \"on\": true, \"n\": null}, \"other\": {\"a\": 1}, \"video\": 5}')"
    )
    found = C.clean_settings(events(spark, folder).withColumn("settings", made), "settings")
    a = F.col("audio_settings")
    return found.select(
        "event_id", F.coalesce(F.try_element_at(a, F.lit("tempo")), F.lit("")).alias("tempo"), F.try_element_at(a, F.lit("label")).alias("label"),
        F.try_element_at(a, F.lit("offset")).alias("offset"),
        (F.size(F.map_filter(a, lambda k, v: ~k.isin("tempo", "label", "offset"))) + F.size("video_settings")).alias("others"),
    )


@query(
    "set_files",
    f"""with {CAT_SQL}, ch as (select c_custkey, case when o = 1 then 'cover' else 'audio' end as kind, case when c_custkey % 2 = 0 then null else 'f' || o || '.png' end as entry, o from (select * from cat), (select unnest([1, 2, 3]) as o) where c_custkey % 3 < 2),
    l as (select c_custkey, kind, max_by(case when entry is null then '-' else entry end, o) as e from ch group by 1, 2)
    select cat.c_custkey, case when c.e is null then 'c.jpg' when c.e = '-' then null else c.e end as cover, case when a.e is null then audio when a.e = '-' then null else a.e end as audio, 1 + case when c.e is not null then 1 else 0 end as cover_version
    from cat left join l c on c.c_custkey = cat.c_custkey and c.kind = 'cover' left join l a on a.c_custkey = cat.c_custkey and a.kind = 'audio'""",
)
def set_files(spark, folder):
    c = catalog(spark, folder).withColumns(
        {"files": F.map_filter(F.create_map(F.lit("cover"), F.lit("c.jpg"), F.lit("audio"), F.col("audio")), lambda k, v: v.isNotNull()), "cover_version": F.lit(1)}
    )
    ch = catalog(spark, folder).where("c_custkey % 3 < 2").withColumn("o", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    ch = ch.selectExpr("c_custkey", "if(o = 1, 'cover', 'audio') as kind", "if(c_custkey % 2 = 0, null, concat('f', o, '.png')) as entry", "o")
    found = C.set_files(c.drop("audio"), ch, "c_custkey", "kind", "entry", "o")
    return found.select("c_custkey", F.try_element_at("files", F.lit("cover")).alias("cover"), F.try_element_at("files", F.lit("audio")).alias("audio"), "cover_version")


@query(
    "coerce_fields",
    """select c_custkey, left(trim('  ' || c_name || ' '), 12) as title, case when c_custkey % 3 = 0 then null when c_custkey % 3 = 1 then cast(floor(c_custkey + 0.5) as bigint) end as tempo from customer""",
)
def coerce_fields(spark, folder):
    c = table(spark, folder, "customer").selectExpr(
        "c_custkey", "concat('  ', c_name, ' ') as title", "case c_custkey % 3 when 0 then 'true' when 1 then cast(c_custkey + 0.5 as string) else '-4' end as tempo"
    )
    rows, _ = C.coerce_fields(c, {"title": 12}, ["tempo"], {})
    return rows


@query(
    "file_of",
    """select o_orderkey, 'f' || o_orderkey || case when o_orderkey % 2 = 0 then '.mp3' else '.ogg' end as file, case when o_orderkey % 2 = 0 then 'audio/mpeg' else 'audio/ogg' end as media_type,
      o_orderpriority || case when o_orderkey % 2 = 0 then '.mp3' else '.ogg' end as download_name from orders where o_orderkey % 3 > 0 and o_orderkey % 5 > 0""",
)
def file_of(spark, folder):
    o = table(spark, folder, "orders").withColumn("file", F.expr("concat('f', o_orderkey, if(o_orderkey % 2 = 0, '.mp3', '.ogg'))"))
    c = o.select("o_orderkey", F.col("o_orderpriority").alias("title"), F.when(F.col("o_orderkey") % 3 > 0, F.create_map(F.lit("audio"), F.col("file"))).alias("files"))
    return C.file_of(c, o.where("o_orderkey % 5 > 0"), "o_orderkey", "audio", "files", {".mp3": "audio/mpeg", ".ogg": "audio/ogg"})


# --- Edits ---
@query(
    "check_edits",
    f"""with e as (select l_orderkey as request, l_suppkey % 65 as track, item as bar, units % 2 as voice, item as beat, 1 + l_partkey % 12 as string, case when l_partkey % 101 = 0 then null else 5 end as expected, case when l_partkey % 3 > 0 then l_partkey % 102 end as fret from ({ITEMS_SQL}))
    select request, count(*) as edits, bool_and(coalesce(track <= 63 and expected between 0 and 99, false) and (fret is null or fret <= 99)) and count(*) <= 500 as accepted from e group by 1""",
)
def check_edits(spark, folder):
    e = items(spark, folder).selectExpr(
        "l_orderkey as request", "l_suppkey % 65 as track", "item as bar", "units % 2 as voice", "item as beat", "1 + l_partkey % 12 as string",
        "if(l_partkey % 101 = 0, null, 5) as expected", "if(l_partkey % 3 > 0, l_partkey % 102, null) as fret",
    )
    return E.check_edits(e, "request", "fret")


EDIT_NOTES = "l_orderkey, cast(l_suppkey % 2 as int) as string, item as beat, units % 3 = 0 as tie, l_partkey % 7 as fret"
CHAIN_SQL = f"""en0 as (select {EDIT_NOTES} from ({ITEMS_SQL})), en1 as (select *, case when not tie or lag(beat) over w is null or beat <> lag(beat) over w + 1 then 1 else 0 end as st from en0 window w as (partition by l_orderkey, string order by beat)),
  en2 as (select *, sum(st) over (partition by l_orderkey, string order by beat) as chain from en1), en as (select * exclude (fret, st), first_value(fret) over (partition by l_orderkey, string, chain order by beat) as fret from en2)"""


def edit_notes(spark, folder):
    """Notes whose tied chains hold one fret, as a repaired song does."""
    return edit_note_line(spark, folder).df


def edit_note_line(spark, folder):
    line = item_line(spark, folder)
    n = line.df.selectExpr("l_orderkey", "cast(l_suppkey % 2 as int) as string", "item as beat", "units % 3 = 0 as tie", "l_partkey % 7 as fret")
    chained = E.tied_chains(n, ["l_orderkey", "string"], "beat", "tie", like=line)
    chains = ordered(chained, ["l_orderkey", "string", "chain"], ["beat"], like=line).add(_first=total_min(F.struct("beat", "fret"))).df
    one_fret = keyed(chains, ["l_orderkey", "string"]).withColumn("fret", F.col("_first")["fret"]).drop("_first")
    return Ordered(one_fret, line.keys, ["string", "beat"], line.cuts)


@query("tied_chains", f"with {CHAIN_SQL} select l_orderkey, string, beat, cast(chain as bigint) as chain, fret from en")
def tied_chains(spark, folder):
    return edit_notes(spark, folder).select("l_orderkey", "string", "beat", "chain", "fret")


@query(
    "repair_ties",
    f"""with n as (select {EDIT_NOTES} from ({ITEMS_SQL})) select l_orderkey, string, beat, first_value(fret) over (partition by l_orderkey, string, origin order by beat) as fret_repaired
    from (select *, count(*) filter (not tie) over (partition by l_orderkey, string order by beat) as origin from n)""",
)
def repair_ties(spark, folder):
    n = items(spark, folder).selectExpr("l_orderkey", "cast(l_suppkey % 2 as int) as string", "item as beat", "units % 3 = 0 as tie", "l_partkey % 7 as fret")
    return E.repair_ties(n, ["l_orderkey", "string"], "beat", "tie", "fret").select("l_orderkey", "string", "beat", "fret_repaired")


# One request an order: two edits of notes the item numbers pick; every fourth order expects a wrong fret.
@query(
    "apply_note_edits",
    f"""with {CHAIN_SQL}, e as (select l_orderkey, string, beat, chain, fret as now, fret + case when l_orderkey % 4 = 0 and beat = 2 then 1 else 0 end as ex0, case when l_orderkey % 3 = 0 then null else fret + 2 + case when l_orderkey % 11 = 0 then 30 else 0 end end as new, beat as seq from en where beat in (0, 2)),
    s as (select *, lag(struct_pack(f := new)) over (partition by l_orderkey, string, chain order by seq) as lf from e),
    g as (select *, coalesce((case when lf is null then now else lf.f end) = ex0, false) and (new is null or new <= 30) as good from s), r as (select l_orderkey, bool_and(good) as ok from g group by 1),
    t as (select g.l_orderkey, string, chain, max_by(struct_pack(f := new), seq) as t from g join r on r.l_orderkey = g.l_orderkey and ok group by 1, 2, 3)
    select en.l_orderkey, en.string, en.beat, case when t.t is null then fret else t.t.f end as fret from en left join t on t.l_orderkey = en.l_orderkey and t.string = en.string and t.chain = en.chain where t.t is null or t.t.f is not null""",
)
def apply_note_edits(spark, folder):
    line = edit_note_line(spark, folder)
    n = checkpoint(line.df.drop("chain"))  # read for the notes and for the edits
    e = n.where("beat in (0, 2)").selectExpr(
        "l_orderkey", "l_orderkey as request", "string", "beat", "beat as seq", "fret + if(l_orderkey % 4 = 0 and beat = 2, 1, 0) as expected",
        "if(l_orderkey % 3 = 0, null, fret + 2 + if(l_orderkey % 11 = 0, 30, 0)) as fret",
    )
    after, _ = E.apply_note_edits(n, e, ORDER, "string", "beat", "tie", "fret", "request", "seq", like=line)
    return after.select("l_orderkey", "string", "beat", "fret")


# Request r of an order edits note r and, where it is there, note r + 1; both expect the frets the song had at first.
REQUEST_SQL = f"""{CHAIN_SQL}, ec as (select *, dense_rank() over (partition by l_orderkey order by string, chain) as cid from en),
  e as (select a.l_orderkey, a.beat as r, a.cid as c0, a.fret as x0, case when (a.l_orderkey + a.beat) % 5 = 0 then null else a.fret + 2 + case when a.l_orderkey % 11 = 0 and a.beat = 2 then 30 else 0 end end as n0,
    b.cid as c1, b.fret + case when a.l_orderkey % 7 = 0 and a.beat % 2 = 0 then 1 else 0 end as x1, b.fret + 1 as n1 from ec a left join ec b on b.l_orderkey = a.l_orderkey and b.beat = a.beat + 1),
  s(l_orderkey, r, frets, reason) as (select l_orderkey, cast(-1 as bigint), list(fret order by cid), cast(null as varchar) from (select distinct l_orderkey, cid, fret from ec) group by 1 union all
    select l_orderkey, r, case when reason is null then f2 else frets end, reason from (select *, case when frets[c0] is distinct from x0 then 'gone' when n0 > 30 then 'fret' when c1 is null then null when f1[c1] is distinct from x1 then 'gone' end as reason,
        case when c1 is null then f1 else list_transform(range(1, len(f1) + 1), lambda i: case when i = c1 then n1 else f1[i] end) end as f2
      from (select e.*, s.frets, list_transform(range(1, len(s.frets) + 1), lambda i: case when i = e.c0 then e.n0 else s.frets[i] end) as f1 from s join e on e.l_orderkey = s.l_orderkey and e.r = s.r + 1))),
  z as (select l_orderkey, max_by(frets, r) as frets from s group by 1)"""


def note_requests_applied(spark, folder):
    n = checkpoint(edit_notes(spark, folder).drop("chain"))  # read for the notes and for both edits
    own = n.selectExpr(
        "l_orderkey", "beat as request", "0 as seq", "string", "beat", "fret as expected",
        "if((l_orderkey + beat) % 5 = 0, null, fret + 2 + if(l_orderkey % 11 = 0 and beat = 2, 30, 0)) as fret",
    )
    next_ = n.where("beat > 0").selectExpr(
        "l_orderkey", "beat - 1 as request", "1 as seq", "string", "beat", "fret + if(l_orderkey % 7 = 0 and (beat - 1) % 2 = 0, 1, 0) as expected", "fret + 1 as fret",
    )
    return E.apply_requests(n, own.unionByName(next_), ORDER, "string", "beat", "tie", "fret", "request", "seq")


@query("note_requests", f"with recursive {REQUEST_SQL} select l_orderkey, r as request, reason from s where r >= 0")
def note_requests(spark, folder):
    return note_requests_applied(spark, folder)[1]


@query("requested_notes", f"with recursive {REQUEST_SQL} select ec.l_orderkey, string, beat, z.frets[cid] as fret from ec join z using (l_orderkey) where z.frets[cid] is not null")
def requested_notes(spark, folder):
    return note_requests_applied(spark, folder)[0].select("l_orderkey", "string", "beat", "fret")


@query("emptied_beats", f"with recursive {REQUEST_SQL} select ec.l_orderkey, beat from ec join z using (l_orderkey) where z.frets[cid] is null")
def emptied_beats(spark, folder):
    return note_requests_applied(spark, folder)[2]


LENGTH_SQL = f"""b0 as (select l_orderkey, item // 5 as bar, item % 5 as beat, 4 + 2 * (units % 3) as units, l_partkey % 3 = 0 as rest from ({ITEMS_SQL}))"""


@query(
    "length_edits",
    f"""with {LENGTH_SQL}, s as (select *, sum(case when rest then 0 else 1 end) over (partition by l_orderkey, bar) as p, sum(case when rest then 0 else 1 end) over (partition by l_orderkey, bar order by beat) as sn from b0),
    t as (select *, rest and sn = p as trail from s), e as (select l_orderkey, bar, units as ex, 10 as nw from b0 where beat = 0),
    j as (select t.l_orderkey, t.bar, sum(case when not trail or beat = 0 then case when beat = 0 then nw else units end else 0 end) as total from t join e on e.l_orderkey = t.l_orderkey and e.bar = t.bar group by 1, 2)
    select l_orderkey, bar, total <= 32 as applied, cast(case when total > 32 then total - 32 end as bigint) as missing_units from j""",
)
def length_edits(spark, folder):
    b = items(spark, folder).selectExpr("l_orderkey", "item div 5 as bar", "item % 5 as beat", "4 + 2 * (units % 3) as units", "l_partkey % 3 = 0 as rest")
    e = b.where("beat = 0").selectExpr("l_orderkey", "bar", "beat", "units as expected", "10 as new_units")
    return E.apply_length_edits(b, e, ["l_orderkey", "bar"], "beat", "units", "rest", 32)[1]


@query(
    "length_edited_beats",
    f"""with {LENGTH_SQL}, s as (select *, sum(case when rest then 0 else 1 end) over (partition by l_orderkey, bar) as p, sum(case when rest then 0 else 1 end) over (partition by l_orderkey, bar order by beat) as sn from b0),
    t as (select *, rest and sn = p and beat > 0 as trail, case when beat = 0 then 10 else units end as nu from s),
    j as (select l_orderkey, bar, sum(case when trail then 0 else nu end) as total, list(nu order by beat) filter (not trail) as kept, list(units order by beat) as same from t group by 1, 2)
    select l_orderkey, bar, array_to_string(case when total > 32 then same else kept || list_filter([16, 8, 4, 2, 1], lambda v: (cast(32 - total as int) & v) > 0) end, ' ') as beats from j""",
)
def length_edited_beats(spark, folder):
    b = items(spark, folder).selectExpr("l_orderkey", "item div 5 as bar", "item % 5 as beat", "4 + 2 * (units % 3) as units", "l_partkey % 3 = 0 as rest")
    e = b.where("beat = 0").selectExpr("l_orderkey", "bar", "beat", "units as expected", "10 as new_units")
    after, _ = E.apply_length_edits(b, e, ["l_orderkey", "bar"], "beat", "units", "rest", 32)
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("beat", "units"))), lambda x: x["units"].cast("string")), " ")
    return after.groupBy("l_orderkey", "bar").agg(line.alias("beats"))


# Bars of five items; request r of a bar gives its beat r another length. Rests that add up are listed by room.
BAR_ITEMS = "l_orderkey, item {div} 5 as bar, item % 5 as beat, case units % 4 when 0 then 480 when 1 then 960 when 2 then 320 else 240 end as ticks, l_partkey % 3 = 0 as rest"
NEW_TICKS = "case (item + units) % 5 when 0 then 320 when 1 then 1440 when 2 then 640 when 3 then 480 else 180 end"
RESTS_SQL = "values " + ", ".join(f"({room}, {v}::int[])" for room, v in E.rests_filling(3840).items())
LENGTH_REQUEST_SQL = f"""b as (select {BAR_ITEMS.format(div="//")}, {NEW_TICKS} as nw, item from ({ITEMS_SQL})), rt(room, rests) as ({RESTS_SQL}),
  e as (select l_orderkey, bar, beat as r, ticks + case when item % 6 = 5 then 120 else 0 end as ex, nw from b where beat < 3),
  s(l_orderkey, bar, r, ts, rs, reason, missing) as (select l_orderkey, bar, cast(-1 as bigint), list(ticks order by beat), list(rest order by beat), cast(null as varchar), cast(null as bigint) from b group by 1, 2 union all
    select l_orderkey, bar, r, case when reason is null then kt || rests else ts end, case when reason is null then kr || list_transform(rests, lambda x: true) else rs end, reason, case when reason = 'full' then -room end
    from (select k.*, rt.rests, case when ts[r + 1] is distinct from ex then 'gone' when k.room < 0 then 'full' when rt.room is null then 'invalid' end as reason from
      (select *, cast(3840 - list_sum(kt) as bigint) as room, list_transform(range(1, keep + 1), lambda i: rs[i]) as kr from
        (select *, list_transform(range(1, keep + 1), lambda i: case when i = r + 1 then nw else ts[i] end) as kt from
          (select s.l_orderkey, s.bar, e.r, ts, rs, ex, nw, greatest(e.r + 1, list_max(list_transform(range(1, len(ts) + 1), lambda i: case when rs[i] then 0 else i end))) as keep
           from s join e on e.l_orderkey = s.l_orderkey and e.bar = s.bar and e.r = s.r + 1))) k left join rt on rt.room = k.room))"""


def length_requests_applied(spark, folder):
    rows = items(spark, folder).selectExpr(*BAR_ITEMS.format(div="div").split(", "), f"{NEW_TICKS} as new_ticks", "item")
    sent = rows.where("beat < 3").selectExpr("l_orderkey", "bar", "beat", "beat as request", "0 as seq", "ticks + if(item % 6 = 5, 120, 0) as expected", "new_ticks")
    return E.apply_length_requests(rows.drop("new_ticks", "item"), sent, ["l_orderkey", "bar"], [], "beat", "ticks", "rest", 3840, "request", "seq")


@query("length_requests", f"with recursive {LENGTH_REQUEST_SQL} select l_orderkey, bar, r as request, reason, missing as missing_ticks from s where r >= 0")
def length_requests(spark, folder):
    return length_requests_applied(spark, folder)[1]


@query(
    "length_requested_beats",
    f"""with recursive {LENGTH_REQUEST_SQL}, z as (select l_orderkey, bar, max_by(ts, r) as ts, max_by(rs, r) as rs from s group by 1, 2), n as (select *, unnest(range(0, len(ts))) as beat from z)
    select l_orderkey, bar, beat, ts[beat + 1] as ticks, rs[beat + 1] as rest from n""",
)
def length_requested_beats(spark, folder):
    return length_requests_applied(spark, folder)[0]


# --- Sources and sinks ---
@query(
    "prepare_glyphs",
    f"""select l_orderkey, gid, case fret % 4 when 0 then '-' when 1 then '-' else fret::varchar end as text, (x0 + x1) / 2 as xc, (top + bottom) / 2 as yc, units % 3 = 0 as bold, units % 3 = 1 as italic from ({GLYPH_SQL}) where fret % 7 > 0""",
)
def prepare_glyphs(spark, folder):
    g = glyphs(spark, folder).withColumns(
        {"text": F.expr("case when fret % 7 = 0 then ' ' else case fret % 4 when 0 then '–' when 1 then '—' else cast(fret as string) end end"), "font": F.expr("case units % 3 when 0 then 'Arial-Bold' when 1 then 'Arial-Oblique' else 'Arial' end")}
    )
    return G.prepare_glyphs(g).select("l_orderkey", "gid", "text", "xc", "yc", "bold", "italic")


@query(
    "prepare_strokes",
    f"""with s as (select l_orderkey, gid, 1.0 * (units % 4) as w, 1.0 * (fret % 3) as h, units % 2 = 0 as up from ({GLYPH_SQL})), f as (select *, h <= 1 and w > h as horizontal, w <= 1 and h > w as vertical from s)
    select l_orderkey, gid, horizontal, vertical, case when not horizontal and not vertical then up end as rising from f""",
)
def prepare_strokes(spark, folder):
    s = glyphs(spark, folder).selectExpr("l_orderkey", "gid", "0.0D as x0", "1.0D * (units % 4) as x1", "0.0D as top", "1.0D * (fret % 3) as bottom", "units % 2 = 0 as rising")
    return G.prepare_strokes(s).select("l_orderkey", "gid", "horizontal", "vertical", "rising")


KINDS = {"0": ("ffd8ff00", "jpeg"), "1": ("89504e470d0a1a0a00", "png"), "2": ("4f67675300", "ogg"), "3": ("524946460000000057415645", "wav"), "4": ("504b030400", "gp"), "5": ("4243465a", "gpx"), "6": ("000000255044462d31", "pdf"), "7": ("18" + b"FICHIER GUITAR PRO v5.10".hex(), "gp5"), "8": ("0011", None)}


@query(
    "sniff",
    "select doc_id, case doc_id % 9 " + " ".join(f"when {k} then '{t}'" for k, (_, t) in KINDS.items() if t) + " end as type from documents",
)
def sniff(spark, folder):
    hexes = "case doc_id % 9 " + " ".join(f"when {k} then '{h}'" for k, (h, _) in KINDS.items()) + " end"
    body = F.concat(F.unhex(F.expr(hexes)), F.encode("text", "UTF-8"))
    return table(spark, folder, "documents").select("doc_id", S.sniff(body).alias("type"))


@query(
    "flatten_results",
    """select doc_id, 0 as rank, 'abcDEF' || (10000 + doc_id) as id, left(source || ' & ''x''', 200) as title, lang as channel from documents where doc_id % 3 > 0 and doc_id < 90000 union all
    select doc_id, 2, 'ABCDEF' || (10000 + doc_id), '', '' from documents where doc_id % 3 > 0 and doc_id < 90000""",
)
def flatten_results(spark, folder):
    json = F.expr(
        "case when doc_id % 3 = 0 then '{\"items\": 5' else concat('{\"items\": [{\"id\": {\"videoId\": \"abcDEF', 10000 + doc_id, '\"}, \"snippet\": {\"title\": \"', source, ' &amp; &#39;x&#39;\", \"channelTitle\": \"', lang, '\"}}, {\"id\": {\"videoId\": \"no\"}}, {\"id\": {\"videoId\": \"ABCDEF', 10000 + doc_id, '\"}}]}') end"
    )
    return S.flatten_results(table(spark, folder, "documents").select("doc_id", json.alias("json")), ["doc_id"], "json")


@query("read_records", "select event_id, cast(json_extract(props, '$.k') as bigint) as k from events where event_id % 4 > 0")
def read_records(spark, folder):
    e = events(spark, folder).withColumn("json", F.expr("case event_id % 4 when 0 then concat(props, '{') else props end"))
    e = e.withColumn("json", F.expr("if(event_id % 4 = 0 and event_id % 8 = 0, '{\"z\": 1}', if(event_id % 4 = 0, '{\"k\"', json))"))
    return S.read_records(e.select("event_id", "json"), "json", "k long", "k").select("event_id", "k")


NOTE_LINES = """select o_custkey, cast(bar * 5 + i as int) as line_no, case i when 0 then case when o_orderkey % 7 = 0 then '## [Unreleased]' else '## [1.' || bar || '.' || (o_orderkey % 4) || '] - 2024-01-02' end when 1 then '### ' || o_orderpriority || ' '
  when 2 then '- item ' || o_orderkey when 3 then case when o_orderkey % 3 = 0 then '  more of it' else '' end else '- ' || o_orderstatus end as line from """
RELEASES_SQL = f"""rl as (select o_custkey, '1.' || bar || '.' || (o_orderkey % 4) as version, '2024-01-02' as date, rtrim(o_orderpriority) as section, bar * 5 as b, o_orderkey, o_orderstatus from ({BARS_SQL}) where o_orderkey % 7 > 0),
  ri as (select o_custkey, version, date, section, b + 2 as item_no, 'item ' || o_orderkey || case when o_orderkey % 3 = 0 then ' more of it' else '' end as item from rl union all select o_custkey, version, date, section, b + 4, o_orderstatus from rl)"""


def releases(spark, folder):
    b = bars(spark, folder).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(4))))
    line = F.expr(
        "case i when 0 then if(o_orderkey % 7 = 0, '## [Unreleased]', concat('## [1.', bar, '.', o_orderkey % 4, '] - 2024-01-02')) when 1 then concat('### ', o_orderpriority, ' ') "
        "when 2 then concat('- item ', o_orderkey) when 3 then if(o_orderkey % 3 = 0, '  more of it', '') else concat('- ', o_orderstatus) end"
    )
    lines = b.select("o_custkey", (F.col("bar") * 5 + F.col("i")).cast("int").alias("line_no"), line.alias("line"))
    return S.release_sections(lines, CUST, "line_no", "line")


@query("release_sections", f"with {RELEASES_SQL} select * from ri")
def release_sections(spark, folder):
    return releases(spark, folder)


@query(
    "shape_diff",
    f"""with {RELEASES_SQL}, r as (select *, case when o_custkey % 2 = 0 then 'a' else 'b' end as lang from ri), c as (select version, section, count(*) filter (lang = 'a') as base_items, count(*) filter (lang = 'b') as other_items from r group by 1, 2) select * from c where base_items <> other_items""",
)
def shape_diff(spark, folder):
    from ..operators.quality import shape_diff as diff

    r = releases(spark, folder).withColumn("lang", F.expr("if(o_custkey % 2 = 0, 'a', 'b')"))
    return diff(r, "lang", "a", "b", "version", "section")


@query("unseen_releases", f"with {RELEASES_SQL} select distinct o_custkey, version from ri where (cast(string_split(version, '.')[2] as int), cast(string_split(version, '.')[3] as int)) > (9, 2)")
def unseen_releases(spark, folder):
    from ..operators.quality import unseen_releases as unseen

    return unseen(releases(spark, folder).select("o_custkey", "version").distinct(), "version", F.lit("1.9.2"))


RULES_SQL = "case when o_totalprice > 450000 then 'size' when o_orderkey % 97 = 0 then 'pages' end"


@query(
    "quarantine",
    f"""with s as (select o_custkey, sum(cast(o_totalprice as bigint)) as t from (select o_custkey, floor(o_totalprice) as o_totalprice from orders) group by 1), r as (select o_orderkey, o_custkey, {RULES_SQL} as reason from orders)
    select o_orderkey, coalesce(reason, case when t > 4000000 then 'total' end, 'accepted') as verdict from r join s using (o_custkey)""",
)
def quarantine(spark, folder):
    o = table(spark, folder, "orders").withColumn("size", F.floor("o_totalprice").cast("long"))
    rules = [("size", F.col("o_totalprice") > 450000), ("pages", F.col("o_orderkey") % 97 == 0)]
    good, bad = S.quarantine(o, CUST, rules, "size", 4000000)
    return good.select("o_orderkey", F.lit("accepted").alias("verdict")).unionByName(bad.select("o_orderkey", F.col("reason").alias("verdict")))


@query(
    "nested_report",
    f"""with t as (select l_orderkey, track, count(*) as bars, sum(units)::bigint as units from ({TRACKS_SQL}) group by 1, 2) select l_orderkey, count(*)::bigint as n, string_agg(track || ':' || bars || ':' || units, ',' order by track) as tracks from t group by 1""",
)
def nested_report(spark, folder):
    t = track_bars(spark, folder).groupBy("l_orderkey", "track").agg(F.count("*").alias("bars"), F.sum("units").alias("units"))
    songs = t.groupBy("l_orderkey").agg(F.count("*").alias("n"))
    report = K.nested_report(songs, t, ORDER, "track")
    flat = F.array_join(F.transform("tracks", lambda r: F.concat_ws(":", r["track"], r["bars"], r["units"])), ",")
    return report.select("l_orderkey", "n", flat.alias("tracks"))


PREVIEW_SQL = f"""n as (select l_orderkey, item // 4 as bar, item % 4 as beat, 1 + cast(l_suppkey % 3 as int) as string, case when l_partkey % 9 = 0 then 'x' when l_partkey % 8 = 0 then '<' || (l_partkey % 25) || '>' when l_partkey % 7 = 0 then '(' || (l_partkey % 25) || ')' else '' || (l_partkey % 25) end
    || case when l_partkey % 9 = 0 then '' else case when l_partkey % 5 = 0 then 'b' else '' end || case when l_partkey % 4 = 0 then '~' else '' end end as cell, units % 6 = 0 as rest, l_orderkey % 3 = 0 as opens, case when l_orderkey % 2 = 0 then 3 else 0 end as closes from ({ITEMS_SQL})),
  w as (select *, case when rest then 'q' else 'Q' end as mark, cast(greatest(3, case when rest then 0 else length(cell) end + 1) as int) as w, max(beat) over (partition by l_orderkey, bar) as lb from n),
  r as (select w.*, s from w, (select unnest(range(4)) as s))"""


@query(
    "render_preview",
    f"""with {PREVIEW_SQL} select l_orderkey, bar // 4 as line, cast(s as int) as string, string_agg(case when beat = 0 and opens then case when s = 0 then ' ' else ':' end else '' end
      || case when s = 0 then ' ' || rpad(mark, w - 1, ' ') else '-' || rpad(case when s = string and not rest then cell else '' end, w - 1, '-') end
      || case when beat < lb then '' when closes > 0 then case when s = 0 then ' x3' else '-:|' end when s = 0 then '  ' else '-|' end, '' order by bar, beat) as text from r group by 1, 2, 3""",
)
def render_preview(spark, folder):
    i = items(spark, folder).selectExpr(
        "l_orderkey", "item div 4 as bar", "item % 4 as beat", "1 + cast(l_suppkey % 3 as int) as string", "l_partkey % 25 as fret", "l_partkey", "8 as units", "units % 6 = 0 as is_rest",
        "l_orderkey % 3 = 0 as opens", "if(l_orderkey % 2 = 0, 3, 0) as closes",
    )
    p = F.col("l_partkey")
    cell = K.note_cell(F.col("fret"), p % 9 == 0, p % 7 == 0, p % 8 == 0, p % 5 == 0, p % 4 == 0)
    return K.render_preview(i, i.where("not is_rest").withColumn("cell", cell), ORDER, 3)


@query(
    "export_catalog",
    f"""with {CAT_SQL}, ch as (select o_orderkey as ord, o_custkey as c_custkey from orders where o_orderkey % 9 = 0), f as (select c_custkey, min(ord) as ord from ch group by 1)
    select cat.c_custkey, ord, 'c.jpg' as files from cat join f using (c_custkey)""",
)
def export_catalog(spark, folder):
    c = catalog(spark, folder).withColumn("files", F.create_map(F.lit("cover"), F.lit("c.jpg"), F.lit("audio"), F.lit("a.mp3")))
    chosen = table(spark, folder, "orders").where("o_orderkey % 9 = 0").selectExpr("o_orderkey as ord", "o_custkey as c_custkey")
    songs, _ = K.export_catalog(c, chosen, "c_custkey", "ord")
    return songs.select("c_custkey", "ord", F.array_join(F.map_values("files"), ",").alias("files"))


@query(
    "file_bars",
    f"""with b as (select l_orderkey, item, 3840 * (2 + units % 3) // 4 as len, units % 40 as times, 1 + l_partkey % 9 as e from ({ITEMS_SQL}))
    select l_orderkey, item, cast(coalesce(sum(len) over (partition by l_orderkey order by item rows between unbounded preceding and 1 preceding), 0) + 960 as bigint) as start_tick,
      cast(case when times >= 2 then least(times, 32) - 1 else -1 end as int) as extra_passes, cast(case when e <= 8 then pow(2, e - 1) else 0 end as int) as volta_bits from b""",
)
def file_bars(spark, folder):
    b = items(spark, folder).selectExpr("l_orderkey", "item", "2 + units % 3 as num", "4 as den", "cast(units % 40 as int) as times", "array(cast(1 + l_partkey % 9 as int)) as endings")
    return K.file_bars(b, ORDER, "item", "num", "den", "times", "endings").select("l_orderkey", "item", "start_tick", "extra_passes", "volta_bits")


@query(
    "file_beats",
    f"""select l_orderkey, item, case units when 48 then 1 when 32 then 1 when 24 then 2 when 16 then 2 when 12 then 4 when 8 then 4 when 6 then 8 when 4 then 8 when 3 then 16 when 2 then 16 when 1 then 32 end as value,
      case when units in (48, 24, 12, 6, 3) then true when units in (32, 16, 8, 4, 2, 1) then false end as dotted, case when l_partkey % 9 = 0 then 'dead' when l_partkey % 4 = 0 then 'tie' else 'normal' end as kind from ({ITEMS_SQL})""",
)
def file_beats(spark, folder):
    i = items(spark, folder).selectExpr("l_orderkey", "item", "units", "l_partkey % 9 = 0 as dead", "l_partkey % 4 = 0 as tie")
    return K.file_notes(K.file_beats(i, "units"), ORDER, "dead", "tie").select("l_orderkey", "item", "value", "dotted", "kind")


@query(
    "file_tracks",
    f"""with t as (select l_orderkey, track, greatest(24, max(l_partkey % 31)) as fret_count, row_number() over (partition by l_orderkey order by track) as no from ({TRACKS_SQL}) group by 1, 2)
    select l_orderkey, track, fret_count, no, case when 2 * (no - 1) < 9 then 2 * (no - 1) else 2 * no - 1 end as channel, case when 2 * no - 1 < 9 then 2 * no - 1 else 2 * no end as effect_channel from t""",
)
def file_tracks(spark, folder):
    t = track_bars(spark, folder).withColumn("fret", F.col("l_partkey") % 31)
    return K.file_tracks(t.select("l_orderkey", "track").distinct(), t, ORDER, "track", "fret")


@query("file_text", "select doc_id, left(trim(regexp_replace(text, '[^\\x20-\\x7e -¬®-ÿ€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]', '', 'g')), 100) as text from documents")
def file_text(spark, folder):
    return table(spark, folder, "documents").select("doc_id", K.file_text(F.col("text")).alias("text"))
