"""Text tabs rendered from order lines: one order is a song, sixteen order lines a system of six strings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ordered import Ordered
from .tables import ITEMS_SQL, item_line

PER_SYSTEM = 16
# One written mark per order line; code = l_partkey % 13 picks its technique (valid in Spark SQL and DuckDB).
_F = "cast(l_partkey % 25 as string)"
_F2 = "cast(l_partkey % 25 + 2 as string)"
MARK = rf"""case l_partkey % 13
  when 1 then concat('(', {_F}, ')') when 2 then concat('<', {_F}, '>') when 3 then 'x'
  when 4 then concat({_F}, '~') when 5 then concat('h', {_F}) when 6 then concat('p', {_F})
  when 7 then concat('/', {_F}) when 8 then concat({_F}, '/') when 9 then concat({_F}, 'b', {_F2}, 'r', {_F})
  when 10 then concat('t', {_F}) when 11 then concat({_F}, '/', {_F2}) when 12 then concat({_F}, 'pb', {_F2})
  else {_F} end"""
CELL = "concat('-', case when l_suppkey % 6 = s then mark else repeat('-', cast(length(mark) as int)) end, '-', case when item % 4 = 3 then '|' else '' end)"
HEAD = "concat(substr('eBGDAE', s + 1, 1), '|', case when l_orderkey % 5 = 0 and s in (1, 4) then ':' else '-' end)"
TAIL = "concat(case when l_orderkey % 5 = 0 and s in (1, 4) then ':' else '-' end, '|', case when l_orderkey % 7 = 0 then concat('   x', cast(2 + l_orderkey % 3 as string)) else '' end)"

TAB_SQL = f"""select l_orderkey, sys, cast(sys * 8 + s as int) as line_no, {HEAD} || body || {TAIL} as line from (
  select l_orderkey, cast(floor(item / {PER_SYSTEM}.0) as int) as sys, s, string_agg({CELL}, '' order by item) as body
  from (select *, {MARK} as mark from ({ITEMS_SQL})), (select unnest(range(6)) as s) group by 1, 2, 3)"""


def tab_lines(spark: SparkSession, folder: str, line: Ordered | None = None) -> DataFrame:
    """(l_orderkey, sys, line_no, line): six lines a system, a free line number between systems."""
    marks = (line or item_line(spark, folder)).df.selectExpr("l_orderkey", "item", "l_suppkey % 6 as own", f"{MARK} as mark")
    # Both forms of a cell are made here, once; its six strings only choose one.
    end = "case when item % 4 = 3 then '-|' else '-' end"
    cell = f"struct(item, own, concat('-', mark, {end}) as mark, concat('-', repeat('-', length(mark)), {end}) as rest) as c"
    marks = marks.selectExpr("l_orderkey", f"cast(floor(item / {PER_SYSTEM}) as int) as sys", cell)
    systems = marks.groupBy("l_orderkey", "sys").agg(F.array_sort(F.collect_list("c")).alias("cells"))  # the marks once, not per string
    chosen = "transform(cells, x -> case when x.own = s then x.mark else x.rest end)"
    # The six lines come out of the explode: each is put together once, however often a filter behind looks at it.
    six = f"transform(sequence(0, 5), s -> struct(s, concat({HEAD}, array_join({chosen}, ''), {TAIL}) as line))"
    rows = systems.select("l_orderkey", "sys", F.explode(F.expr(six)).alias("p")).selectExpr("l_orderkey", "sys", "p.s as s", "p.line as line")
    return rows.selectExpr("l_orderkey", "sys", "cast(sys * 8 + s as int) as line_no", "line")
