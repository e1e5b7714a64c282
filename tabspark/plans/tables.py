"""Inputs of the registered queries, derived from the given tables (DataFrame and SQL form of each)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ordered import Ordered, number, ordered


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# One beat per order line, numbered from 0 in a total order inside the order.
ITEM_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]
ITEMS_SQL = f"""select l_orderkey,
  row_number() over (partition by l_orderkey order by {", ".join(ITEM_ORDER)}) - 1 as item,
  cast(l_quantity as int) as units, l_partkey, l_suppkey, l_extendedprice, l_returnflag, l_linestatus
  from lineitem"""


def item_line(spark: SparkSession, folder: str) -> Ordered:
    """The numbered order lines, and whether an order is large: what is derived from them need not look again."""
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey", *ITEM_ORDER, F.col("l_quantity").cast("int").alias("units"), "l_returnflag", "l_linestatus"
    )
    numbered = ordered(lines, ["l_orderkey"], ITEM_ORDER).add(item=number())
    rows = numbered.df.select(
        "l_orderkey",
        (F.col("item") - 1).alias("item"),
        "units",
        "l_partkey",
        "l_suppkey",
        "l_extendedprice",
        "l_returnflag",
        "l_linestatus",
    )
    return Ordered(rows, ["l_orderkey"], ["item"], numbered.cuts)


def items(spark: SparkSession, folder: str) -> DataFrame:
    return item_line(spark, folder).df


def micros(name: str):
    """A zone-less time as whole microseconds, the same in every session time zone."""
    return F.unix_micros(F.from_utc_timestamp(F.col(name).cast("timestamp"), F.current_timezone()))


# Events with their time as whole microseconds and seconds.
EVENTS_SQL = """select event_id, user_id, event_type, value, props, epoch_us(ts) as us,
  epoch_us(ts) / 1000000.0 as sec from events"""


def events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        "event_id",
        "user_id",
        "event_type",
        "value",
        "props",
        micros("ts").alias("us"),
        (micros("ts") / F.lit(1000000.0)).alias("sec"),
    )


# Bars of a customer: its orders in date order, numbered from 0.
BARS_SQL = """select o_custkey, o_orderkey, o_orderstatus, o_totalprice, o_orderpriority, epoch_us(o_orderdate) as us,
  row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) - 1 as bar from orders"""


def bars(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select(
        "o_custkey",
        "o_orderkey",
        "o_orderstatus",
        "o_totalprice",
        "o_orderpriority",
        micros("o_orderdate").alias("us"),
    )
    numbered = ordered(orders, ["o_custkey"], ["us", "o_orderkey"]).add(bar=number()).df
    return numbered.withColumn("bar", F.col("bar") - 1)


# Lines of the documents, numbered from 0.
LINES_SQL = """select doc_id, cast(i as int) as line_no, line from (
  select doc_id, unnest(string_split(text, chr(10))) as line,
  generate_subscripts(string_split(text, chr(10)), 1) - 1 as i from documents)"""


def doc_lines(spark: SparkSession, folder: str) -> DataFrame:
    from ..sources.text import explode_lines

    return explode_lines(table(spark, folder, "documents"), ["doc_id"], "text")


# Glyphs laid out from order lines: one page of an order holds its marks left to right.
GLYPH_SQL = f"""select l_orderkey, item as gid,
  cast(l_suppkey % 3 as int) as lane,
  cast(item * 10.0 + (l_partkey % 40) * 0.25 as double) as x0,
  cast(item * 10.0 + (l_partkey % 40) * 0.25 + 2.0 + (l_suppkey % 9) as double) as x1,
  cast((l_suppkey % 6) * 6.0 + (l_partkey % 5) * 0.5 as double) as top,
  cast((l_suppkey % 6) * 6.0 + (l_partkey % 5) * 0.5 + 4.0 + (units % 4) as double) as bottom,
  cast(l_partkey % 25 as int) as fret, cast(l_suppkey % 6 as int) as string, units
  from ({ITEMS_SQL})"""


def glyph_line(spark: SparkSession, folder: str) -> Ordered:
    line = item_line(spark, folder)
    rows = line.df.selectExpr(
        "l_orderkey",
        "item as gid",
        "cast(l_suppkey % 3 as int) as lane",
        "item * 10.0D + (l_partkey % 40) * 0.25D as x0",
        "item * 10.0D + (l_partkey % 40) * 0.25D + 2.0D + (l_suppkey % 9) as x1",
        "(l_suppkey % 6) * 6.0D + (l_partkey % 5) * 0.5D as top",
        "(l_suppkey % 6) * 6.0D + (l_partkey % 5) * 0.5D + 4.0D + (units % 4) as bottom",
        "cast(l_partkey % 25 as int) as fret",
        "cast(l_suppkey % 6 as int) as string",
        "units",
    )
    return Ordered(rows, line.keys, ["gid"], line.cuts)


def glyphs(spark: SparkSession, folder: str) -> DataFrame:
    return glyph_line(spark, folder).df
