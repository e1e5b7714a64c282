"""Helpers the operators share: tables, stored intermediates, skew-safe joins, words of long texts."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function (spark, sf_dir) -> DataFrame, and the SQL that gives the same rows."""

    def register(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder name inside ``spark.checkpoint.dir``; a local master without that setting gets a folder of its own."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if top is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        top = f"file://{tempfile.mkdtemp(prefix='tabspark-llm-')}"
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top}/llm-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """The rows as a compressed table in the shared folder: lineage is cut, and lost executors lose nothing."""
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.option("compression", "zstd").parquet(path)
    # Spark drops shuffle files once the driver has collected their plans as garbage; a long job should not wait for that.
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


#: A key is hot if it has at least this share of the rows; so there are no more hot keys than HOT_SHARE.
HOT_SHARE = 500
SALTS = 64


def salted_join(
    left: DataFrame, right: DataFrame, key: str, how: str = "inner", counts: DataFrame | None = None, total: int | None = None
) -> DataFrame:
    """``left`` with the one row that ``right`` has for each key; hot keys of ``left`` are spread over salted copies.

    The hot keys are those with 1/HOT_SHARE of the rows of ``left`` or more: at most HOT_SHARE keys, so their list
    may be broadcast. Null keys match nothing. ``counts`` (key, _n) and ``total`` spare a reading of ``left``, which
    should be a stored table else; a larger ``total`` only makes fewer keys hot.
    """
    if counts is None:
        counts = stored(left.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n")))
    if total is None:
        total = counts.agg(F.sum("_n")).first()[0] or 0
    hot = F.broadcast(
        counts.where(F.col("_n") >= max(2, total // HOT_SHARE)).select(F.col(key).alias("_k"), F.lit(True).alias("_hot"))
    )
    spread = left.join(hot, F.col(key) == F.col("_k"), "left").drop("_k")
    mixed = F.pmod(F.xxhash64(*spread.drop("_hot").columns), F.lit(SALTS)).cast("int")
    spread = spread.withColumn("_salt", F.when(F.col("_hot"), mixed).otherwise(0)).drop("_hot")
    copies = right.join(hot, F.col(key) == F.col("_k"), "left").drop("_k")
    salts = F.when(F.col("_hot"), F.array(*[F.lit(i) for i in range(SALTS)])).otherwise(F.array(F.lit(0)))
    copies = copies.withColumn("_salt", F.explode(salts)).drop("_hot")
    # Both sides grow with the data, so neither may be broadcast.
    return spread.join(copies.hint("merge"), [key, "_salt"], how).drop("_salt")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): the smallest id that each end of an edge can reach.

    Alternates star contractions: every node passes its neighbours on to its smallest neighbour. Edges live in
    stored tables between rounds; joins spread hubs over salts; rounds grow with the logarithm of a path's length.
    """
    low, high = F.least(a, b), F.greatest(a, b)
    now = stored(edges.select(high.alias("u"), low.alias("v")).where("u <> v").distinct())
    before = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or state[0] == 0:
            return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
                now.select(F.col("v").alias("id"), F.col("v").alias("component"))
            ).groupBy("id").agg(F.min("component").alias("component"))
        before = state
        rows = 2 * state[0]
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("_n")))
        passed = salted_join(both, least.drop("_n"), "u", counts=least.drop("m"), total=rows).where("v > u")
        large = stored(passed.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        least = stored(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("_n")))
        small = salted_join(large, least.drop("_n"), "u", counts=least.drop("m"), total=rows)
        ends = F.explode(F.array("v", "u")).alias("v")
        now = stored(small.select(F.col("m").alias("u"), ends).where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())


def bitmap(rows: DataFrame, hashes: str, bits: int) -> np.ndarray:
    """2**bits bits, set at the first bits of the hashes: at most 2**(bits - 6) rows reach the driver."""
    place = F.shiftrightunsigned(hashes, 64 - bits)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int"))
    words = rows.groupBy((place / 64).cast("long").alias("w")).agg(F.bit_or(bit).alias("b")).toPandas()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[words["w"].to_numpy(np.int64)] = words["b"].to_numpy(np.int64).view(np.uint64)
    return out


def in_bitmap(words: np.ndarray, bits: int, hashes: np.ndarray) -> np.ndarray:
    """Which hashes may be in the bitmap: all that are, and a few others."""
    place = hashes.view(np.uint64) >> np.uint64(64 - bits)
    return ((words[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1)).astype(bool)


#: Longer texts are cut into words piece by piece.
LONG_TEXT = 1 << 20


def word_runs(pattern, text: str, size: int = 1 << 17) -> Iterator[list[str]]:
    """The matches of a pattern, in order, as lists; a long text never has all its words in memory."""
    if len(text) <= LONG_TEXT:
        yield pattern.findall(text)
        return
    run: list[str] = []
    for m in pattern.finditer(text):
        run.append(m.group())
        if len(run) == size:
            yield run
            run = []
    yield run


def light_batches(texts: Sequence[str], chars: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """(from, to) of consecutive texts with about so many letters together."""
    begin = n = 0
    for i, t in enumerate(texts):
        n += len(t)
        if n >= chars:
            yield begin, i + 1
            begin, n = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)
