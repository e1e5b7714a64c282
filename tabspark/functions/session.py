"""Session settings the library reads."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SPLIT_ROWS = "spark.tabspark.splitRows"
DEFAULT_SPLIT_ROWS = 1 << 20


def split_rows(spark: SparkSession) -> int:
    """Mean rows of one chunk when the rows of a key are cut for a scan."""
    return int(spark.conf.get(SPLIT_ROWS, str(DEFAULT_SPLIT_ROWS)))


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder of ``spark.checkpoint.dir``, by a compressed table where types allow.

    The rows are computed once; Spark's own checkpoint computes the last stage twice and stores rows uncompressed.
    Only a local master may fall back on a folder of its own: on a cluster executors do not share it.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="tabspark-checkpoint-")
        sc.setCheckpointDir(folder)
    types = df.schema.simpleString()
    if "void" in types or "interval" in types or len({c.lower() for c in df.columns}) < len(df.columns):
        return df.checkpoint()
    path = f"{sc.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
