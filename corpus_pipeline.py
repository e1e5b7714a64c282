"""The corpus pipeline: documents go through five stages, each stored and read again before the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabspark.llm import bpe, pseudonyms, setsketch, tiling, toxicity
from tabspark.llm.shared import stored, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Columns of documents, kept by all stages but the last.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _with_row_key(docs: DataFrame) -> DataFrame:
    """The documents with ``_row``, a number of its own for each row; stored, so that every later reading has the same ones."""
    return stored(docs.withColumn("_row", F.monotonically_increasing_id()))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones of these, doesn't predict to be toxic.

    Each row is judged by its text alone: null and empty texts by the classifier's bias, repeated rows alike, rows
    without an id like others. Without labels, and for an empty table, nothing is dropped.
    """
    docs = docs.select(*COLUMNS)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.select(docs, model, keep=0)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more): that with the smallest id.

    Rows are compared one by one, whatever their ids: rows without an id come after those with one, equal ids keep the
    row that was read first. Null texts and texts without words are no copies of anything and stay. With 32 bands of 5
    registers a pair at 0.8 is missed with probability 3e-6, (1 - 0.8**5)**32; with the default 20 it would be 3.6e-4.
    """
    rows = _with_row_key(docs.select(*COLUMNS))
    verdicts = setsketch.near_documents(rows.select("_row", "text"), key="_row", width=5, percent=80, registers=160)
    groups = verdicts.select(F.col("doc_id").alias("_row"), "component_id").distinct()
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row"))
    kept = rows.select("_row", "doc_id").join(groups, "_row").groupBy("component_id").agg(first.alias("f")).select(F.col("f._row").alias("_row"))
    return rows.join(kept, "_row", "left_semi").select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no item of the benchmark is found.

    Rows are judged one by one, whatever their ids, null ones included. Null and empty texts hold no item and stay;
    without a benchmark nothing is dropped.
    """
    rows = _with_row_key(docs.select(*COLUMNS))
    found = tiling.matches(rows, table(spark, sf_dir, "benchmark"), key="_row").select(F.col("doc_id").alias("_row")).distinct()
    return rows.join(found, "_row", "left_anti").select(*COLUMNS)


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with pseudonyms for personal data; n_chars follows the text. Null texts stay null, with a null n_chars."""
    return pseudonyms.pseudonymise(docs, count=None).withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with token ids, their number, and whether decoding them gives the text back.

    Null and empty texts have no ids; repeated rows are encoded as often as they are there.
    """
    path = bpe.byte_bpe_path()
    coded = bpe.encode_checked(docs.select("doc_id", "lang", "source", "text"), path)
    return coded.drop("text")


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("pii", pseudonymise),
    ("bpe", tokenise),
]

#: SQL can express neither the classifier nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; every stage is written to the shared folder as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
