"""Near-duplicate documents by SetSketch registers, banding, joint likelihood and exact verification.

A document is its set of distinct word shingles. Each of ``registers`` registers holds the smallest of an exponential
variable over the set on a logarithmic scale, truncated to 16 bits: registers of unions are maxima (``merge``), and two
registers are equal with about the Jaccard similarity as probability. Documents with equal sets form a class; classes
that share the register values of a band meet in a bucket. Buckets with the same members count once.

A bucket is cut into blocks of about ``BLOCK`` members, and a task holds one block, or two, at a time. First every block
is compared with itself and with a few anchors, which are in all blocks of the bucket. Then, in buckets of several
blocks, the members outside the bucket's largest component, in blocks of their own, meet every block. So each pair of
different components that shares a bucket is compared, once, in the first bucket it shares. Inside a block the
likelihood estimate (sizes known) only sets the order, likely partners first; every pair that is not joined yet is
then confirmed or refused on full sets, and only the links that join components leave the task. With the default
20 bands of 5 registers a pair at 0.85 is missed with probability 8e-6.

Null and empty texts have empty sets and link with nothing. A null id takes the component of its class if there is one.
Rows that share an id are one item. Repeated rows are one class. Other columns are not read. The set of a very long text
is made as a whole, by one task; the blocks of a bucket are the smaller the larger its sets are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import bitmap, components, in_bitmap, query, salted_join, stored, table

#: Base of the logarithmic scale, rate of the exponential variables and largest register value.
BASE, RATE, TOP = 1.001, 20.0, (1 << 16) - 1
BAND = 5
#: Members of a block, shingles of a block, and members of a bucket that are in all of its blocks.
BLOCK, BLOCK_SHINGLES, ANCHORS = 512, 1 << 20, 64
MEMO = 1 << 17
BITS = 24


class WordHashes(dict):
    """64-bit hashes of words; starts afresh when it has become large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_HASHES = WordHashes()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles; words end at ASCII white space, and A-Z are lowered."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    if len(h) < width:
        x = np.uint64(len(h)) * np.ones(1, np.uint64)
        for v in h:
            x = _mix(x * np.uint64(0x9E3779B97F4A7C15) + v)
        return x
    x = np.zeros(len(h) - width + 1, np.uint64)
    for k in range(width):
        x = _mix(x * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - width + 1 + k])
    return np.unique(x)


def _seeds(m: int) -> tuple[np.ndarray, np.ndarray]:
    s = _mix(np.arange(1, 2 * m + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return s[:m], s[m:] | np.uint64(1)


def sketch(shingles: np.ndarray, seeds: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Registers of a set that is not empty."""
    least = np.full(len(seeds[0]), np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(shingles), 512):
        least = np.minimum(least, ((shingles[k : k + 512, None] ^ seeds[0]) * seeds[1]).min(axis=0))
    x = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, TOP).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union."""
    return np.maximum(a, b)


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, steps: int = 40) -> np.ndarray:
    """Jaccard similarity of each row pair by maximum likelihood of the order of registers, sizes known."""
    more, less = (a > b).sum(axis=1), (a < b).sum(axis=1)
    equal = a.shape[1] - more - less
    u = n_a / (n_a + n_b)
    v = 1 - u

    def p(x):
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def likelihood(j):
        up, down = p(u - v * j), p(v - u * j)
        rest = np.clip(1 - up - down, 1e-12, 1)
        return more * np.log(np.clip(up, 1e-12, 1)) + less * np.log(np.clip(down, 1e-12, 1)) + equal * np.log(rest)

    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(steps):
        third = (high - low) / 3
        left = likelihood(low + third) >= likelihood(high - third)
        low, high = np.where(left, low, low + third), np.where(left, high - third, high)
    return (low + high) / 2


SKETCH = "doc_id long, n_shingles long, same string, registers binary"


def sketches(docs: DataFrame, key: str, text: str, width: int, registers: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seeds = _seeds(registers)
        for pdf in batches:
            out = []
            for i, t in zip(pdf.iloc[:, 0], pdf.iloc[:, 1]):
                s = shingle_set(t, width)
                if len(s):
                    same = f"{len(s)}:{int(_mix(s).sum(dtype=np.uint64)):x}:{int(_mix(s ^ np.uint64(77)).sum(dtype=np.uint64)):x}"
                    out.append((i, len(s), same, sketch(s, seeds).tobytes()))
                else:
                    out.append((i, 0, None, None))
            made = pd.DataFrame(out, columns=["doc_id", "n_shingles", "same", "registers"])
            yield made.astype({"doc_id": "Int64"})

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInPandas(run, SKETCH)


def band_hashes(registers: np.ndarray) -> np.ndarray:
    """Hashes of the bands of each row of registers; rest registers behind the last whole band are not used."""
    bands = registers.shape[1] // BAND
    r = registers[:, : bands * BAND].reshape(len(registers), bands, BAND).astype(np.uint64)
    h = np.broadcast_to(np.arange(bands, dtype=np.uint64), (len(registers), bands)).copy()
    for k in range(BAND):
        h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + r[:, :, k])
    return h


def band_entries(classes: DataFrame, registers: int, wanted: Broadcast | None = None) -> DataFrame:
    """(bucket, band, rep, class, n_shingles): one row for each band of each class, or only those of a bitmap of buckets."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bands = registers // BAND
        for pdf in batches:
            if len(pdf):
                h = band_hashes(np.frombuffer(b"".join(pdf["registers"]), np.uint16).reshape(len(pdf), registers)).ravel()
                rows = pdf[["rep", "class", "n_shingles"]].loc[pdf.index.repeat(bands)]
                out = rows.assign(bucket=h.view(np.int64), band=np.tile(np.arange(bands, dtype=np.int32), len(pdf)))
                yield out if wanted is None else out[in_bitmap(wanted.value, BITS, h)]

    rows = classes.select("rep", F.xxhash64("same").alias("class"), "n_shingles", "registers")
    return rows.mapInPandas(run, "bucket long, band int, rep long, class long, n_shingles long")


def _texts(docs: DataFrame, ids: DataFrame, key: str, text: str) -> DataFrame:
    """(doc_id, text) of the documents with these ids; a bitmap of fixed size keeps most others out of the shuffle."""
    wanted = docs.sparkSession.sparkContext.broadcast(bitmap(ids.select(F.xxhash64("doc_id").alias("h")), "h", BITS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(in_bitmap(wanted.value, BITS, batch.column(2).to_numpy())))

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).withColumn("h", F.xxhash64("doc_id"))
    return rows.mapInArrow(run, rows.schema).drop("h").join(ids.hint("merge"), "doc_id")


def _parts(members: Column, shingles: Column) -> Column:
    """Blocks for so many members with so many shingles together."""
    return F.greatest(F.ceil(members / BLOCK), F.ceil(shingles / BLOCK_SHINGLES)).cast("int")


def _part(parts: Column | str, *salt: str) -> Column:
    return F.pmod(F.xxhash64("rep", "bucket", *map(F.lit, salt)), F.col(parts) if isinstance(parts, str) else parts).cast("int")


def _all(parts: Column | str) -> Column:
    return F.sequence(F.lit(0), F.col(parts) - 1)


def block_links(
    reps: list[int], labels: list[int], heads: np.ndarray, sets: list[np.ndarray], band: int, percent: int, registers: int
) -> list[tuple[int, int]]:
    """Links that join the components of a block's members, which share the given band.

    With heads, those are compared with all other members; without, all members with each other. Pairs that share an
    earlier band are left to it.
    """
    seeds = _seeds(registers)
    r = np.array([sketch(s, seeds) for s in sets])
    before = band_hashes(r)[:, :band]
    sizes = np.array([len(s) for s in sets], np.int64)
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    ids = np.split(ids, np.cumsum(sizes)[:-1])
    at = np.zeros(max(int(i.max()) for i in ids) + 1, bool)
    comp = np.unique(np.array(labels), return_inverse=True)[1]
    partners = ~heads if heads.any() else np.ones(len(sets), bool)
    out = []
    for a in np.flatnonzero(heads) if heads.any() else range(len(sets)):
        open_ = partners & (comp != comp[a]) & (100 * np.minimum(sizes, sizes[a]) >= percent * np.maximum(sizes, sizes[a]))
        if not heads.any():
            open_[: a + 1] = False
        b = np.flatnonzero(open_)
        b = b[~(before[b] == before[a]).any(axis=1)]
        if not len(b):
            continue
        j = estimate(np.broadcast_to(r[a], (len(b), registers)), r[b], np.full(len(b), float(sizes[a])), sizes[b].astype(float), 16)
        at[ids[a]] = True
        for v in b[np.argsort(-j, kind="stable")]:
            if comp[v] != comp[a]:
                common = int(np.count_nonzero(at[ids[v]]))
                if 100 * common >= percent * (int(sizes[a] + sizes[v]) - common):
                    out.append((reps[a], reps[v]))
                    comp[comp == comp[v]] = comp[a]
        at[ids[a]] = False
    return out


def links(cells: DataFrame, texts: DataFrame, width: int, percent: int, registers: int) -> DataFrame:
    """Links (u, v) found in cells: rows (bucket, band, x, y, rep, label, head), each cell (bucket, x, y) of bounded size."""
    counts = stored(cells.groupBy("rep").agg(F.count("*").alias("_n")))
    rows = salted_join(cells, texts.toDF("rep", "text"), "rep", counts=counts)
    rows = rows.select("bucket", "band", "x", "y", "rep", "label", "head", "text").repartition("bucket", "x", "y")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, reps, labels, heads, sets = None, [], [], [], []

        def done() -> pd.DataFrame:
            found = block_links(reps, labels, np.array(heads, bool), sets, now[1], percent, registers) if len(reps) > 1 else []
            return pd.DataFrame(found, columns=["u", "v"], dtype="int64")

        for pdf in batches:
            cell = zip(pdf["bucket"], pdf["band"], pdf["x"], pdf["y"])
            for c, rep, label, head, text in zip(cell, pdf["rep"], pdf["label"], pdf["head"], pdf["text"]):
                if c != now:
                    yield done()
                    now, reps, labels, heads, sets = c, [], [], [], []
                s = shingle_set(text, width)
                if len(s):
                    reps.append(rep)
                    labels.append(label)
                    heads.append(head)
                    sets.append(s)
        yield done()

    return rows.sortWithinPartitions("bucket", "x", "y").mapInPandas(run, "u long, v long")


def near_documents(
    docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80, registers: int = 100
) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row; links need ``percent`` of the union in common."""
    all_docs = stored(sketches(docs, key, text, width, registers))
    classes = stored(
        all_docs.where("same is not null and doc_id is not null")
        .groupBy("same")
        .agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("registers").alias("registers"), F.count("*").alias("_n"))
    )
    # Buckets of the same members (two 64-bit hashes of the set) are one: that of the first band.
    buckets = (
        band_entries(classes, registers)
        .groupBy("bucket")
        .agg(
            F.min("band").alias("band"),
            F.count("*").alias("_n"),
            F.sum("n_shingles").alias("_w"),
            F.bit_xor("class").alias("a"),
            F.bit_xor(F.xxhash64("class")).alias("b"),
        )
        .where("_n > 1")
        .groupBy("_n", "_w", "a", "b")
        .agg(F.min(F.struct("band", "bucket")).alias("m"))
    )
    buckets = stored(buckets.select("m.bucket", F.col("_n"), _parts(F.col("_n"), F.col("_w")).alias("parts")))
    wanted = docs.sparkSession.sparkContext.broadcast(bitmap(buckets, "bucket", BITS))
    entries = stored(band_entries(classes, registers, wanted))
    members = stored(
        salted_join(entries.drop("class"), buckets.select("bucket", F.col("_n").alias("size"), "parts"), "bucket", counts=buckets.select("bucket", "_n")).dropDuplicates(["bucket", "rep"])
    )
    texts = stored(_texts(docs, members.select(F.col("rep").alias("doc_id")).distinct(), key, text))

    anchor = (F.col("parts") > 1) & (F.pmod(F.xxhash64("rep"), F.col("size")) < ANCHORS)
    first = members.withColumn("x", F.explode(F.when(anchor, _all("parts")).otherwise(F.array(_part("parts")))))
    cell = ["bucket", "band", "x", "y", "rep", "label", "head"]
    first = first.withColumn("y", F.lit(0)).withColumn("label", F.col("rep")).withColumn("head", F.lit(False)).select(cell)
    edges = stored(links(first, texts, width, percent, registers))
    joined = stored(components(edges, "u", "v"))

    # Members of buckets of several blocks that are outside the largest component meet all blocks.
    large = members.where("parts > 1").join(joined.withColumnRenamed("id", "rep").hint("merge"), "rep", "left")
    large = stored(large.withColumn("label", F.coalesce("component", "rep")).drop("component"))
    if not large.isEmpty():
        sizes = large.groupBy("bucket", "label").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("w"))
        main = sizes.groupBy("bucket").agg(F.max(F.struct("n", "label"))["label"].alias("main"), F.sum("n").alias("n"), F.sum("w").alias("w"), F.max(F.struct("n", "label", "w")).alias("m"))
        rest = main.select("bucket", "main", (F.col("n") - F.col("m.n")).alias("n"), (F.col("w") - F.col("m.w")).alias("w")).where("n > 0")
        rest = stored(rest.select("bucket", "main", _parts(F.col("n"), F.col("w")).alias("head_parts")))
        both = stored(salted_join(large, rest, "bucket", counts=buckets.select("bucket", "_n")))
        heads = both.where("label <> main").withColumn("x", _part("head_parts", "head")).withColumn("y", F.explode(_all("parts"))).withColumn("head", F.lit(True))
        others = both.withColumn("y", _part("parts")).withColumn("x", F.explode(_all("head_parts"))).withColumn("head", F.lit(False))
        more = links(heads.select(cell).unionByName(others.select(cell)), texts, width, percent, registers)
        edges = stored(edges.unionByName(more))
        joined = stored(components(edges, "u", "v"))
    known = classes.select("same", "rep").join(joined.withColumnRenamed("id", "rep").hint("merge"), "rep", "left")
    known = stored(known.select("same", F.coalesce("component", "rep").alias("component_id")))
    rows = all_docs.select("doc_id", "n_shingles", "same")
    out = salted_join(rows, known, "same", "left", classes.select("same", "_n"), docs.count())
    return out.select(
        "doc_id",
        "n_shingles",
        F.coalesce("component_id", "doc_id").alias("component_id"),
        F.col("doc_id").eqNullSafe(F.coalesce("component_id", "doc_id")).alias("kept"),
    )


@query("op2_setsketch_near_dedup")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return near_documents(table(spark, folder, "documents"), width=3, percent=85)
