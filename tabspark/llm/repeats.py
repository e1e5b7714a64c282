"""Removal of repeated byte strings, by sampled suffixes, names and recursion on what the names leave open.

A byte goes if it lies in a string of ``length`` bytes that starts anywhere else too. As in a suffix array built from a
difference cover, only a sample of the positions is named first, chosen so that two equal strings always have sampled
positions at the same offset; the names of the sample then decide nearly all other positions, and the rest is refined.
The sample is content-dependent (a synchronizing set: the smallest gram hash of every window), since a cover of residues
takes two thirds of all positions modulo 3, whose rows alone are many times the input.

The windows that belong to a sampled position fall into blocks of neighbouring offsets. Of each block two names are
formed: of the text that all its windows have in common (core), and of all the text they touch (union). A union that
occurs again settles all windows of the block; a core that does not settles that none can match. Groups with one core
and several unions are opened: one representative of each union goes on with smaller blocks, at last single windows.
Names are 64-bit hashes of offset and text, so all comparisons are groupings of rows; groups are counted with partial
aggregation, and nothing is ever paired.

Null texts are empty. Texts shorter than ``length`` keep all bytes. Rows are told apart by a number stored with them, so
repeated rows and ids, null ids included, count as different documents. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import bitmap, in_bitmap, query, salted_join, stored, table

GRAM = 32
SIZES = (64, 8, 1)  # offsets in a block, level by level
BITS = 25  # of the bitmaps that spare shuffles; their size is fixed
CHUNK = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTES = _mix(np.arange(1, 257, dtype=np.uint64) * _U(_BASE))
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, b in enumerate((_BASE, _INVERSE)):
            p = np.full(n, b, np.uint64)
            p[0] = 1
            _POWERS[k] = np.multiply.accumulate(p)
    return _POWERS[0][:n], _POWERS[1][:n]


class Hashes:
    """Hash of any part of some bytes, from one pass over them; equal parts have equal hashes wherever they stand."""

    def __init__(self, raw: bytes):
        x = _BYTES[np.frombuffer(raw, np.uint8)]
        up, self.down = _powers(max(len(x), 1))
        self.sums = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(x * up[: len(x)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray, salt: np.ndarray) -> np.ndarray:
        h = (self.sums[end] - self.sums[start]) * self.down[np.minimum(start, len(self.down) - 1)]
        return _mix(_mix(h + (end - start).astype(np.uint64)) + salt.astype(np.uint64) * _U(_BASE))


def anchors(hashes: Hashes, n: int, length: int) -> np.ndarray:
    """For each window of ``length`` bytes the place of its smallest gram, the leftmost of equal ones."""
    grams = n - GRAM + 1
    width = length - GRAM + 1
    h = _mix((hashes.sums[GRAM : GRAM + grams] - hashes.sums[:grams]) * hashes.down[:grams])
    packed = (h & ~_U((1 << 24) - 1)) | np.arange(grams, dtype=np.uint64)
    rows = -(-grams // width)
    full = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    full[:grams] = packed
    full = full.reshape(rows, width)
    ahead = np.minimum.accumulate(full, axis=1).ravel()
    behind = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = n - length + 1
    return (np.minimum(behind[:windows], ahead[width - 1 : width - 1 + windows]) & _U((1 << 24) - 1)).astype(np.int64)


def nodes_of(raw: bytes, length: int, chunk: int | None = None) -> Iterator[tuple[np.ndarray, ...]]:
    """(sample, block, first and last own offset, core, union, ends inside?) of the top blocks, a chunk at a time.

    A block belongs to the chunk in which its first window starts, so that no block is given twice.
    """
    size, top, chunk = SIZES[0], length - GRAM, chunk or CHUNK
    for begin in range(0, max(0, len(raw) - length + 1), chunk):
        left = max(0, begin - length)
        part = raw[left : begin + chunk + size + 2 * length]
        hashes = Hashes(part)
        at = anchors(hashes, len(part), length)
        # The window before tells whether the first block is new; a block has at most ``size`` windows, which follow each other.
        first = np.arange(max(0, begin - 1) - left, min(len(at), begin - left + chunk + size))
        at = at[first]
        offset = at - first
        block = offset // size
        new = np.ones(len(at), dtype=bool)
        new[1:] = (at[1:] != at[:-1]) | (block[1:] != block[:-1])
        k = np.flatnonzero(new)
        last = np.append(k[1:], len(at)) - 1
        here = (first[k] >= begin - left) & (first[k] < begin - left + chunk)
        k, last = k[here], last[here]
        a, q = at[k], block[k]
        lo, hi = offset[last], offset[k]
        d0, d1 = q * size, np.minimum(q * size + size - 1, top)
        inside = (a - d1 >= 0) & (a - d0 + length <= len(part))
        core = hashes.of(a - d0, np.minimum(a - d1 + length, len(part)), q)
        union = hashes.of(np.maximum(a - d1, 0), np.minimum(a - d0 + length, len(part)), q + 64)
        yield a + left, q, lo, hi, core, union, inside


def _identity(uid: np.ndarray, a: np.ndarray, q: np.ndarray) -> np.ndarray:
    return _mix(_mix(uid.astype(np.uint64) * _U(_BASE) + a.astype(np.uint64)) + q.astype(np.uint64))


NODE = "node long, uid long, a long, d0 int, lo int, hi int, core long, union long"


def _scan(docs: DataFrame, length: int, made, schema: str, chunk: int | None = None) -> DataFrame:
    """One pass over all texts; ``made(uid, bytes, nodes)`` gives arrays by column, for each chunk of each text."""
    columns = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out, size = [], 0
            for uid, t in zip(pdf["uid"], pdf["text"]):
                raw = (t or "").encode()
                for nodes in nodes_of(raw, length, chunk):
                    out.append(made(uid, raw, nodes))
                    size += len(out[-1][0])
                    if size > 1 << 18:
                        yield pd.DataFrame({c: np.concatenate(x) for c, x in zip(columns, zip(*out))})
                        out, size = [], 0
            if out:
                yield pd.DataFrame({c: np.concatenate(x) for c, x in zip(columns, zip(*out))})

    return docs.select("uid", "text").mapInPandas(run, schema)


def _level(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of stored nodes: (those that need an answer and whose union occurs again; stored representatives to open)."""
    groups = stored(
        nodes.groupBy("union").agg(
            F.count("*").alias("c"),
            F.max("core").alias("core"),
            F.max("need").alias("need"),
            F.min(F.struct("node", "uid", "a", "d0", "lo", "hi")).alias("rep"),
        )
    )
    again = groups.where("c > 1").select("union", F.col("c").alias("_n"))
    matched = salted_join(nodes.where("need"), again.select("union"), "union", counts=again, total=nodes.count())
    opened = groups.groupBy("core").agg(F.count("*").alias("k"), F.max((F.col("c") == 1) & F.col("need")).alias("open")).where("k > 1 and open")
    reps = salted_join(groups, opened.select("core"), "core", counts=opened.select("core", F.col("k").alias("_n")), total=groups.count())
    return matched, stored(reps.select("rep.*", ((F.col("c") == 1) & F.col("need")).alias("need")))


def _opened(slices: DataFrame, length: int, size: int, whole: int) -> DataFrame:
    """Nodes of blocks of ``size`` offsets inside the blocks of ``whole`` offsets that have their text at hand."""
    top = length - GRAM

    def opened(pdf: pd.DataFrame) -> pd.DataFrame:
        sizes = pdf["slice"].map(len).to_numpy()
        hashes = Hashes(b"".join(pdf["slice"]))  # one pass over all slices
        ends = np.cumsum(sizes)
        lo = np.maximum(pdf["lo"].to_numpy(), pdf["d0"].to_numpy())
        hi = np.minimum(pdf["hi"].to_numpy(), pdf["d0"].to_numpy() + whole - 1)
        first = lo // size
        blocks = hi // size - first + 1
        k = np.repeat(np.arange(len(pdf)), blocks)
        d0 = (first[k] + np.arange(len(k)) - np.repeat(np.cumsum(blocks) - blocks, blocks)) * size
        d1 = np.minimum(d0 + size - 1, top)
        begin, end = (ends - sizes)[k], ends[k]
        at = begin + (pdf["a"] - pdf["begin"]).to_numpy()[k]
        inside = (at - d1 >= begin) & (at - d0 + length <= end)
        core = hashes.of(np.clip(at - d0, begin, end), np.clip(at - d1 + length, begin, end), d0 * 64 + size)
        union = hashes.of(np.clip(at - d1, begin, end), np.clip(at - d0 + length, begin, end), d0 * 64 + size + (1 << 20))
        uid, a = pdf["uid"].to_numpy()[k], pdf["a"].to_numpy()[k]
        union = np.where(inside, union, _identity(uid, a, d0 * 64 + size))
        of = {"node": pdf["node"].to_numpy()[k], "uid": uid, "a": a, "d0": d0.astype(np.int32)}
        of |= {"lo": np.maximum(d0, pdf["lo"].to_numpy()[k]).astype(np.int32), "hi": np.minimum(d1, pdf["hi"].to_numpy()[k]).astype(np.int32)}
        return pd.DataFrame(of | {"core": core.view(np.int64), "union": union.view(np.int64), "need": pdf["need"].to_numpy()[k]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k in range(0, len(pdf), 2048):
                yield opened(pdf.iloc[k : k + 2048])

    return slices.mapInPandas(run, NODE + ", need boolean")


def repeated_windows(docs: DataFrame, length: int, chunk: int | None = None) -> DataFrame:
    """(uid, lo, hi): runs of first bytes of windows that occur more than once; ``docs`` has uid and text."""
    spark = docs.sparkSession

    def cores(uid, raw, nodes):
        return (nodes[4].view(np.int64),)

    counted = _scan(docs, length, cores, "core long", chunk).groupBy("core").agg(F.count("*").alias("c")).where("c > 1").select("core")
    known = spark.sparkContext.broadcast(bitmap(counted, "core", BITS))

    def repeated(uid, raw, nodes):
        keep = in_bitmap(known.value, BITS, nodes[4])
        a, q, lo, hi, core, union, inside = (x[keep] for x in nodes)
        own = _identity(np.full(len(a), uid), a, q)
        ids = [own.view(np.int64), np.full(len(a), uid), a, (q * SIZES[0]).astype(np.int32), lo.astype(np.int32), hi.astype(np.int32)]
        return (*ids, core.view(np.int64), np.where(inside, union, own).view(np.int64))

    nodes = stored(_scan(docs, length, repeated, NODE, chunk).withColumn("need", F.lit(True)))
    matched, reps = _level(nodes)
    span = lambda m: m.select("uid", (F.col("a") - F.col("hi")).alias("lo"), (F.col("a") - F.col("lo")).alias("hi"))
    found = [stored(span(matched))]
    wanted = spark.sparkContext.broadcast(bitmap(reps, "node", BITS))

    def texts(uid, raw, nodes):
        a, q = nodes[0], nodes[1]
        own = _identity(np.full(len(a), uid), a, q)
        k = np.flatnonzero(in_bitmap(wanted.value, BITS, own))
        d0 = q[k] * SIZES[0]
        begin = np.maximum(0, a[k] - np.minimum(d0 + SIZES[0] - 1, length - GRAM))
        cut = np.empty(len(k), dtype=object)
        cut[:] = [raw[b:e] for b, e in zip(begin, a[k] - d0 + length)]
        return own[k].view(np.int64), begin, cut

    cuts = _scan(docs, length, texts, "node long, begin long, slice binary", chunk)
    slices = stored(reps.join(cuts, "node"))
    for whole, size in zip(SIZES, SIZES[1:]):
        nodes = stored(_opened(slices, length, size, whole))
        matched, reps = _level(nodes)
        found.append(stored(span(matched)))
        if size > 1:
            text_of = slices.select("node", "begin", "slice")
            slices = reps.join(text_of, "node")  # a node's text serves all its blocks
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def without_repeats(docs: DataFrame, length: int = 200, key: str = "doc_id", text: str = "text", chunk: int | None = None) -> DataFrame:
    """(doc_id, kept bytes and counts) of every row: see RESULT, with the bytes that stay in ``kept``."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    # Numbered once: read again, the input may be split into other partitions, and rows would get other numbers.
    rows = stored(rows.withColumn("uid", F.monotonically_increasing_id()))
    spans = repeated_windows(rows, length, chunk).groupBy("uid").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))  # of one text
    both = rows.join(spans, "uid", "left").select("doc_id", "text", "spans")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, t, spans in pdf.itertuples(index=False):
                raw = (t or "").encode()
                kept, at, removed, runs = [], 0, 0, 0
                if spans is not None:
                    end = -1
                    for lo, hi in sorted((s["lo"], s["hi"] + length) for s in spans):
                        if lo > end:
                            if end >= 0:
                                kept.append((at, start))
                                removed, runs, at = removed + end - start, runs + 1, end
                            start, end = lo, hi
                        else:
                            end = max(end, hi)
                    kept.append((at, start))
                    removed, runs, at = removed + end - start, runs + 1, end
                kept.append((at, len(raw)))
                out.append((i, len(raw), removed, runs, b"".join([raw[s:e] for s, e in kept])))
            made = pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])
            yield made.astype({"doc_id": "Int64"})

    return both.mapInPandas(run, RESULT.replace("kept_sha256 string", "kept binary"))


@query("op3_repeated_strings")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    kept = without_repeats(table(spark, folder, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
