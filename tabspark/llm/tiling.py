"""Benchmark decontamination by greedy string tiling.

Words are lower-cased runs without white space and ASCII punctuation. A rolling (Karp-Rabin) hash over ``seed`` words
runs through every whole text; a bitmap of fixed size, made from the seeds of the benchmark, keeps the runs of words in
which every seed may occur there. No tile can reach beyond such a run, so the texts themselves are never shuffled.
Seeds of the runs join the seeds of the items; a document and an item with enough common seeds are tiled: the longest
match of words not yet marked is marked again and again, on both sides, down to ``seed`` words. An item is found in a
document if its tiles cover at least ``coverage`` of its words, in whatever order they stand.

An item with fewer than ``seed`` words is found where all its words follow each other, by one hash of them.

Null and empty texts hold nothing. Items without words, or null, are found nowhere. Items with equal
words count once, as the smallest item id. Rows that share an id (null too) are judged as one document. Repeated rows
get the same verdict each. Only ids and texts are read, so other columns cannot clash.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .setsketch import _HASHES, _mix
from .shared import bitmap, in_bitmap, query, salted_join, stored, table

SEED = 5
COVERAGE = 0.8
BITS = 24  # the bitmap has 2**BITS bits, whatever the size of the benchmark
_PLAIN = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(text: str | None) -> np.ndarray:
    words = (text or "").lower().encode().translate(_PLAIN).split()
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def rolling(h: np.ndarray, seed: int) -> np.ndarray:
    """Hash of every ``seed`` words in a row."""
    n = max(0, len(h) - seed + 1)
    x = np.zeros(n, np.uint64)
    for k in range(seed):
        x = x * _MULTIPLIER + h[k : k + n]
    return _mix(x)


def tiles(item: np.ndarray, runs: list[np.ndarray], seed: int) -> list[tuple[int, int, int]]:
    """Tiles (from in item, from in the runs laid end to end, words), longest first; no word is in two tiles."""
    doc = np.concatenate(runs)
    inside = np.concatenate([np.arange(len(r)) + seed <= len(r) for r in runs])[: max(0, len(doc) - seed + 1)]
    of_doc, of_item = rolling(doc, seed), rolling(item, seed)
    places = np.flatnonzero(inside)
    order = places[np.argsort(of_doc[places], kind="stable")]
    low, high = (np.searchsorted(of_doc[order], of_item, side=s) for s in ("left", "right"))
    i = np.repeat(np.arange(len(of_item)), high - low)
    if not len(i):
        return []
    starts = np.repeat(low - np.append(0, np.cumsum(high - low)[:-1]), high - low) + np.arange(len(i))
    j = order[starts]
    same = np.ones(len(i), dtype=bool)  # hashes propose, words decide
    for k in range(seed):
        same &= item[i + k] == doc[j + k]
    i, j = i[same], j[same]
    by_diagonal = np.lexsort((i, j - i))
    i, j = i[by_diagonal], j[by_diagonal]
    new = np.ones(len(i), dtype=bool)
    new[1:] = (np.diff(i) != 1) | (np.diff(j) != 1)
    at = np.flatnonzero(new)
    length = np.diff(np.append(at, len(i))) + seed - 1
    heap = [(-int(n), int(i[a]), int(j[a])) for a, n in zip(at, length)]
    heapq.heapify(heap)
    in_item, in_doc, out = np.zeros(len(item), dtype=bool), np.zeros(len(doc), dtype=bool), []
    while heap:
        n, a, b = heapq.heappop(heap)
        n = -n
        free = ~(in_item[a : a + n] | in_doc[b : b + n])
        if free.all():
            in_item[a : a + n] = in_doc[b : b + n] = True
            out.append((a, b, n))
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[False], free, [False]]).astype(np.int8)))
        for s, e in zip(edges[::2], edges[1::2]):
            if e - s >= seed:
                heapq.heappush(heap, (-int(e - s), a + int(s), b + int(s)))
    return out


def items_of(benchmark: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """Stored (item_id, n_words, words) of the distinct items that have words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [word_hashes(t) for t in pdf["text"]]
            made = pd.DataFrame({"item_id": pdf["item_id"], "n_words": [len(w) for w in found], "words": [w.tobytes() for w in found]})
            yield made[made["n_words"] > 0]

    rows = benchmark.select(F.col(key).cast("long").alias("item_id"), F.col(text).alias("text")).where("item_id is not null")
    words = rows.mapInPandas(run, "item_id long, n_words long, words binary")
    return stored(words.groupBy("words").agg(F.min("item_id").alias("item_id"), F.first("n_words").alias("n_words")).select("item_id", "n_words", "words"))


def _seeds(rows: DataFrame, key: str, seed: int, distinct: bool) -> DataFrame:
    """(h, key): the seeds of rows of words; of documents each once a row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k in range(0, len(pdf), 256):
                part = pdf.iloc[k : k + 256]
                found = [rolling(np.frombuffer(w, np.uint64), seed) for w in part["words"]]
                found = [np.unique(f) for f in found] if distinct else found
                ids = part[key].astype("Int64").repeat([len(f) for f in found])
                yield pd.DataFrame({"h": np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64), key: ids.to_numpy()}).astype({key: "Int64"})

    return rows.select(key, "words").mapInPandas(run, f"h long, {key} long")


def _runs(docs: DataFrame, words_of_items: np.ndarray, seed: int, key: str, text: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(words_of_items)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = shared.value
        for pdf in batches:
            out = []
            for i, t in zip(pdf["doc_id"], pdf["text"]):
                words = word_hashes(t)
                may = in_bitmap(bits, BITS, rolling(words, seed))
                if may.any():
                    edges = np.flatnonzero(np.diff(np.concatenate([[0], may.astype(np.int8), [0]])))
                    out += [(i, int(s), words[s : e + seed - 1].tobytes()) for s, e in zip(edges[::2], edges[1::2])]
            yield pd.DataFrame(out, columns=["doc_id", "at", "words"]).astype({"doc_id": "Int64", "at": "int64"})

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInPandas(run, "doc_id long, at long, words binary")


def _sequences(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every ``n`` words in a row, other than that of other numbers of words."""
    return _mix(rolling(words, n) + np.uint64(n))


def _short_matches(docs: DataFrame, items: DataFrame, key: str, text: str) -> DataFrame:
    """As ``matches``, of items that are found only as a whole."""
    lengths = sorted(r["n_words"] for r in items.select("n_words").distinct().collect())  # each below the seed

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [_sequences(np.frombuffer(w, np.uint64), n) for w, n in zip(pdf["words"], pdf["n_words"])]
            pdf["h"] = np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64)
            yield pdf[["h", "item_id", "n_words"]]

    hashed = stored(items.mapInPandas(whole, "h long, item_id long, n_words long"))
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(hashed, "h", BITS))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i, t in zip(pdf["doc_id"], pdf["text"]):
                words = word_hashes(t)
                h = np.concatenate([_sequences(words, n) for n in lengths])
                h = np.unique(h[in_bitmap(shared.value, BITS, h)])
                if len(h):
                    yield pd.DataFrame({"doc_id": pd.array([None if pd.isna(i) else int(i)] * len(h), "Int64"), "h": h.view(np.int64)})

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    of_docs = stored(rows.mapInPandas(run, "doc_id long, h long").distinct())
    both = salted_join(of_docs, hashed, "h")
    return both.select("doc_id", "item_id", "n_words", F.col("n_words").alias("covered"), F.lit(1).cast("long").alias("n_tiles"))


def matches(
    docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, seed: int = SEED, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, item_id, n_words, covered, n_tiles) of every item found in a document."""
    every = items_of(benchmark)
    short, items = every.where(F.col("n_words") < seed), every.where(F.col("n_words") >= seed)
    of_items = stored(_seeds(items, "item_id", seed, False).groupBy("h", "item_id").agg(F.count("*").alias("n")))
    runs = stored(_runs(docs, bitmap(of_items, "h", BITS), seed, key, text))
    of_docs = stored(_seeds(runs, "doc_id", seed, True).distinct())
    partners = of_items.groupBy("h").agg(F.collect_list(F.struct("item_id", "n")).alias("items"))  # distinct items only
    both = salted_join(of_docs, partners, "h").select("doc_id", F.explode("items").alias("i")).select("doc_id", "i.*")
    # Tiles of at least ``seed`` words over a share of the item hold a fifth (1 / seed) as many of its seeds.
    common = both.groupBy("doc_id", "item_id").agg(F.sum("n").alias("n"))
    pairs = stored(common.join(items.select("item_id", "n_words"), "item_id").where(F.col("n") * seed >= F.col("n_words") * coverage).select("doc_id", "item_id"))
    wanted = salted_join(pairs, items.select("item_id", "words"), "item_id").select("doc_id", F.lit(1).alias("side"), F.col("item_id").alias("k"), "words")
    known = pairs.select(F.col("doc_id").alias("d")).distinct()
    held = runs.join(known, F.col("doc_id").eqNullSafe(F.col("d")), "left_semi").select("doc_id", F.lit(0).alias("side"), F.col("at").alias("k"), "words")
    rows = held.unionByName(wanted).repartition("doc_id").sortWithinPartitions("doc_id", "side", "k")

    def tile(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, mine = object(), []
        for pdf in batches:
            out = []
            for d, side, k, raw in pdf.itertuples(index=False):
                d = None if pd.isna(d) else int(d)
                if d != at:
                    at, mine = d, []
                words = np.frombuffer(raw, np.uint64)
                if side == 0:
                    mine.append(words)
                    continue
                found = tiles(words, mine, seed)
                covered = sum(n for _, _, n in found)
                if covered >= coverage * len(words):
                    out.append((d, int(k), len(words), covered, len(found)))
            made = pd.DataFrame(out, columns=["doc_id", "item_id", "n_words", "covered", "n_tiles"])
            yield made.astype({"doc_id": "Int64", "item_id": "int64", "n_words": "int64", "covered": "int64", "n_tiles": "int64"})

    found = rows.mapInPandas(tile, "doc_id long, item_id long, n_words long, covered long, n_tiles long")
    return found if short.isEmpty() else found.unionByName(_short_matches(docs, short, key, text))


def verdicts(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, seed: int = SEED) -> DataFrame:
    """doc_id, contaminated, n_items (found in it), item_id (best covered, smallest on ties) and its coverage, of every row."""
    share: Column = F.col("covered") / F.col("n_words")
    best = matches(docs, benchmark, coverage, seed).groupBy("doc_id").agg(
        F.count("*").alias("n_items"), F.min(F.struct((-share).alias("c"), "item_id")).alias("best")
    )
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    best = best.withColumnRenamed("doc_id", "d")
    return rows.join(best, F.col("doc_id").eqNullSafe(F.col("d")), "left").select(
        "doc_id",
        F.col("n_items").isNotNull().alias("contaminated"),
        F.coalesce("n_items", F.lit(0)).alias("n_items"),
        F.col("best.item_id").alias("item_id"),
        F.coalesce(-F.col("best.c"), F.lit(0.0)).alias("coverage"),
    )


@query("op7_benchmark_tiling")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return verdicts(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
