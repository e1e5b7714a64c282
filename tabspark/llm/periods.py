"""Periodic runs of words: suffix-tree longest common extensions, and Lyndon roots extended in both directions.

For a sequence of words and for its reversal a suffix tree is built (Ukkonen). An Euler tour of a tree with minima over
blocks of the tour answers lowest common ancestors, so the common extension of two places, in constant time. The
longest Lyndon word that begins at a place ends before the next smaller suffix; under the order of words and its
inverse, every run has a root among these words. Each root is extended to the right and to the left; what covers it twice
is a run, with the root's length as its smallest period.

Only stretches that can hold a run get trees. In a run of length max(6, 4 q) or more, of period q, each three
consecutive words occur at least three times: the 4 q - 2 or more starts (4 or more if q = 1) fall into q classes of equal triples, with
three or more in each. So a text is cut wherever three words occur less often in it; no run is lost or shortened, and
a word beside a stretch can't extend one. Most prose falls away here, at the cost of one sort.

Null and empty texts have no words, no runs, and digests of the empty string. Without an id nothing is repeated by
``planted``. Ties: the run with the smallest start, then period, is the greatest. Repeated rows give repeated results,
other columns are not read, an empty table gives an empty table. No shuffle: texts are judged where they lie. Long texts
run through whole: their words are held as 32-bit numbers, and the trees of one stretch at a time.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .shared import light_batches, query, table, word_runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LEAST, TIMES = 6, 4
#: Places of the Euler tour that share one minimum.
WIDTH = 32
#: Odd numbers that mix three words and their text into a key (values of no meaning; a collision only costs time).
MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)


class SuffixTree:
    """Suffix tree of a word sequence that ends with a 0, the smallest word, found nowhere else."""

    def __init__(self, words: Sequence[int]):
        self.n = len(words)
        self._build(words)
        self._tour()

    def _build(self, s: Sequence[int]) -> None:
        n, sigma = len(s), max(s) + 1
        start, stop, link = [0], [0], [0]
        edges: dict[int, int] = {}  # node * sigma + first word of the edge: node below
        node = edge = length = waiting = 0
        for i, c in enumerate(s):
            waiting += 1
            made = 0  # inner node that still needs its suffix link
            while waiting:
                if not length:
                    edge = i
                key = node * sigma + s[edge]
                below = edges.get(key)
                if below is None:
                    edges[key] = len(start)
                    start.append(i), stop.append(n), link.append(0)
                    if made:
                        link[made], made = node, 0
                else:
                    size = min(stop[below], i + 1) - start[below]
                    if length >= size:
                        edge, length, node = edge + size, length - size, below
                        continue
                    if s[start[below] + length] == c:
                        length += 1
                        if made:
                            link[made] = node
                        break
                    middle = len(start)
                    start.append(start[below]), stop.append(start[below] + length), link.append(0)
                    edges[key] = middle
                    edges[middle * sigma + c] = middle + 1
                    start.append(i), stop.append(n), link.append(0)
                    start[below] += length
                    edges[middle * sigma + s[start[below]]] = below
                    if made:
                        link[made] = middle
                    made = middle
                waiting -= 1
                if node:
                    node = link[node]
                elif length:
                    length, edge = length - 1, i - waiting + 1
        keys = np.fromiter(edges.keys(), np.int64, len(edges))
        order = np.argsort(keys)
        above = keys[order] // sigma
        #: Children of node v, by their first words: below[first[v]:first[v + 1]].
        self.below = np.fromiter(edges.values(), np.int64, len(edges))[order]
        self.first = np.searchsorted(above, np.arange(len(start) + 1))
        self.size = np.array(stop) - np.array(start)

    def _tour(self) -> None:
        below, first, size = self.below.tolist(), self.first.tolist(), self.size.tolist()
        depth = [0] * len(size)
        tour: list[int] = []  # depths along the Euler tour
        seen = [0] * self.n  # first place of each suffix in the tour
        leaves: list[int] = []
        stack, place = [0], first[:]
        tour.append(0)
        while stack:
            v = stack[-1]
            k = place[v]
            if k < first[v + 1]:
                place[v] = k + 1
                w = below[k]
                depth[w] = depth[v] + size[w]
                tour.append(depth[w])
                if first[w] == first[w + 1]:
                    suffix = self.n - depth[w]
                    seen[suffix] = len(tour) - 1
                    leaves.append(suffix)
                    tour.append(depth[v])
                else:
                    stack.append(w)
            else:
                stack.pop()
                if stack:
                    tour.append(depth[stack[-1]])
        self.leaves = leaves
        self.seen = np.array(seen)
        blocks = -(-len(tour) // WIDTH)
        self.depths = np.full(blocks * WIDTH, np.iinfo(np.int64).max)
        self.depths[: len(tour)] = tour
        grid = self.depths.reshape(blocks, WIDTH)
        self.prefix = np.minimum.accumulate(grid, axis=1).ravel()
        self.suffix = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        self.minima = [grid.min(axis=1)]
        while 2 ** len(self.minima) <= blocks:
            half, last = 2 ** (len(self.minima) - 1), self.minima[-1]
            self.minima.append(np.minimum(last[:-half], last[half:]))

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Lengths of the longest common prefixes of suffixes i and j (i and j differ): depths of their lowest common ancestors."""
        a, b = self.seen[i], self.seen[j]
        a, b = np.minimum(a, b), np.maximum(a, b)
        low, high = a // WIDTH, b // WIDTH
        out = np.minimum(self.suffix[a], self.prefix[b])
        gap = high - low - 1
        level = np.zeros(len(a), np.int64)
        wide = gap > 0
        level[wide] = np.frexp(gap[wide].astype(float))[1] - 1
        for k in np.unique(level[wide]):
            at = np.flatnonzero(wide & (level == k))
            minima = self.minima[k]
            out[at] = np.minimum(out[at], np.minimum(minima[low[at] + 1], minima[high[at] - 2**k]))
        same = np.flatnonzero(gap < 0)  # both in one block: its places one after another
        if len(same):
            best = self.depths[a[same]]
            for step in range(1, WIDTH):
                at = a[same] + step
                inside = at <= b[same]
                best[inside] = np.minimum(best[inside], self.depths[at[inside]])
            out[same] = best
        return out

    def leaves_inverse(self) -> list[int]:
        """Suffixes in the order of inverted words; a suffix still comes before those it begins."""
        below, first, size = self.below.tolist(), self.first.tolist(), self.size.tolist()
        out: list[int] = []
        stack = [(0, 0)]
        while stack:
            v, depth = stack.pop()
            depth += size[v]
            if first[v] == first[v + 1]:
                out.append(self.n - depth)
                continue
            children = below[first[v] : first[v + 1]]
            # The edge that is only the end mark comes first in both orders; the stack gives the last one first.
            end = first[children[0]] == first[children[0] + 1] and size[children[0]] == 1
            ordered = [children[0], *children[:0:-1]] if end else children[::-1]
            stack += [(w, depth) for w in reversed(ordered)]
        return out


def _next_smaller(order: Sequence[int], n: int) -> np.ndarray:
    """For each suffix but the last (the end mark): the next suffix that comes before it."""
    rank = [0] * n
    for k, suffix in enumerate(order):
        rank[suffix] = k
    out = [n - 1] * n
    stack: list[int] = []
    for i in range(n - 1, -1, -1):
        while stack and rank[stack[-1]] > rank[i]:
            stack.pop()
        if stack:
            out[i] = stack[-1]
        stack.append(i)
    return np.array(out[: n - 1], dtype=np.int64)


def all_runs(words: np.ndarray) -> np.ndarray:
    """Every run (start, length, period) of a sequence of words > 0 whose length is twice the period or more, in order."""
    n = len(words)
    if n < 2:
        return np.zeros((0, 3), np.int64)
    forward = words.tolist()
    tree = SuffixTree([*forward, 0])
    roots = [_next_smaller(order, n + 1) for order in (tree.leaves, tree.leaves_inverse())]
    start = np.concatenate([np.arange(n), np.arange(n)])
    period = np.concatenate(roots) - start
    right = tree.common(start, start + period)
    del tree
    back = SuffixTree([*forward[::-1], 0])
    # What ends before place i is the suffix n - i of the reversal.
    left = np.zeros(len(start), np.int64)
    inner = np.flatnonzero((start > 0) & (start + period < n))
    left[inner] = back.common(n - start[inner], n - start[inner] - period[inner])
    whole = left + right >= period
    found = np.stack([start - left, left + period + right, period], axis=1)[whole]
    return np.unique(found, axis=0).reshape(-1, 3)


def stretches(keys: np.ndarray, least: int = 3) -> list[tuple[int, int]]:
    """(from, to) of the rows of places whose key is there ``least`` times or more."""
    _, back, counts = np.unique(keys, return_inverse=True, return_counts=True)
    often = np.concatenate([[False], counts[back] >= least, [False]])
    edges = np.flatnonzero(often[1:] != often[:-1])
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def triple_keys(words: np.ndarray) -> np.ndarray:
    w = words.astype(np.uint64)
    return w[:-2] * np.uint64(MIX[0]) ^ w[1:-1] * np.uint64(MIX[1]) ^ w[2:] * np.uint64(MIX[2])


def strong_runs(words: np.ndarray, cut: Sequence[tuple[int, int]]) -> np.ndarray:
    """Runs of length max(LEAST, TIMES * period) or more, by start, then period; ``cut`` lists the stretches of triples."""
    out = [np.zeros((0, 3), np.int64)]
    for begin, end in cut:
        part = words[begin : end + 2]
        if len(part) >= LEAST:
            _, small = np.unique(part, return_inverse=True)
            runs = all_runs(small + 1)
            runs = runs[runs[:, 1] >= np.maximum(LEAST, TIMES * runs[:, 2])]
            out.append(runs + np.array([begin, 0, 0]))
    return np.concatenate(out)


def planted(words: np.ndarray, doc_id: int | None) -> np.ndarray:
    """The words with the repetition that the id asks for: one text in ten repeats a stretch to its end."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return words[np.where(i >= a, a + (i - a) % p, i)]


def _best(runs: np.ndarray) -> tuple[int, int, int, int] | tuple[None, None, None, None]:
    top = None
    for start, length, period in runs.tolist():
        if top is None or length * top[2] > top[1] * period:
            top = (start, length, period)
    return (*top, 1000 * top[1] // top[2]) if top else (None, None, None, None)


def _dropped(runs: np.ndarray, n: int) -> np.ndarray:
    """Words that some run holds after its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change[:-1]) > 0


class _Words:
    """Numbers for the words of a group of texts."""

    def __init__(self) -> None:
        self.place: dict[str, int] = {}
        self.names: list[str] = []

    def of(self, text: str) -> np.ndarray:
        out = [np.zeros(0, np.int32)]
        for run in word_runs(WORD, text):
            for w in set(run).difference(self.place):
                self.place[w] = len(self.names)
                self.names.append(w)
            out.append(np.fromiter(map(self.place.__getitem__, run), np.int32, len(run)))
        return np.concatenate(out)


KINDS = [pa.int64()] * 5 + [pa.string()] * 2
NAMES = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def detect(docs: DataFrame, key: str = "doc_id", text: str = "text", repeat: bool = False) -> DataFrame:
    """Per row: number of runs, the greatest one, digests of all runs and of the text without repetitions.

    ``repeat`` first plants the repetitions of ``planted``, which go by the key.
    """
    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for i, j in light_batches(texts):
                words = _Words()
                sequences = [words.of(t) for t in texts[i:j]]
                if repeat:
                    sequences = [planted(s, d) for s, d in zip(sequences, ids[i:j])]
                names = np.array(words.names, dtype=object)
                out = []
                for sequence, cut in zip(sequences, _stretches_of(sequences)):
                    runs = strong_runs(sequence, cut)
                    listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs.tolist())
                    kept = sequence[~_dropped(runs, len(sequence))] if len(runs) else sequence
                    sha = hashlib.sha256()
                    for k in range(0, len(kept), 1 << 17):
                        sha.update(((" " if k else "") + " ".join(names[kept[k : k + (1 << 17)]])).encode())
                    out.append((len(runs), *_best(runs), hashlib.sha256(listed.encode()).hexdigest(), sha.hexdigest()))
                columns = [pa.array(c, t) for c, t in zip(zip(*out), KINDS)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *columns], names=[key, *NAMES])

    return docs.select(key, text).mapInArrow(run, schema)


def _stretches_of(sequences: Sequence[np.ndarray]) -> list[list[tuple[int, int]]]:
    """The stretches of each text of a group, from one sort of the triples of all; keys of two texts differ."""
    sizes = np.array([max(0, len(s) - 2) for s in sequences], dtype=np.int64)
    keys = [triple_keys(s) ^ np.uint64((k + 1) * MIX[3] & 0xFFFFFFFFFFFFFFFF) for k, s in enumerate(sequences) if len(s) > 2]
    out: list[list[tuple[int, int]]] = [[] for _ in sequences]
    if keys:
        # A place between two texts, with a key of its own, keeps stretches apart.
        ends = np.cumsum(sizes[sizes > 0])
        flat = np.insert(np.concatenate(keys), ends, np.uint64(0) + np.arange(len(ends), dtype=np.uint64))
        owner = np.flatnonzero(sizes > 0)
        begins = np.append(0, ends[:-1] + np.arange(1, len(ends)))
        for a, b in stretches(flat):
            k = int(np.searchsorted(begins, a, side="right")) - 1
            out[owner[k]].append((a - int(begins[k]), b - int(begins[k])))
    return out


@query("op12_periodic_runs")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return detect(table(spark, folder, "documents"), repeat=True)
