"""Byte-level BPE on whole texts by speculation: propose, verify pairs, merge only what fails.

Each distinct piece of the split text is first cut by greedy longest match. A sequence of tokens is what BPE makes
of it exactly if every two neighbours are compatible, which is tested for all pairs of a batch at once in numpy.
Pieces with an incompatible pair are merged exactly, by rank. Pieces repeat, so their tokens are kept in a bounded
memo of the worker; texts run through whole, a bounded number of pieces at a time.

Null texts count as empty and have no ids. Strings of special tokens in a text become their ids, as in the
``tokenizers`` library. Null ids in ``decode`` give an empty text. A column that is already named as the result is
replaced; other columns pass unchanged. Repeated rows give repeated results; empty tables give empty tables.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

from .shared import light_batches, query, table, word_runs

#: Fixed value: how byte-level vocabularies split a text before any merge.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Distinct pieces a worker remembers; at this number it starts afresh. Longer pieces are not remembered.
MEMO = 1 << 18
MEMO_CHARS = 64
#: Pieces up to this many bytes are merged in a list, longer ones with a heap.
SHORT = 64


def printable_bytes() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Codec:
    """Encoder and decoder of one vocabulary file in the JSON form of the ``tokenizers`` library."""

    def __init__(self, raw: bytes):
        spec = json.loads(raw)
        model, added = spec["model"], spec.get("added_tokens", [])
        if model["type"] != "BPE" or spec.get("normalizer") or spec["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError("only plain byte-level BPE vocabularies are supported")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
            raise ValueError("special tokens that take neighbours in are not supported")
        letters = printable_bytes()
        vocab = model["vocab"]
        size = 1 + max([*vocab.values(), *(t["id"] for t in added)])
        self.bytes = [b""] * size
        for token, i in vocab.items():
            self.bytes[i] = bytes(letters[c] for c in token)
        self.special = {t["content"]: t["id"] for t in added}
        for text, i in self.special.items():
            self.bytes[i] = text.encode()
        longest_first = sorted(self.special, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if self.special else None
        self.split = regex.compile(SPLIT)
        self.names = [str(i) for i in range(size)]
        # Inside, a token is its rank: bytes are 0 to 255, merge k makes 256 + k.
        self.outer = np.zeros(256 + len(model["merges"]), dtype=np.int64)
        rank: dict[bytes, int] = {}
        for letter, b in letters.items():
            rank[bytes([b])] = b
            self.outer[b] = vocab[letter]
        self.left = np.arange(len(self.outer))
        self.right = np.arange(len(self.outer))
        self.merge: dict[tuple[int, int], int] = {}
        for k, pair in enumerate(model["merges"]):
            x, y = (bytes(letters[c] for c in part) for part in (pair if isinstance(pair, list) else pair.split(" ")))
            made = 256 + k
            self.left[made], self.right[made] = rank[x], rank[y]
            self.merge[rank[x], rank[y]] = made
            rank[x + y] = made
            self.outer[made] = vocab["".join(pair) if isinstance(pair, list) else pair.replace(" ", "")]
        self.rank = rank
        self.reach: dict[bytes, int] = {}  # longest token that begins with two bytes
        for t in rank:
            self.reach[t[:2]] = max(len(t), self.reach.get(t[:2], 1))
        keys = np.array([a << 32 | b for a, b in self.merge], dtype=np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_made = keys[order], np.array([*self.merge.values()], dtype=np.int64)[order]
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.starts, self.sizes, self.ids, self.used = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, np.int32), 0

    def propose(self, piece: bytes) -> list[int]:
        """Tokens by greedy longest match."""
        out, at, n, rank = [], 0, len(piece), self.rank
        while at < n:
            for size in range(min(n - at, self.reach.get(piece[at : at + 2], 1)), 0, -1):
                if (token := rank.get(piece[at : at + size])) is not None:
                    out.append(token)
                    at += size
                    break
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether BPE leaves the border between each two neighbouring tokens alone.

        The merges of both tokens are undone in reverse order of rank; a merge across the border that would have come
        before the one undone last makes the pair incompatible.
        """
        a, b, good = a.copy(), b.copy(), np.ones(len(a), dtype=bool)
        limit = np.full(len(a), np.iinfo(np.int64).max)
        live = np.arange(len(a))
        while len(live):
            x, y, most = a[live], b[live], limit[live]
            key = x << 32 | y
            found = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            across = (self.pair_keys[found] == key) & (self.pair_made[found] < most)
            good[live[across]] = False
            whole_x, whole_y = x < 256, y < 256
            first = np.where(whole_x, False, np.where(whole_y, True, x > y))
            keep = ~across & ~(whole_x & whole_y)
            limit[live] = np.where(first, x, y + 1)
            a[live] = np.where(first, self.right[x], x)
            b[live] = np.where(first, y, self.left[y])
            live = live[keep]
        return good

    def merge_exactly(self, piece: bytes) -> list[int]:
        """Tokens of one piece by merging the pair of lowest rank, leftmost first."""
        token, n = list(piece), len(piece)
        if n <= SHORT:
            none = len(self.outer)
            made = [self.merge.get(pair, none) for pair in zip(token, token[1:])]
            while made and (best := min(made)) < none:
                i = made.index(best)
                token[i : i + 2] = [best]
                del made[i]
                if i:
                    made[i - 1] = self.merge.get((token[i - 1], best), none)
                if i < len(made):
                    made[i] = self.merge.get((best, token[i + 1]), none)
            return token
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(made, i, token[i], token[i + 1]) for i in range(n - 1) if (made := self.merge.get((token[i], token[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            made, i, x, y = heapq.heappop(heap)
            j = after[i]
            if token[i] != x or j >= n or token[j] != y:
                continue
            token[i], token[j], after[i] = made, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (more := self.merge.get((made, token[after[i]]))) is not None:
                    heapq.heappush(heap, (more, i, made, token[after[i]]))
            if before[i] >= 0 and (more := self.merge.get((token[before[i]], made))) is not None:
                heapq.heappush(heap, (more, before[i], token[before[i]], made))
        return [t for t in token if t >= 0]

    def learn(self, pieces: Sequence[str]) -> list[np.ndarray]:
        """Tokens of distinct pieces: proposals that pass the test, exact merges for the others."""
        raw = [p.encode() for p in pieces]
        tokens = [self.propose(p) for p in raw]
        flat = np.array([t for ts in tokens for t in ts], dtype=np.int64)
        ends = np.cumsum([len(ts) for ts in tokens])
        if len(flat) > 1:
            pairs, back = np.unique(flat[:-1] << 32 | flat[1:], return_inverse=True)
            bad = ~self.compatible(pairs >> 32, pairs & 0xFFFFFFFF)[back]
            bad[ends[:-1] - 1] = False  # between two pieces
            for k in np.unique(np.searchsorted(ends, np.flatnonzero(bad), side="right")):
                tokens[k] = self.merge_exactly(raw[k])
        return [self.outer[ts] for ts in tokens]

    def remember(self, pieces: Sequence[str]) -> None:
        known = [p for p in pieces if p in self.special]
        made = [np.array([self.special[p]]) for p in known]
        if known:
            pieces = [p for p in pieces if p not in self.special]
        for p, ids in zip([*pieces, *known], [*self.learn(pieces), *made]):
            k = len(self.place)
            if k == len(self.starts):
                self.starts, self.sizes = np.resize(self.starts, 2 * k), np.resize(self.sizes, 2 * k)
            while self.used + len(ids) > len(self.ids):
                self.ids = np.resize(self.ids, 2 * len(self.ids))
            self.starts[k], self.sizes[k] = self.used, len(ids)
            self.ids[self.used : self.used + len(ids)] = ids
            self.used += len(ids)
            self.place[p] = k

    def ids_of(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a run of pieces, one after another, and how many each piece has."""
        new = set(pieces).difference(self.place)
        if len(self.place) + len(new) > MEMO:
            self.forget()
            new = set(pieces)
        long = {p for p in new if len(p) > MEMO_CHARS and p not in self.special}
        if long:  # rare: the run is cut at its long pieces
            out, begin = [], 0
            for i, p in enumerate(pieces):
                if p in long:
                    ids = self.learn([p])[0].astype(np.int32)
                    out += [self.ids_of(pieces[begin:i]), (ids, np.array([len(ids)]))]
                    begin = i + 1
            out.append(self.ids_of(pieces[begin:]))
            return np.concatenate([x for x, _ in out]), np.concatenate([n for _, n in out])
        self.remember([*new])
        k = np.fromiter(map(self.place.__getitem__, pieces), np.int64, len(pieces))
        sizes = self.sizes[k]
        total = int(sizes.sum())
        before = np.cumsum(sizes) - sizes
        return self.ids[np.repeat(self.starts[k] - before, sizes) + np.arange(total)], sizes

    def runs(self, text: str) -> Iterator[list[str]]:
        """The pieces of a text, and special tokens as pieces of their own, in bounded lists."""
        for part in self.cut.split(text) if self.cut else [text]:
            if part in self.special:
                yield [part]
            elif part:
                yield from word_runs(self.split, part)

    def encode(self, text: str) -> Iterator[np.ndarray]:
        """Ids of a text in runs, for texts of any length."""
        for run in self.runs(text):
            yield self.ids_of(run)[0]

    def encode_all(self, texts: Sequence[str]) -> list[np.ndarray]:
        """Ids of a group of texts of moderate length."""
        pieces: list[str] = []
        ends = [0]
        for t in texts:
            for run in self.runs(t):
                pieces += run
            ends.append(len(pieces))
        ids, sizes = self.ids_of(pieces)
        at = np.append(0, np.cumsum(sizes))[ends]
        return [ids[i:j] for i, j in zip(at[:-1], at[1:])]

    def decode(self, ids: Sequence[int]) -> str:
        return b"".join([self.bytes[i] for i in ids]).decode("utf-8", errors="replace")


_CODECS: dict[str, Codec] = {}


def _codec(raw: bytes) -> Codec:
    name = hashlib.sha256(raw).hexdigest()
    if name not in _CODECS:
        _CODECS.clear()
        _CODECS[name] = Codec(raw)
    return _CODECS[name]


def vocabulary(spark: SparkSession, path: str) -> Broadcast:
    """The vocabulary file for the tasks; its size does not depend on the data."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def _with(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    kept = [(n, c) for n, c in zip(batch.schema.names, batch.columns) if n != name]
    return pa.RecordBatch.from_arrays([*(c for _, c in kept), values], names=[*(n for n, _ in kept), name])


def _schema(df: DataFrame, name: str, kind: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != name), f"`{name}` {kind}"])


def _encoded(codec: Codec, batch: pa.RecordBatch, text: str, ids: str) -> Iterator[tuple[pa.RecordBatch, list[str], list[np.ndarray]]]:
    """Slices of a batch, about a megabyte of texts each, with their ids; also their texts and the ids as arrays."""
    column = batch.column(batch.schema.names.index(text))
    sizes = pc.fill_null(pc.utf8_length(column), 0).to_pylist()
    for i, j in light_batches([range(n) for n in sizes]):
        texts = [t or "" for t in column.slice(i, j - i).to_pylist()]
        made = codec.encode_all(texts) if j - i > 1 else [np.concatenate([*codec.encode(texts[0]), np.zeros(0, np.int32)])]
        offsets = np.cumsum([0, *map(len, made)])
        values = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(made), pa.int32()))
        yield _with(batch.slice(i, j - i), ids, values), texts, made


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """The rows with the ids of their texts."""
    raw = vocabulary(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(raw.value)
        for batch in batches:
            for out, _, _ in _encoded(codec, batch, text, ids):
                yield out

    return docs.mapInArrow(run, _schema(docs, ids, "array<int>"))


def encode_checked(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", n: str = "n_tokens", exact: str = "exact") -> DataFrame:
    """As ``encode``, with the number of ids and whether they decode to the text again; without the text itself.

    One Python worker a task does all three.
    """
    raw = vocabulary(docs.sparkSession, path)
    kept = [c for c in docs.columns if c not in (text, ids, n, exact)]
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept), f"`{ids}` array<int>, `{n}` long, `{exact}` boolean"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(raw.value)
        for batch in batches:
            for out, texts, made in _encoded(codec, batch, text, ids):
                same = [codec.decode(x.tolist()) == t for x, t in zip(made, texts)]
                lengths = pa.array([len(x) for x in made], pa.int64())
                columns = [*(out.column(out.schema.names.index(c)) for c in [*kept, ids]), lengths, pa.array(same, pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, ids, n, exact])

    return docs.mapInArrow(run, schema)


def decode(rows: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """The rows with the texts of their ids; bytes that are no UTF-8 become replacement letters."""
    raw = vocabulary(rows.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(raw.value)
        for batch in batches:
            lists = batch.column(batch.schema.names.index(ids)).to_pylist()
            yield _with(batch, text, pa.array([codec.decode(x or []) for x in lists], pa.string()))

    return rows.mapInArrow(run, _schema(rows, text, "string"))


def round_trip(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: token count, digest of the ids (decimal, joined by commas) and of the text decoded from them."""
    raw = vocabulary(docs.sparkSession, path)
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(raw.value)
        for batch in batches:
            counts, of_ids, of_texts = [], [], []
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for i, j in light_batches(texts):
                for ids in ([x] for x in codec.encode_all(texts[i:j])) if j - i > 1 else [codec.encode(texts[i])]:
                    n, named, decoded, tail = 0, hashlib.sha256(), hashlib.sha256(), b""
                    for part in ids:
                        some = part.tolist()
                        if some:
                            named.update((("," if n else "") + ",".join([codec.names[k] for k in some])).encode())
                            n += len(some)
                            tail += b"".join([codec.bytes[k] for k in some])
                            whole = _whole_letters(tail)
                            decoded.update(tail[:whole].decode("utf-8", errors="replace").encode())
                            tail = tail[whole:]
                    decoded.update(tail.decode("utf-8", errors="replace").encode())
                    counts.append(n)
                    of_ids.append(named.hexdigest())
                    of_texts.append(decoded.hexdigest())
            made = [pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_texts, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(key, text).mapInArrow(run, schema)


def _whole_letters(raw: bytes) -> int:
    """Length up to the start of a letter that may go on after the end."""
    for back in range(1, min(4, len(raw)) + 1):
        byte = raw[-back]
        if byte >= 0xC0:
            return len(raw) - back if back < (2 if byte < 0xE0 else 3 if byte < 0xF0 else 4) else len(raw)
        if byte < 0x80:
            break
    return len(raw)


def byte_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op4_bpe_round_trip")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return round_trip(table(spark, folder, "documents"), byte_bpe_path())
