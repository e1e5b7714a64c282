"""Token-id files: documents in the order of their ids, in blocks coded by a static range asymmetric numeral system.

Format. A folder holds ``table`` (one file with the shared frequency table) and ``blocks`` (shards, each a row of
blocks). All frames begin with ``MAGIC``, a kind byte, the length and the crc32 of their body.

* Table: bits of the frequency total, vocabulary size, frequencies (32-bit). Its crc32 names it in every block.
* Block: up to ``BLOCK`` ids of consecutive documents of a shard. ``LANES`` interleaved coders share the table and one
  stream of 32-bit words. A block needs nothing of its neighbours. It lists its documents (id, ids in this block) and
  how many ids its last one has in later blocks. Every ``SEGMENT`` ids a checkpoint holds the states of all lanes and the place in
  the stream, with the crc32 of the ids up to the next one: segments are decoded independently, in any order.

Writing: texts are encoded once and stored as pieces; exact frequencies come from the counts each task stores with its
pieces (at most one for each entry of the vocabulary), so the pieces are not read for them; pieces are range-partitioned by
(doc_id, hash of the text, row, piece), so one id or one long text may fill many shards, and each task streams its sorted
pieces into blocks. Files hold at most ``PER_FILE`` blocks. Reading: each file gives rows of segments, each segment the share
of its documents. A crc32 is linear, so the shares of a document are moved by the number of bytes behind them and joined by
exclusive or, in any order.

Null and empty texts have no ids but the end id. Rows without an id come first; equal ids are ordered by their texts'
hashes, equal rows are written as often as they are there. Only the key and the text are read, other columns don't
matter. An empty table gives a table frame, no block, and reads back as no row. A damaged frame, stream or segment raises
``ValueError``. Long texts are held whole, as ids, while they are encoded, and nowhere later.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import byte_bpe_path, vocabulary
from .library_bpe import byte_codec
from .shared import light_batches, query, shared_folder, stored, table

MAGIC = b"TIDS"
LANES = 256
SEGMENT = 1 << 16
BLOCK = 1 << 18
#: Blocks of a file; a file is at most about 40 MB and is read as one value.
PER_FILE = 64
#: Bits of the frequency total, and the least state: states stay in [LOW, LOW << 32).
BITS = 22
LOW = 1 << 31
#: Ids of a shard, and most shards: beyond that shards grow (their files don't).
SHARD_IDS = 1 << 22
MOST_SHARDS = 20_000
#: Ids of a stored piece.
PIECE = 1 << 16
#: Stands for the number of a piece in the rows that hold a task's counts.
COUNTS = -1
END_ID = 2


# crc32 of joined byte strings


def _times(a: int, b: int) -> int:
    """Product of two polynomials modulo that of crc32, bits reflected."""
    out = 0
    for _ in range(32):
        if a & 0x80000000:
            out ^= b
        a = a << 1 & 0xFFFFFFFF
        b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
    return out


def moved(crc: int, n: int) -> int:
    """What the crc32 of bytes adds to that of the bytes with ``n`` others behind them."""
    power, factor = 0x00800000, 0x80000000  # x**8, 1
    while n:
        if n & 1:
            factor = _times(factor, power)
        power, n = _times(power, power), n >> 1
    return _times(factor, crc)


# frequency tables and the coder


def normalised(counts: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Frequencies that add up to 2**bits, at least 1 for every id that occurs; the same for the same counts."""
    total, whole = sum(counts.tolist()), 1 << bits
    if not total:
        return np.zeros(len(counts), np.uint32)
    if np.count_nonzero(counts) > whole:
        raise ValueError("more ids than the frequency total has room for")
    freq = np.array([max(1, c * whole // total) if c else 0 for c in counts.tolist()], np.int64)
    order = np.lexsort((np.arange(len(freq)), -freq))
    rest = whole - int(freq.sum())
    if rest > 0:
        freq[order[0]] += rest
    for k in order:
        if rest >= 0:
            break
        step = min(-rest, int(freq[k]) - 1)
        freq[k] -= step
        rest += step
    return freq.astype(np.uint32)


class Coder:
    """Interleaved coders with one static table."""

    def __init__(self, freq: np.ndarray, bits: int = BITS):
        self.bits, self.freq = bits, freq.astype(np.uint64)
        self.before = np.cumsum(self.freq, dtype=np.uint64) - self.freq

    @cached_property
    def slots(self) -> np.ndarray:
        """The id of each value below the total; only decoding needs it."""
        return np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))

    def encode(self, ids: np.ndarray, segment: int, lanes: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
        """The words of a block and, for the start of each segment, (place in the words, states).

        Ids are coded from the last to the first; id i belongs to lane i modulo ``lanes``.
        """
        freq, before = self.freq[ids], self.before[ids]
        if len(ids) and not freq.min():
            raise ValueError("an id has no frequency")
        most = freq << np.uint64(63 - self.bits)
        # (q << bits) + x - q * f is x + q * rest
        rest = np.uint64(1 << self.bits) - freq
        states, quotients, fulls = np.full(lanes, LOW, np.uint64), np.empty(lanes, np.uint64), np.empty(lanes, bool)
        stream = np.empty(len(ids), np.uint32)  # filled from its end; an id gives one word at most
        marks: list[tuple[int, np.ndarray]] = []
        low, place = np.uint64(32), len(ids)
        for at in range((len(ids) - 1) // lanes * lanes, -1, -lanes):
            end = min(at + lanes, len(ids))
            x, q, full = states[: end - at], quotients[: end - at], fulls[: end - at]
            np.greater_equal(x, most[at:end], out=full)
            lane = full.nonzero()[0]
            if len(lane):
                given = x[lane]
                stream[place - len(lane) : place] = given  # the lower 32 bits
                place -= len(lane)
                x[lane] = given >> low
            np.floor_divide(x, freq[at:end], out=q)
            np.multiply(q, rest[at:end], out=q)
            np.add(x, before[at:end], out=x)
            np.add(x, q, out=x)
            if at % segment == 0:
                marks.append((place, states.copy()))
        return stream[place:], [(p - place, s) for p, s in marks[::-1]]

    def decode(self, words: np.ndarray, state: np.ndarray, n: int) -> np.ndarray:
        """The next ``n`` ids from a checkpoint; ``words`` begins at its place in the stream."""
        lanes, states, at = len(state), state.astype(np.uint64), 0
        out = np.zeros(n, np.uint32)
        places = np.empty(lanes, np.uint64)
        shift, low, mask, least = np.uint64(self.bits), np.uint64(32), np.uint64((1 << self.bits) - 1), np.uint64(LOW)
        wide = words.astype(np.uint64)
        for begin in range(0, n, lanes):
            end = min(begin + lanes, n)
            x, slot = states[: end - begin], places[: end - begin]
            np.bitwise_and(x, mask, out=slot)
            out[begin:end] = self.slots.take(slot.view(np.int64))
            ids = out[begin:end].astype(np.int64)
            np.right_shift(x, shift, out=x)
            np.multiply(x, self.freq.take(ids), out=x)
            np.add(x, slot, out=x)
            np.subtract(x, self.before.take(ids), out=x)
            short = (x < least).nonzero()[0]
            if len(short):
                if at + len(short) > len(wide):
                    raise ValueError("a stream ends too early")
                x[short] = x[short] << low | wide[at : at + len(short)]
                at += len(short)
        return out


# frames

_FRAME = struct.Struct("<4scQI")
_TABLE = struct.Struct("<BI")
_BLOCK = struct.Struct("<IQQQIHIQQI")


def _frame(kind: bytes, body: bytes) -> bytes:
    return _FRAME.pack(MAGIC, kind, len(body), zlib.crc32(body)) + body


def frames(raw: memoryview) -> Iterator[tuple[bytes, memoryview]]:
    """(kind, body) of the frames of a file; the writer ends each with a line end."""
    at = 0
    while at < len(raw):
        if len(raw) - at < _FRAME.size:
            raise ValueError("a file ends inside a frame")
        magic, kind, n, crc = _FRAME.unpack_from(raw, at)
        body = raw[at + _FRAME.size : at + _FRAME.size + n]
        if magic != MAGIC or len(body) != n or zlib.crc32(body) != crc:
            raise ValueError("a frame is damaged")
        yield kind, body
        at += _FRAME.size + n + 1


def table_frame(freq: np.ndarray, bits: int = BITS) -> bytes:
    return _frame(b"T", _TABLE.pack(bits, len(freq)) + freq.astype("<u4").tobytes())


def read_table(raw: bytes) -> tuple[np.ndarray, int, int]:
    """(frequencies, bits, name) of a table file."""
    (kind, body), = frames(memoryview(raw))
    if kind != b"T":
        raise ValueError("no table frame")
    bits, n = _TABLE.unpack_from(body)
    return np.frombuffer(body, "<u4", n, _TABLE.size), bits, zlib.crc32(body)


def block_frame(coder: Coder, name: int, shard: int, first_doc: int, at: int, ids: np.ndarray, docs: list, after: int, segment: int, lanes: int) -> bytes:
    """A block: ``docs`` lists (doc_id or None, ids in this block); the last has ``after`` more ids in later blocks."""
    words, marks = coder.encode(ids, segment, lanes)
    crcs = [zlib.crc32(ids[k : k + segment].astype("<u4").tobytes()) for k in range(0, len(ids), segment)]
    known = np.array([d is not None for d, _ in docs], np.uint8)
    listed = zlib.compress(
        known.tobytes() + np.array([d or 0 for d, _ in docs], "<i8").tobytes() + np.array([n for _, n in docs], "<u4").tobytes(), 1
    )
    head = _BLOCK.pack(name, shard, first_doc, at, len(ids), lanes, segment, len(docs), after, len(listed))
    places = np.array([p for p, _ in marks], "<u4").tobytes()
    states = np.concatenate([s for _, s in marks]).astype("<u8").tobytes()
    return _frame(b"B", head + listed + places + np.array(crcs, "<u4").tobytes() + states + words.astype("<u4").tobytes())


SEGMENTS = (
    "table_crc long, shard long, at long, n long, crc long, states binary, words binary, "
    "first_doc long, doc_ids binary, known binary, counts binary, after long"
)
_SEGMENT_NAMES = [c.strip().split()[0] for c in SEGMENTS.split(",")]


def segments_of(body: memoryview) -> Iterator[tuple]:
    """Rows of a block's segments (see ``SEGMENTS``): what each needs to be decoded alone, and its documents' shares."""
    name, shard, first_doc, at, n, lanes, segment, n_docs, after, n_listed = _BLOCK.unpack_from(body)
    place = _BLOCK.size
    listed = zlib.decompress(body[place : place + n_listed])
    place += n_listed
    known = np.frombuffer(listed, np.uint8, n_docs)
    doc_ids = np.frombuffer(listed, "<i8", n_docs, n_docs)
    counts = np.frombuffer(listed, "<u4", n_docs, 9 * n_docs).astype(np.int64)
    k = -(-n // segment)
    starts = np.frombuffer(body, "<u4", k, place)
    crcs = np.frombuffer(body, "<u4", k, place + 4 * k)
    states = np.frombuffer(body, "<u8", k * lanes, place + 8 * k).reshape(k, lanes)
    words = np.frombuffer(body, "<u4", -1, place + 8 * k + 8 * k * lanes)
    ends = np.cumsum(counts)
    for i in range(k):
        low, high = i * segment, min(n, (i + 1) * segment)
        a, b = np.searchsorted(ends, low, side="right"), np.searchsorted(ends, high, side="left")
        share = np.minimum(ends[a : b + 1], high) - np.maximum(ends[a : b + 1] - counts[a : b + 1], low)
        more = int(ends[b] - high) + (after if b == n_docs - 1 else 0)
        part = words[starts[i] : starts[i + 1] if i + 1 < k else None]
        yield (
            name, shard, at + low, high - low, int(crcs[i]), states[i].tobytes(), part.tobytes(),
            first_doc + int(a), doc_ids[a : b + 1].tobytes(), known[a : b + 1].tobytes(), share.tobytes(), more,
        )


# Spark jobs


def _encoded(docs: DataFrame, path: str, key: str, text: str, end_id: int, kind: str) -> DataFrame:
    """(doc_id, hash of the text, row, piece, ids from this piece on, ids): each row's ids in pieces of ``PIECE``.

    The last row of a task is no piece but ``COUNTS``: how often each id occurs in the task's pieces, as 64-bit integers.
    """
    raw = vocabulary(docs.sparkSession, path)
    names = ["doc_id", "_hash", "_row", "_piece", "_left", "_ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = byte_codec(raw.value)
        row = TaskContext.get().partitionId() << 33
        sums = np.zeros(0, np.int64)
        for batch in batches:
            texts = [t or "" for t in batch.column(2).to_pylist()]
            keys, hashes = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, j in light_batches(texts):
                out, held = [], 0
                made = [np.append(codec.encode(content), end_id).astype(kind) for content in texts[i:j]]
                sums = added(sums, np.bincount(np.concatenate(made)))
                for key_, hash_, ids in zip(keys[i:j], hashes[i:j], made):
                    row += 1
                    for piece, k in enumerate(range(0, len(ids), PIECE)):
                        out.append((key_, hash_, row, piece, len(ids) - k, ids[k : k + PIECE].tobytes()))
                        held += len(out[-1][-1])
                        if held > 1 << 23:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
                            out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
        last = (None, None, None, COUNTS, 0, sums.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(last, types)], names=names)

    types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(text).alias("_hash"), F.col(text).alias("_text"))
    return rows.mapInArrow(run, "doc_id long, _hash long, _row long, _piece int, _left long, _ids binary")


def added(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sum of two lists of counts, the shorter one taken as zero beyond its end."""
    a, b = (a, b) if len(a) >= len(b) else (b, a)
    out = a.astype(np.int64)
    out[: len(b)] += b
    return out


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, how often) of a task: at most one row for each entry of the vocabulary."""
    sums = np.zeros(0, np.int64)
    for batch in batches:
        for counts in batch.column(0):
            sums = added(sums, np.frombuffer(counts.as_buffer(), np.int64))
    used = np.flatnonzero(sums)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(sums[used])], names=["id", "n"])


def _to_blocks(raw_table: bytes, kind: str, segment: int, block: int, lanes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freq, bits, name = read_table(raw_table)
        coder, shard = Coder(freq, bits), TaskContext.get().partitionId()
        held: list[np.ndarray] = []  # ids of the open block
        docs: list[list] = []  # its documents: [id, ids in the block]
        at = n = first_doc = 0
        row, left = None, 0  # of the last piece: its row, ids of the document that come after it

        def give(after: int) -> pa.RecordBatch:
            ids = np.concatenate(held)
            value = block_frame(coder, name, shard, first_doc, at, ids, docs, after, segment, lanes)
            return pa.RecordBatch.from_arrays([pa.array([value], pa.binary())], names=["value"])

        for batch in batches:
            for doc_id, _, this, _, more, raw in zip(*(c.to_pylist() for c in batch.columns)):
                ids = np.frombuffer(raw, kind)
                if this != row:
                    docs.append([doc_id, 0])
                row, left = this, more
                while len(ids):
                    some = ids[: block - n]
                    held.append(some)
                    docs[-1][1] += len(some)
                    n, left, ids = n + len(some), left - len(some), ids[len(some) :]
                    if n == block:
                        yield give(left)
                        at, first_doc = at + n, first_doc + len(docs) - (left > 0)
                        held, docs, n = [], [[doc_id, 0]] if left else [], 0
        if n:
            yield give(left)

    return run


def write(docs: DataFrame, folder: str, path: str, key: str = "doc_id", text: str = "text", end_id: int = END_ID,
          segment: int = SEGMENT, block: int = BLOCK, lanes: int = LANES, shard_ids: int = SHARD_IDS) -> None:
    """Token-id files of the texts under ``folder``: each text's ids and ``end_id``, in the order of the keys.

    ``segment`` and ``block`` are multiples of ``lanes``, ``block`` one of ``segment``.
    """
    if segment % lanes or block % segment:
        raise ValueError("segments hold whole rounds of lanes, blocks whole segments")
    spark = docs.sparkSession
    with open(path, "rb") as f:
        top = max(end_id, int(byte_codec(f.read()).ids.max()))
    kind = "<u2" if top < 1 << 16 else "<u4"  # of the ids between the steps, by the vocabulary alone
    encoded = stored(_encoded(docs, path, key, text, end_id, kind))
    pieces, sums = encoded.where(F.col("_piece") != COUNTS), encoded.where(F.col("_piece") == COUNTS)
    counted = sums.select("_ids").mapInArrow(_counts, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(1 + max([end_id, *counted["id"]]), np.int64)
    counts[counted["id"].to_numpy(np.int64)] = counted["n"].to_numpy(np.int64)
    frame = table_frame(normalised(counts))
    _save(spark.createDataFrame([(bytearray(frame),)], "value binary"), f"{folder}/table")
    shards = min(MOST_SHARDS, 1 + int(counts.sum()) // shard_ids)
    order = ["doc_id", "_hash", "_row", "_piece"]
    sorted_pieces = pieces.repartitionByRange(shards, *order).sortWithinPartitions(*order)
    _save(sorted_pieces.mapInArrow(_to_blocks(frame, kind, segment, block, lanes), "value binary"), f"{folder}/blocks")


def _save(frames_: DataFrame, path: str) -> None:
    """One file per shard and ``PER_FILE`` frames; the text writer passes bytes through and adds a line end."""
    frames_.select(F.col("value").cast("string")).write.option("lineSep", "\n").option("maxRecordsPerFile", PER_FILE).text(path)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64()] * 5 + [pa.binary()] * 2 + [pa.int64()] + [pa.binary()] * 3 + [pa.int64()]
    for batch in batches:
        for content in batch.column(0):
            for kind, body in frames(memoryview(content.as_buffer())):
                if kind != b"B":
                    raise ValueError("no block frame")
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*segments_of(body)), kinds)], names=_SEGMENT_NAMES)


def read_segments(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each segment of the files; each can be decoded without any other. Only frame checksums are tested here."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{folder}/blocks")
    return files.select("content").mapInArrow(_parse, SEGMENTS)


def _decoded(raw_table: bytes):
    """(shard, row of columns, ids) of each segment, its checksum tested."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, np.ndarray]]:
        freq, bits, name = read_table(raw_table)
        coder = None
        for batch in batches:
            for row in batch.to_pylist():
                coder = coder or Coder(freq, bits)
                if row["table_crc"] != name:
                    raise ValueError("a block belongs to another table")
                ids = coder.decode(np.frombuffer(row["words"], "<u4"), np.frombuffer(row["states"], "<u8"), row["n"])
                if zlib.crc32(ids.astype("<u4").tobytes()) != row["crc"]:
                    raise ValueError("a segment is damaged")
                yield row, ids

    return run


def _shares(raw_table: bytes, with_ids: bool):
    decoded = _decoded(raw_table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, ids in decoded(batches):
            known, doc_ids = np.frombuffer(row["known"], np.uint8).astype(bool), np.frombuffer(row["doc_ids"], "<i8")
            counts = np.frombuffer(row["counts"], "<i8")
            ends = np.cumsum(counts)
            raw = ids.astype("<u4")
            crcs = [zlib.crc32(raw[e - c : e].tobytes()) for e, c in zip(ends, counts)]
            crcs[-1] = moved(crcs[-1], 4 * row["after"])
            k = len(counts)
            columns = [
                pa.array(np.full(k, row["shard"], np.int64)), pa.array(row["first_doc"] + np.arange(k)), pa.array(doc_ids, mask=~known),
                pa.array(row["at"] + ends - counts), pa.array(counts), pa.array(crcs, pa.int64()),
            ]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(ids.astype(np.int32))))
            yield pa.RecordBatch.from_arrays(columns, names=["shard", "doc_no", "doc_id", "at", "n", "crc", "ids"][: len(columns)])

    return run


def _table_file(spark: SparkSession, folder: str) -> bytes:
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{folder}/table").where("length > 0").select("content").take(2)
    if len(rows) != 1:
        raise ValueError("one table file is expected")
    return bytes(rows[0][0])


def read_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """(shard, doc_no, doc_id, at, n, crc, ids): the documents' ids by segment; ``at`` is their place in the shard."""
    run = _shares(_table_file(spark, folder), True)
    return read_segments(spark, folder).mapInArrow(run, "shard long, doc_no long, doc_id long, at long, n long, crc long, ids array<int>")


def summary(spark: SparkSession, folder: str) -> DataFrame:
    """Per document, decoded from the files: doc_id, start, n_tokens, ids_crc32."""
    run = _shares(_table_file(spark, folder), False)
    shares = read_segments(spark, folder).mapInArrow(run, "shard long, doc_no long, doc_id long, at long, n long, crc long")
    docs = stored(
        shares.groupBy("shard", "doc_no").agg(
            F.first("doc_id").alias("doc_id"), F.min("at").alias("at"), F.sum("n").alias("n_tokens"), F.bit_xor("crc").alias("ids_crc32")
        )
    )
    # One row for each shard, MOST_SHARDS at most.
    sizes = docs.groupBy("shard").agg(F.sum("n_tokens").alias("_n"))
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("shard", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    return docs.join(F.broadcast(offsets), "shard").select("doc_id", (F.col("at") + F.col("_offset")).alias("start"), "n_tokens", "ids_crc32")


@query("op11_token_files")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    path = shared_folder(spark) + "/token-ids"
    write(table(spark, folder, "documents"), path, byte_bpe_path())
    return summary(spark, path)
