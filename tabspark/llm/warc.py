"""WARC archives written and read by Spark, as tables of record chunks.

A payload becomes rows (record, chunk number, text of at most ``chunk_chars`` letters), and every row is one WARC
record: the first a response, the others its continuations, as WARC segments them. So no archive record is larger than
a chunk, whatever the payload. Spark's text writer puts the rows into gzip archives of at most ``per_file`` rows. The
reader takes archives apart as a stream, in tasks; records whose chunks are not together in one archive are brought
together by record and chunk number, and digests go on from chunk to chunk, so that no task holds a whole payload.

Payloads that occur more than once are stored once: of the records with equal payloads (same SHA-1 and length) of at
least ``revisit_from`` bytes the one with the largest id is a response and the others revisit it. Rows that share that
largest id are responses all. A null payload is empty; a null id never wins and revisits if another id does; a null
address is written as the record's own name, and control characters in addresses are percent-encoded. Repeated rows
become records of their own. Empty tables give archives without records. Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import query, salted_join, shared_folder, stored, table

CHUNK_CHARS = 1 << 16
PER_FILE = 4096
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"


def base32(hex40: Column) -> Column:
    """Upper-case base32 of a digest of 40 hex digits, five bytes at a time."""
    parts = [F.lpad(F.conv(F.substring(hex40, k, 10), 16, 32), 8, "0") for k in (1, 11, 21, 31)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def plan_records(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", revisit_from: int = 0) -> DataFrame:
    """Rows to archive: id, url, html (null for revisits), n_bytes, digest, refers_to (null for responses)."""
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(
        F.col(key).cast("long").alias("id"),
        F.col(url).cast("string").alias("url"),
        F.coalesce(F.col(html), F.lit("")).alias("html"),
        F.octet_length(payload).cast("long").alias("n_bytes"),
        base32(F.sha1(payload)).alias("digest"),
    ).withColumn("same", F.concat("digest", F.lit(":"), "n_bytes"))
    groups = rows.where(F.col("n_bytes") >= revisit_from).groupBy("same").agg(F.max("id").alias("winner"), F.count("*").alias("_n"))
    repeated = stored(groups.where("_n > 1 and winner is not null"))
    revisit = F.col("winner").isNotNull() & ~F.col("id").eqNullSafe(F.col("winner"))
    return salted_join(rows, repeated.drop("_n"), "same", "left", repeated.select("same", "_n"), pages.count()).select(
        "id",
        "url",
        F.when(~revisit, F.col("html")).alias("html"),
        "n_bytes",
        "digest",
        F.when(revisit, F.col("winner")).alias("refers_to"),
    )


def _clean(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def _record(headers: list[tuple[str, object]], block: str) -> str:
    """One WARC record as text without its last line end, which the writer adds."""
    fields = [*headers, ("Content-Length", len(block.encode()))]
    return "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n" + block + "\r\n"


def _to_records(date: str, chunk_chars: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, size = [], 0
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                known = not pd.isna(row.id)
                name = f"urn:page:{int(row.id) if known else ''}:{row.seq}"
                common = [("WARC-Record-ID", f"<{name}>"), ("WARC-Date", date), ("WARC-Target-URI", _clean(row.url) if isinstance(row.url, str) else name)]
                common += [("WARC-Payload-Digest", f"sha1:{row.digest}"), ("Content-Type", "application/http; msgtype=response")]
                if not pd.isna(row.refers_to):
                    profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
                    more = [("WARC-Type", "revisit"), ("WARC-Profile", profile), ("WARC-Refers-To", f"<urn:page:{int(row.refers_to)}>")]
                    out.append(_record(more + common, HTTP.format(row.n_bytes)))
                    size += len(out[-1])
                else:
                    html = row.html or ""
                    starts = range(0, max(1, len(html)), chunk_chars)
                    for k, at in enumerate(starts):
                        chunk = html[at : at + chunk_chars]
                        if k == 0:
                            segment = [("WARC-Segment-Number", 1)] if len(starts) > 1 else []
                            out.append(_record([("WARC-Type", "response"), *common, *segment], HTTP.format(row.n_bytes) + chunk))
                        else:
                            total = [("WARC-Segment-Total-Length", row.n_bytes + len(HTTP.format(row.n_bytes)))] if k + 1 == len(starts) else []
                            ids = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<{name}:{k + 1}>"), ("WARC-Date", date)]
                            out.append(_record([*ids, ("WARC-Segment-Origin-ID", f"<{name}>"), ("WARC-Segment-Number", k + 1), *total], chunk))
                        size += len(out[-1])
                        if size > 1 << 22:
                            yield pd.DataFrame({"value": out})
                            out, size = [], 0
        yield pd.DataFrame({"value": out}, dtype=object)

    return run


def write(records: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z", chunk_chars: int = CHUNK_CHARS, per_file: int = PER_FILE) -> None:
    """Archives under ``path`` of what ``plan_records`` gives."""
    rows = records.withColumn("seq", F.monotonically_increasing_id()).mapInPandas(_to_records(date, chunk_chars), "value string")
    rows.write.option("lineSep", "\r\n").option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


class _Stream:
    """Bytes of a gzip archive, as asked for; holds a little more than the longest request."""

    def __init__(self, raw: bytes):
        self.raw, self.at, self.zip, self.held = memoryview(raw), 0, zlib.decompressobj(31), bytearray()

    def _more(self) -> bool:
        if self.zip.eof:
            rest = self.zip.unused_data
            if not rest and self.at >= len(self.raw):
                return False
            self.zip = zlib.decompressobj(31)  # the next member
            self.held += self.zip.decompress(rest)
            return True
        if self.zip.unconsumed_tail:
            self.held += self.zip.decompress(self.zip.unconsumed_tail, 1 << 20)
        elif self.at < len(self.raw):
            self.held += self.zip.decompress(self.raw[self.at : self.at + (1 << 16)], 1 << 20)
            self.at += 1 << 16
        else:
            return False
        return True

    def line(self) -> bytes | None:
        """Up to the next line end; None at the end of the archive."""
        seen = 0
        while (k := self.held.find(b"\r\n", seen)) < 0:
            seen = max(0, len(self.held) - 1)
            if not self._more():
                return None
        out = bytes(self.held[:k])
        del self.held[: k + 2]
        return out

    def take(self, n: int) -> bytes:
        while len(self.held) < n:
            if not self._more():
                raise ValueError("an archive ends inside a record")
        out = bytes(self.held[:n])
        del self.held[:n]
        return out


def _headers(stream: _Stream) -> dict[str, str]:
    out = {}
    while line := stream.line():
        k, _, v = line.decode().partition(":")
        out[k.strip().lower()] = v.strip()
    return out


CHUNKS = "rec string, chunk_no long, last boolean, record_type string, refers_to string, digest string, n_bytes long, payload binary"


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [c.split()[0] for c in CHUNKS.split(", ")]
    for pdf in batches:
        for raw in pdf["content"]:
            stream, out, size = _Stream(raw), [], 0
            while (line := stream.line()) is not None:
                if not line:
                    continue
                if not line.startswith(b"WARC/"):
                    raise ValueError(f"no WARC record begins with {line[:40]!r}")
                h = _headers(stream)
                block = stream.take(int(h["content-length"]))
                kind = h["warc-type"]
                digest = h.get("warc-payload-digest", "").removeprefix("sha1:") or None
                if kind == "continuation":
                    rec, last = h["warc-segment-origin-id"], "warc-segment-total-length" in h
                    row = [rec, int(h["warc-segment-number"]), last, None, None, None, 0, block]
                elif kind in ("response", "revisit"):
                    head, _, payload = block.partition(b"\r\n\r\n")
                    n = int(re.search(rb"(?im)^content-length:\s*(\d+)", head)[1])
                    whole = "warc-segment-number" not in h
                    if whole and kind == "response":  # its digest is checked here, and its bytes go no further
                        if _digest(hashlib.sha1(payload)) != digest or len(payload) != n:
                            raise ValueError(f"{h['warc-record-id']}: the payload is damaged")
                        payload = b""
                    row = [h["warc-record-id"], 1, whole, kind, h.get("warc-refers-to"), digest, n, payload]
                else:
                    continue
                out.append(row)
                size += 500 + len(row[-1])
                if size > 1 << 22:
                    yield pd.DataFrame(out, columns=columns)
                    out, size = [], 0
            if out:
                yield pd.DataFrame(out, columns=columns)


def _digest(sha: object) -> str:
    return base64.b32encode(sha.digest()).decode()


READ = "rec string, record_type string, refers_to string, payload_digest string, payload_bytes long"


def _join_chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows in the order of record and chunk: one row per record; digests go on over chunks and batches."""
    rec = sha = first = None
    n = expected = 0
    for pdf in batches:
        out = []
        for row in pdf.itertuples(index=False):
            if row.chunk_no == 1:
                if sha is not None:
                    raise ValueError(f"{rec}: the last chunk is missing")
                if row.last:
                    out.append((row.rec, row.record_type, row.refers_to, row.digest, row.n_bytes))
                    continue
                rec, sha, first, n, expected = row.rec, hashlib.sha1(row.payload), row, len(row.payload), 2
                continue
            if sha is None or row.rec != rec or row.chunk_no != expected:
                raise ValueError(f"{row.rec}: chunk {expected} is missing")
            sha.update(row.payload)
            n, expected = n + len(row.payload), expected + 1
            if row.last:
                if _digest(sha) != first.digest or n != first.n_bytes:
                    raise ValueError(f"{rec}: the payload is damaged")
                out.append((rec, first.record_type, first.refers_to, first.digest, n))
                sha = None
        yield pd.DataFrame(out, columns=[c.split()[0] for c in READ.split(", ")])
    if sha is not None:
        raise ValueError(f"{rec}: the last chunk is missing")


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The chunk table of the archives: one row per WARC record; payload bytes only of records in several chunks."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select("content").mapInPandas(_parse, CHUNKS)


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per archived page: page_id, payload_bytes, payload_digest, record_type, refers_to; digests are checked."""
    ordered = read_chunks(spark, path).repartition("rec").sortWithinPartitions("rec", "chunk_no")
    number = lambda c: F.regexp_extract(c, r"urn:page:(-?\d+)", 1).try_cast("long")
    return ordered.mapInPandas(_join_chunks, READ).select(
        number("rec").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to")
    )


OP9_SQL = """with p as (select page_id, octet_length(encode(coalesce(html, ''))) as n, sha1(coalesce(html, '')) as d from pages),
  w as (select d, n, max(page_id) as winner from p group by d, n),
  b as (select p.page_id, p.n, p.d, w.winner from p join w using (d, n)),
  c as (select page_id, n, winner, d, [substr(d, 1 + 10 * k, 10) for k in range(4)] as parts from b),
  v as (select page_id, n, winner, [('0x' || x)::ubigint for x in parts] as nums from c)
select page_id, n as payload_bytes,
  array_to_string([array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((x >> (35 - 5 * k)) & 31)::int, 1)
    for k in range(8)], '') for x in nums], '') as payload_digest,
  case when page_id = winner then 'response' else 'revisit' end as record_type,
  case when page_id = winner then null else winner end as refers_to from v"""


@query("op9_warc", OP9_SQL)
def op9(spark: SparkSession, folder: str) -> DataFrame:
    path = shared_folder(spark) + "/warc"
    write(plan_records(table(spark, folder, "pages")), path)
    return read(spark, path)
