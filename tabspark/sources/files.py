"""File and record sources: types from first bytes, stored JSON replies, records, release notes and limit checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ordered import fill, ordered


def starts(content: Column, hex_bytes: str) -> Column:
    return F.startswith(content, F.unhex(F.lit(hex_bytes)))


def sniff(content: Column) -> Column:
    """File type from the first bytes; null for anything else."""
    head = F.substring(content, 1, 1024)
    gp = F.concat(F.lit("gp"), F.decode(F.substring(content, 22, 1), "ISO-8859-1"))
    tab_header = "18" + b"FICHIER GUITAR PRO".hex()
    versioned = F.decode(F.substring(content, 20, 4), "ISO-8859-1").rlike(r"^ v[345]\.?$")
    return (
        F.when(starts(content, tab_header) & versioned, gp)
        .when(starts(content, b"BCFZ".hex()) | starts(content, b"BCFS".hex()), "gpx")
        .when(starts(content, "504B0304"), "gp")
        .when(starts(content, b"ID3".hex()) | F.hex(F.substring(content, 1, 2)).rlike("^FF[EF][23AB]$"), "mp3")
        .when(starts(content, b"OggS".hex()), "ogg")
        .when(starts(content, b"RIFF".hex()) & (F.hex(F.substring(content, 9, 4)) == b"WAVE".hex().upper()), "wav")
        .when(starts(content, "FFD8FF"), "jpeg")
        .when(starts(content, "89504E470D0A1A0A"), "png")
        .when(starts(content, b"RIFF".hex()) & (F.hex(F.substring(content, 9, 4)) == b"WEBP".hex().upper()), "webp")
        .when(F.hex(head).contains(b"%PDF-".hex().upper()), "pdf")
    )


def file_catalog(spark: SparkSession, folder: str) -> DataFrame:
    """Files of a folder with type and size; the bytes are not kept."""
    files = spark.read.format("binaryFile").load(folder)
    return files.select("path", "length", "modificationTime", sniff(F.col("content")).alias("type"))


# Named HTML entities of stored replies.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&nbsp;": "\u00a0", "&amp;": "&"}
REFERENCE = "(?s)(&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z]+);|&|[^&]+)"
REPLY = "items array<struct<id: string, snippet: struct<title: string, channelTitle: string>>>"


def _character(part: Column) -> Column:
    """The character of a numeric reference; U+FFFD where there is none."""
    digits = F.regexp_extract(part, "^&#[xX]?([0-9a-fA-F]+);$", 1)
    point = F.conv(digits, 10, 16)
    point = F.lpad(F.when(part.rlike("^&#[xX]"), F.upper(digits)).otherwise(point), 8, "0")
    none = (point == "00000000") | (point > "0010FFFF") | point.between("0000D800", "0000DFFF")
    return F.when(none, F.lit("\ufffd")).otherwise(F.decode(F.unhex(point), "UTF-32"))


def unescape(text: Column) -> Column:
    """HTML text as plain text: numeric references and the named ones of ``ENTITIES``, in one pass, so nothing is unescaped twice.

    Other names, and references without a semicolon, stay as they are. Numbers are code points, also those from 1 to 31 and
    from 128 to 159, which browsers drop or take from another table. Null stays null.
    """
    named = F.create_map(*[F.lit(x) for pair in ENTITIES.items() for x in pair])
    parts = F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(1))
    plain = F.transform(parts, lambda p: F.when(p.rlike("^&#[xX]?[0-9a-fA-F]+;$"), _character(p)).otherwise(F.coalesce(F.try_element_at(named, p), p)))
    return F.array_join(plain, "")


def flatten_results(df: DataFrame, keys: Sequence[str], json: str) -> DataFrame:
    """Stored search replies as rows (rank, id, title, channel); items without a proper id vanish."""
    items = df.select(*keys, F.posexplode(F.from_json(json, REPLY)["items"]).alias("rank", "_i"))
    id_ = F.get_json_object("_i.id", "$.videoId")
    rows = items.select(
        *keys,
        "rank",
        id_.alias("id"),
        F.left(unescape(F.coalesce("_i.snippet.title", F.lit(""))), F.lit(200)).alias("title"),
        F.left(unescape(F.coalesce("_i.snippet.channelTitle", F.lit(""))), F.lit(100)).alias("channel"),
    )
    return rows.where(F.col("id").rlike("^[A-Za-z0-9_-]{11}$"))


def read_records(df: DataFrame, json: str, schema: str, key: str) -> DataFrame:
    """JSON details as columns; unreadable records and those without a key are left out."""
    return df.withColumn("_r", F.from_json(json, schema)).where(F.col("_r")[key].isNotNull()).select("*", "_r.*").drop("_r")


# Fixed value: heading of a release in the notes.
RELEASE = r"^## \[([0-9]+\.[0-9]+\.[0-9]+)\](?:\s*-\s*([0-9]{4}-[0-9]{2}-[0-9]{2}))?\s*$"


def release_sections(lines: DataFrame, keys: Sequence[str], line_no: str, line: str) -> DataFrame:
    """Release notes as (version, date, section, item_no, item); other headings end a release, wrapped lines join their item."""
    text = F.rtrim(line)
    heading = text.startswith("## ")
    release = F.when(
        heading, F.struct(F.nullif(F.regexp_extract(text, RELEASE, 1), F.lit("")).alias("version"), F.nullif(F.regexp_extract(text, RELEASE, 2), F.lit("")).alias("date"), F.col(line_no).alias("at"))
    )
    name = F.regexp_extract(text, r"^### (.+?)\s*$", 1)
    section = F.when(heading, F.struct(F.lit(None).cast("string").alias("name"), F.col(line_no).alias("at"))).when(
        name != "", F.struct(name.alias("name"), F.col(line_no).alias("at"))
    )
    run = ordered(lines, keys, [line_no]).with_columns(_rel=release, _sec=section).add(_r=fill("_rel"), _s=fill("_sec"))
    run = run.with_columns(_item=F.nullif(F.regexp_extract(text, r"^- (.+)$", 1), F.lit("")))
    begun = F.when(F.col("_sec").isNotNull(), F.struct(F.lit(None).cast("long").alias("at"))).when(
        F.col("_item").isNotNull(), F.struct(F.col(line_no).cast("long").alias("at"))
    )
    run = run.with_columns(_begun=begun).add(_b=fill("_begun"))
    more = F.col("_item").isNull() & text.startswith("  ") & (F.trim(line) != "")
    piece = F.coalesce("_item", F.when(more, F.concat(F.lit(" "), F.trim(line))))
    rows = run.df.where(
        F.col("_r")["version"].isNotNull() & F.col("_s")["name"].isNotNull() & F.col("_b")["at"].isNotNull() & piece.isNotNull()
    )
    parts = rows.select(*keys, F.col("_r.version"), F.col("_r.date"), F.col("_s.name").alias("section"), F.col("_b")["at"].alias("item_no"), F.struct(line_no, piece.alias("t")).alias("_p"))
    text_of = F.array_join(F.transform(F.array_sort(F.collect_list("_p")), lambda p: p["t"]), "")
    return parts.groupBy(*keys, "version", "date", "section", "item_no").agg(text_of.alias("item"))


def quarantine(df: DataFrame, keys: Sequence[str], rules: Sequence[tuple[str, Column]], total: str, total_limit: int) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with its reason): the first rule that holds, then the total per key."""
    reason = F.coalesce(*[F.when(F.coalesce(broken, F.lit(False)), F.lit(name)) for name, broken in rules])
    sums = df.groupBy(*keys).agg(F.sum(total).alias("_sum"))
    judged = df.withColumn("reason", reason).join(sums, list(keys))
    judged = judged.withColumn("reason", F.coalesce("reason", F.when(F.col("_sum") > total_limit, "total"))).drop("_sum")
    return judged.where("reason is null").drop("reason"), judged.where("reason is not null")
