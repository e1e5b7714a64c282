"""The song catalog: upserts, unique names, imports, merges and the checks around them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import number, ordered


def song_key(artist: Column, title: Column) -> Column:
    return F.lower(F.concat(F.trim(F.coalesce(artist, F.lit(""))), F.lit(" - "), F.trim(F.coalesce(title, F.lit("")))))


def upsert(catalog: DataFrame, batch: DataFrame, key: str, details: Sequence[str], kept: Sequence[str], order: str) -> DataFrame:
    """Catalog after a batch: new details win (the last row of a key), earlier files and versions stay."""
    last = batch.groupBy(key).agg(F.max_by(F.struct(*details), order).alias("_new"))
    both = catalog.join(last, key, "full_outer")
    fresh = F.col("_new").isNotNull()
    return both.select(
        key,
        *[F.when(fresh, F.col("_new")[d]).otherwise(F.col(d)).alias(d) for d in details],
        *[F.col(c) for c in kept],
        fresh.alias("written"),
    )


def assign_names(batch: DataFrame, taken: DataFrame, name: str, order: str) -> DataFrame:
    """Unique names without regard to case: X, X (2), X (3)…, leaving out the names taken.

    The rows of a base name are numbered and so are its free numbers; row k gets the k-th free number. Taken
    names block numbers of their base; a base that itself ends in " (n)" is a base of its own.
    """
    base = F.lower(name)
    rows = ordered(batch.withColumn("_base", base), ["_base"], [order]).add(_k=number()).df
    low = F.lower(name)
    head, no = F.regexp_extract(low, r"^(.*) \(([0-9]+)\)$", 1), F.regexp_extract(low, r"^(.*) \(([0-9]+)\)$", 2).try_cast("long")
    as_number = taken.where(no >= 2).select(head.alias("_base"), no.alias("_no"))
    as_first = taken.select(low.alias("_base"), F.lit(1).cast("long").alias("_no"))
    # A batch base "x (2)" takes that name before or after rows of "x": its first row holds it.
    own = rows.where(F.col("_k") == 1).select("_base").withColumn(name, F.col("_base"))
    inner = own.where(F.regexp_extract(name, r" \(([0-9]+)\)$", 1).try_cast("long") >= 2).select(
        F.regexp_extract(name, r"^(.*) \([0-9]+\)$", 1).alias("_base"), F.regexp_extract(name, r" \(([0-9]+)\)$", 1).try_cast("long").alias("_no")
    )
    blocked = as_number.unionByName(as_first).unionByName(inner).distinct().join(rows.select("_base").distinct(), "_base", "left_semi")
    # The k-th number not blocked is k plus the blocked numbers b with (b - rank of b) < k.
    ranks = ordered(blocked, ["_base"], ["_no"]).add(_r=number()).df.select("_base", (F.col("_no") - F.col("_r")).alias("_free"), "_r")
    line = rows.select("_base", (F.col("_k") - 1).alias("_at"), F.lit(1).alias("_side"), F.col(order).alias("_id"), F.lit(None).cast("long").alias("_shift"))
    marks = ranks.groupBy("_base", "_free").agg(F.max("_r").alias("_shift")).select(
        "_base", F.col("_free").alias("_at"), F.lit(0).alias("_side"), F.lit(0).cast("long").alias("_id"), "_shift"
    )
    from ..functions.ordered import fill

    both = ordered(line.unionByName(marks), ["_base"], ["_at", "_side", "_id"]).add(_s=fill("_shift")).df.where("_side = 1")
    numbers = both.select("_base", F.col("_id").alias(order), (F.col("_at") + 1 + F.coalesce("_s", F.lit(0))).alias("_no"))
    out = rows.join(numbers, ["_base", order])
    final = F.when(F.col("_no") == 1, F.col(name)).otherwise(F.concat(F.col(name), F.lit(" ("), F.col("_no").cast("string"), F.lit(")")))
    return out.withColumn("unique_name", final).drop("_base", "_k", "_no")


def list_catalog(catalog: DataFrame, saved_at: str, defaults: dict[str, Column]) -> DataFrame:
    """Summary with defaults for what is missing, newest first."""
    return catalog.withColumns({c: F.coalesce(F.col(c), d) for c, d in defaults.items()}).orderBy(F.col(saved_at).desc())


def import_preview(catalog: DataFrame, incoming: DataFrame, key: str, saved_at: str) -> DataFrame:
    """Incoming songs with the local song of the same key, if any."""
    here = catalog.select(key, F.col(saved_at).alias("existing_saved_at"), F.lit(True).alias("exists"))
    return incoming.join(here, key, "left").withColumn("exists", F.coalesce("exists", F.lit(False)))


def import_songs(catalog: DataFrame, incoming: DataFrame, chosen: DataFrame, replace: DataFrame, key: str) -> DataFrame:
    """What an import does to each chosen song: imported, replaced, or skipped (there already and not to be replaced)."""
    wanted = incoming.join(chosen.select(key).distinct(), key, "left_semi")
    here = catalog.select(key).distinct().withColumn("_here", F.lit(True))
    ok = replace.select(key).distinct().withColumn("_ok", F.lit(True))
    both = wanted.join(here, key, "left").join(ok, key, "left")
    action = F.when(F.col("_here").isNull(), "imported").when(F.col("_ok").isNotNull(), "replaced").otherwise("skipped")
    return both.withColumn("action", action).drop("_here", "_ok")


def merge_newest(a: DataFrame, b: DataFrame, key: str, saved_at: str, details: Sequence[str]) -> DataFrame:
    """Two stores as one: of a key in both, the one saved later (``a`` when equal)."""
    rows = a.withColumn("_side", F.lit(1)).unionByName(b.withColumn("_side", F.lit(0)))
    newest = rows.groupBy(key).agg(F.max(F.struct(saved_at, "_side", *details)).alias("_r"))
    return newest.select(key, f"_r.{saved_at}", *[f"_r.{d}" for d in details])


def validate_bundle(manifest: DataFrame, files: DataFrame, bundle: str, folder: str, key: str, size: str, limit: int, max_songs: int = 1000) -> DataFrame:
    """Why each bundle is refused as a whole (null: accepted): too many songs, a key twice, a file missing or too large."""
    per_key = manifest.groupBy(bundle, key).agg(F.count("*").alias("_n"))
    songs = per_key.groupBy(bundle).agg(F.sum("_n").alias("_songs"), F.max("_n").alias("_same"))
    missing = manifest.join(files.select(bundle, folder).distinct(), [bundle, folder], "left_anti").groupBy(bundle).agg(F.count("*").alias("_missing"))
    large = files.groupBy(bundle).agg(F.max(size).alias("_size"))
    both = songs.join(missing, bundle, "left").join(large, bundle, "left")
    reason = (
        F.when(F.col("_songs") > max_songs, "songs")
        .when(F.col("_same") > 1, "duplicate")
        .when(F.col("_missing") > 0, "missing")
        .when(F.col("_size") > limit, "size")
    )
    return both.select(bundle, F.col("_songs").alias("songs"), reason.alias("refused"))


SETTING_GROUPS = ("audio", "video")  # fixed values
SCALARS = ("STRING", "BOOLEAN", "BIGINT", "DECIMAL", "DOUBLE")  # what a setting may be, as types of variants


def clean_settings(
    df: DataFrame, settings: str, entries: int | None = None, name_letters: int | None = None, text_letters: int | None = None, json_letters: int | None = None
) -> DataFrame:
    """Song settings kept, as text: two groups of texts, finite numbers and true / false, told by their types and not by their text.

    Nested values, nulls and non-finite numbers go, and groups that are no objects; a name that is there twice keeps its last value.
    Limits are off unless given: so many first entries of a group, letters of a name and of a text, and letters of the
    JSON form of both groups, beyond which nothing is kept.
    """
    none = F.create_map().cast("map<string,string>")

    def group(name: str) -> Column:
        pairs = F.map_entries(F.from_json(F.get_json_object(settings, f"$.{name}"), "map<string,variant>"))
        if entries is not None:
            pairs = F.slice(pairs, 1, entries)
        typed = F.transform(pairs, lambda p: F.struct(p["key"].alias("key"), F.schema_of_variant(p["value"]).alias("type"), p["value"].cast("string").alias("value")))

        def fits(p: Column) -> Column:
            number = F.regexp_extract(p["type"], "^[A-Z]+", 0).isin("BIGINT", "DECIMAL", "DOUBLE")
            return p["value"].isNotNull() & F.regexp_extract(p["type"], "^[A-Z]+", 0).isin(*SCALARS) & ~(number & p["value"].isin("NaN", "Infinity", "-Infinity"))

        def cut(c: Column, letters: int | None) -> Column:
            return c if letters is None else F.left(c, F.lit(letters))

        def short(p: Column) -> Column:
            text = F.when(p["type"] == "STRING", cut(p["value"], text_letters)).otherwise(p["value"])
            return F.struct(cut(p["key"], name_letters).alias("key"), text.alias("value"))

        kept = F.transform(F.filter(typed, fits), short)
        start = F.array().cast("array<struct<key:string,value:string>>")
        return F.map_from_entries(F.reduce(kept, start, lambda acc, p: F.concat(F.filter(acc, lambda q: q["key"] != p["key"]), F.array(p))))

    kept = {f"{name}_settings": F.coalesce(group(name), none) for name in SETTING_GROUPS}
    out = df.withColumns(kept)
    if json_letters is None:
        return out
    size = reduce(lambda a, b: a + b, [F.length(F.to_json(c)) for c in kept])
    return out.withColumns({c: F.when(size <= json_letters, F.col(c)).otherwise(none) for c in kept})


def set_files(catalog: DataFrame, changes: DataFrame, key: str, kind: str, entry: str, order: str) -> DataFrame:
    """Files of each song after changes (the last of a kind counts; null removes it); a new cover bumps its version."""
    last = changes.groupBy(key, kind).agg(F.max_by(F.struct(entry), order).alias("_e"))
    per_song = last.groupBy(key).agg(
        F.map_from_entries(F.collect_list(F.struct(kind, F.col("_e")[entry].alias("value")))).alias("_changes")
    )
    both = catalog.join(per_song, key, "left")
    changed = F.coalesce("_changes", F.create_map().cast("map<string,string>"))
    stays = F.map_filter(F.col("files"), lambda k, v: ~F.map_contains_key(changed, k))
    new = F.map_filter(changed, lambda k, v: v.isNotNull())
    bump = F.coalesce(F.map_contains_key(changed, "cover"), F.lit(False)).cast("int")
    return both.withColumns({"files": F.map_concat(stays, new), "cover_version": F.col("cover_version") + bump}).drop("_changes")


def remove_songs(catalog: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return catalog.join(gone.select(key), key, "left_anti")


def coerce_text(value: Column, limit: int) -> Column:
    return F.coalesce(F.left(F.trim(value), F.lit(limit)), F.lit(""))


def coerce_number(value: Column) -> Column:
    """A non-negative whole number out of text; booleans, negatives and other text are null."""
    number_ = F.floor(value.try_cast("double")).cast("long")
    return F.when(number_ >= 0, number_)


def coerce_fields(df: DataFrame, texts: dict[str, int], numbers: Sequence[str], lists: dict[str, int]) -> tuple[DataFrame, DataFrame]:
    """(coerced rows, one row of how many values each column changed or nulled)."""
    new = {c: coerce_text(F.col(c), n) for c, n in texts.items()} | {c: coerce_number(F.col(c)) for c in numbers}
    new |= {c: F.slice(c, 1, n) for c, n in lists.items()}
    counts = [F.count_if(~F.col(c).cast("string").eqNullSafe(v.cast("string"))).alias(f"{c}_changed") for c, v in new.items() if c not in lists]
    counts += [F.count_if(F.size(c) > n).alias(f"{c}_changed") for c, n in lists.items()]
    counts += [F.count_if(F.col(c).isNotNull() & new[c].isNull()).alias(f"{c}_nulled") for c in numbers]
    return df.withColumns(new), df.agg(*counts)


def file_of(catalog: DataFrame, listing: DataFrame, key: str, wanted: str, files: str, media_types: dict[str, str]) -> DataFrame:
    """File, media type and download name of one kind for each song; songs whose file is not in the listing have none."""
    found = catalog.select(key, F.try_element_at(files, F.lit(wanted)).alias("file"), "title").where("file is not null")
    there = found.join(listing.select(key, "file"), [key, "file"], "left_semi")
    ext = F.lower(F.regexp_extract("file", r"(\.[^.]+)$", 1))
    kinds = F.create_map(*[F.lit(v) for item in media_types.items() for v in item])
    return there.select(key, "file", F.coalesce(F.try_element_at(kinds, ext), F.lit("application/octet-stream")).alias("media_type"), F.concat("title", ext).alias("download_name"))
