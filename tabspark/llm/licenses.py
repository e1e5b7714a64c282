"""License scan by diagonal voting, in DataFrame functions alone.

Every two neighbouring words of every whole text are hashed and joined with the template table, which is fixed and
small. A hit at word p of a text on word q of a template votes for the diagonal p - q. Votes are added up by diagonal;
diagonals of a template at most ``DRIFT`` apart are merged, so a few words put in or left out do no harm; a merged span
counts if it is not much longer than the template and enough of the template's indexed word pairs voted for it. A base
phrase needs all its votes on one diagonal, which means that its words stand consecutively.

Texts are lower-cased, words are runs of ASCII letters and digits and of all other letters outside ASCII. Null and empty
texts have no words, labels are then empty, positions null and the score 0. Rows with the same id and text are counted
apart but judged once; null ids are kept. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import query, table

#: What separates words.
BREAKS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BASE = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}
#: Notices of well-known licenses (fixed values: their public wording).
NOTICES = [
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by-4.0", "creative commons attribution 4 0 international license"),
    ("cc-by-sa-4.0", "creative commons attribution sharealike 4 0 international license"),
    ("gpl-2.0", "gnu general public license version 2"),
    ("gpl-3.0", "gnu general public license version 3"),
    ("gpl", "it under the terms of the gnu general public license as published by the free software foundation"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl", "gnu lesser general public license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]
#: Pairs of two of these words are too common to index.
COMMON = frozenset("a and any are as at by except for free in is it may not of on or out that the this to with you".split())
DRIFT = 3
#: Votes that a notice needs; short ones, of up to SHORT words, need all.
SHARE = 0.75
SHORT = 8


def templates() -> list[tuple[int, str, bool, int, int, str, str, int]]:
    """(number, label, base?, words, place, word, next word, indexed pairs) of every indexed pair of words."""
    out = []
    for k, (label, text, base) in enumerate([*((a, b, True) for a, b in BASE.items()), *((a, b, False) for a, b in NOTICES)]):
        words = text.split()
        pairs = [(q, a, b) for q, (a, b) in enumerate(zip(words, words[1:])) if base or not {a, b} <= COMMON]
        out += [(k, label, base, len(words), q, a, b, len(pairs)) for q, a, b in pairs]
    return out


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of every row."""
    spark = docs.sparkSession
    index = spark.createDataFrame(templates(), "k int, label string, base boolean, size int, q int, a string, b string, pairs int")
    index = index.select("k", "label", "base", "size", "q", "pairs", F.xxhash64("a", "b").alias("gram"))
    start = spark.createDataFrame([(-1, "", False, 0, 0, 1, 0)], index.schema)  # each text also hits this once
    cut = F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), BREAKS)
    rows = docs.select(F.col(key).alias("doc_id"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(5), text).alias("h2"), cut.alias("cut"))
    words = F.filter("cut", lambda w: w != "")
    rows = rows.select("doc_id", "h1", "h2", words.alias("words")).withColumn("n_words", F.size("words").cast("long"))
    grams = F.transform("words", lambda w, i: F.xxhash64(w, F.get("words", i + 1)))
    rows = rows.select("doc_id", "h1", "h2", "n_words", F.posexplode(F.concat(F.array(F.lit(0).cast("long")), grams)).alias("p", "gram"))
    hits = rows.join(F.broadcast(index.unionByName(start)), "gram")
    text_id = ["doc_id", "h1", "h2", "n_words"]
    # Votes of a diagonal; texts that occur c times vote c times for everything.
    votes = hits.groupBy(*text_id, "k", "label", "base", "size", "pairs", (F.col("p") - 1 - F.col("q")).cast("long").alias("d")).agg(
        F.count("*").alias("c"), F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("q") % 62)).alias("seen"), F.min("p").alias("lo"), F.max("p").alias("hi")
    )
    order = Window.partitionBy(*text_id, "k").orderBy("d")
    votes = votes.withColumn("new", F.when(F.col("d") - F.lag("d").over(order) <= DRIFT, 0).otherwise(1))
    votes = votes.withColumn("run", F.when(F.col("base"), F.col("d")).otherwise(F.sum("new").over(order)))
    spans = votes.groupBy(*text_id, "k", "label", "base", "size", "pairs", "run").agg(
        F.sum("c").alias("c"), F.bit_or("seen").alias("seen"), F.min("d").alias("d"), (F.max("hi") - F.min("lo") + 2).alias("length")
    )
    share = F.bit_count("seen") / F.col("pairs")
    good = F.when(F.col("base"), share == 1).when(F.col("size") <= SHORT, (share == 1) & (F.col("length") <= F.col("size") + 2 * DRIFT)).otherwise((share >= SHARE) & (F.col("length") <= F.col("size") + 2 * DRIFT))
    place = F.col("base") & good
    found = spans.groupBy(*text_id).agg(
        F.max(F.when(F.col("k") == -1, F.col("c"))).alias("c"),
        F.count(F.when(place, 1)).alias("n_base"),
        F.min(F.when(place, F.col("d"))).alias("first_word"),
        F.max(F.when(place, F.col("d"))).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(place, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(F.when((F.col("k") >= 0) & good, F.col("label")))), ",").alias("labels"),
        F.coalesce(F.max(F.when((F.col("k") >= 0) & good, share)), F.lit(0.0)).alias("score"),
    )
    again = F.explode(F.sequence(F.lit(1).cast("long"), F.col("c")))
    columns = ["n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    return found.select("doc_id", "n_words", *columns, again.alias("_copy")).drop("_copy")


def _sql() -> str:
    rows = ", ".join(f"({k}, '{label}', {base}, {size}, {q}, '{a}', '{b}', {pairs})" for k, label, base, size, q, a, b, pairs in templates())
    return f"""with t(k, label, base, size, q, a, b, pairs) as (values {rows}),
  w as (select doc_id, row_number() over () as r, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '{BREAKS}'), lambda x: x <> '') as ws from documents),
  g as (select r, unnest(range(len(ws))) as p, unnest(ws) as a, unnest(list_append(ws[2:], null)) as b from w),
  v as (select r, k, label, base, size, pairs, p - q as d, list_distinct(list(q)) as seen, min(p) as lo, max(p) as hi
    from g join t using (a, b) group by all),
  n as (select *, case when d - lag(d) over (partition by r, k order by d) <= {DRIFT} then 0 else 1 end as new from v),
  u as (select *, case when base then d else sum(new) over (partition by r, k order by d) end as run from n),
  s as (select r, k, label, base, size, pairs, run, len(list_distinct(flatten(list(seen)))) as hit, min(d) as d, max(hi) - min(lo) + 2 as length
    from u group by all),
  h as (select *, hit / pairs as share from s),
  ok as (select *, case when base then share = 1 else share >= case when size <= {SHORT} then 1 else {SHARE} end and length <= size + {2 * DRIFT} end as good from h),
  f as (select r, count(*) filter (base and good) as n_base, min(d) filter (base and good) as first_word, max(d) filter (base and good) as last_word,
    string_agg(distinct label, ',' order by label) filter (base and good) as base_labels,
    string_agg(distinct label, ',' order by label) filter (good) as labels, max(share) filter (good) as score from ok group by r)
select doc_id, len(ws) as n_words, coalesce(n_base, 0) as n_base, first_word, last_word, coalesce(base_labels, '') as base_labels,
  coalesce(labels, '') as labels, coalesce(score, 0.0)::double as score from w left join f using (r)"""


@query("op5_license_scan", _sql())
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return scan(table(spark, folder, "documents"))
