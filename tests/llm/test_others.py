"""Operators on embeddings, pages and conversations, the native text operators and the pipeline."""

from __future__ import annotations

import base64
import hashlib
import ipaddress
import random
import re
from collections import Counter
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabspark.llm import covertree, licenses, pseudonyms, quotations, warc
from tabspark.llm.shared import components

from .conftest import frame

DOCS = "doc_id long, text string"


# --- cover tree


def vectors():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(150, 8))
    near = [x[3] + rng.normal(size=8) * 0.12 for _ in range(60)]
    copies = [x[5]] * 30
    rows = [(i, [float(v) for v in r]) for i, r in enumerate([*x, *near, *copies])]
    rows += [(500, None), (501, []), (502, [0.0] * 8), (503, [1.0, None]), (504, [float("nan")] * 8), (505, [float("inf")] + [0.0] * 7)]
    rows += [(506, [1.0, 0.0]), (507, [2.0, 0.0]), (None, rows[0][1]), (508, [-1.0, 0.0]), (509, [1e200, 1e200]), (510, [1e-200, 1e-200])]
    return rows


def linked(a, b):
    if len(a) != len(b):
        return False
    a, b = (np.array(v) / np.abs(v).max() for v in (a, b))
    return a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.95


@pytest.mark.parametrize("block", [16, 8192])
def test_near_vectors(spark, block):
    rows = vectors()
    good = {i: v for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    links = {i: [j for j in good if j != i and linked(good[i], good[j])] for i in good}
    component = dict.fromkeys(good)
    for i in sorted(good):
        if component[i] is None:
            todo = [i]
            while todo:
                j = todo.pop()
                if component[j] is None:
                    component[j] = i
                    todo += links[j]
    df = covertree.near_vectors(frame(spark, rows, "vec_id long, embedding array<double>"), block=block)
    got = Counter(tuple(r) for r in df.select("vec_id", "n_links", "component_id", "kept").collect())
    want = Counter((i, len(links.get(i, [])), component.get(i, i), component.get(i, i) == i) for i, _ in rows)
    assert got == want


def test_near_vectors_without_rows(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert covertree.near_vectors(empty).count() == 0


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, k) for k in range(200, 400)] + [(5, 7), (3, 3)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 141)}, **{k: 5 for k in [5, 7, *range(200, 400)]}}


# --- WARC


def expected_pages(rows, least=0):
    raw = [(i, (h or "").encode()) for i, _, h in rows]
    best: dict = {}
    for i, b in raw:
        if i is not None and len(b) >= least:
            best[b] = max(i, best.get(b, i))
    count = Counter(b for _, b in raw)
    out = []
    for i, b in raw:
        winner = best.get(b) if count[b] > 1 else None
        revisit = winner is not None and winner != i
        digest = base64.b32encode(hashlib.sha1(b).digest()).decode()
        out.append((i, len(b), digest, "revisit" if revisit else "response", winner if revisit else None))
    return Counter(out)


@pytest.mark.parametrize("chunk, per_file, least", [(1 << 16, 4096, 0), (7, 5, 0), (50, 3, 10)])
def test_warc_round_trip(spark, tmp_path, chunk, per_file, least):
    rows = [(i, f"http://a.example/{i}", "<p>é\r\n\r\nWARC/1.1\r\n" * (i % 4)) for i in range(24)]
    rows += [(50, None, None), (51, "", ""), (None, "u r l\r\nWARC-Type: x", "<b>"), (52, "x", "<b>"), (53, "y", "日本" * 300), (53, "y", "日本" * 300)]
    pages = frame(spark, rows, "page_id long, url string, html string")
    path = f"file://{tmp_path}/warc"
    warc.write(warc.plan_records(pages, revisit_from=least), path, chunk_chars=chunk, per_file=per_file)
    got = warc.read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert Counter(tuple(r) for r in got.collect()) == expected_pages(rows, least)


def test_warc_without_pages(spark, tmp_path):
    path = f"file://{tmp_path}/warc"
    warc.write(warc.plan_records(spark.createDataFrame([], "page_id long, url string, html string")), path)
    assert warc.read(spark, path).count() == 0


# --- licenses


def plain_base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    found = [(p, label) for label, phrase in licenses.BASE.items() for p in range(len(words)) if words[p : p + len(phrase.split())] == phrase.split()]
    places = [p for p, _ in found]
    return len(words), len(found), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in found}))


def test_license_scan(spark, texts):
    rows = texts + [
        (300, "Released under the MIT License. mit-license; MIT\nlicense!"),
        (301, "(GNU) General Public License, version 3 and the general-public LICENSE"),
        (302, "Licensed under the Apache License, Version 2.0 (the x)"),
        (303, "general public mit apache license license"),
        (304, "Permission is hereby granted, free of charge, to any lucky person obtaining a copy of this software and associated documentation files"),
        (305, "mité license mit licenseé mit license"),
        (300, "Released under the MIT License. mit-license; MIT\nlicense!"),
    ]
    out = licenses.scan(frame(spark, rows, DOCS)).collect()
    got = Counter((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in out)
    assert got == Counter((i, *plain_base(t)) for i, t in rows)
    labels = {r["doc_id"]: r["labels"] for r in out}
    assert labels[301] == "gpl,gpl-3.0" and labels[302] == "apache,apache-2.0" and labels[304] == "mit" and labels[303] == "apache"
    assert all(0 <= r["score"] <= 1 and (r["score"] > 0 or not r["labels"]) for r in out)
    assert licenses.scan(spark.createDataFrame([], DOCS)).count() == 0


# --- pseudonyms


def plain_feistel(left, right, a, b, kind, key=pseudonyms.KEY):
    for i in range(pseudonyms.ROUNDS):
        value, size = (right, a) if i % 2 == 0 else (left, b)
        drawn = int(hashlib.sha256(f"{key}|{kind}|{a}|{b}|{i}|{value}".encode()).hexdigest()[:15], 16) % size
        if i % 2 == 0:
            left = (left + drawn) % a
        else:
            right = (right + drawn) % b
    return left, right


def plain_digits(d, kind):
    h = len(d) // 2
    a, b = 10**h, 10 ** (len(d) - h)
    left, right = plain_feistel(int(d[:h]), int(d[h:]), a, b, kind)
    return f"{left:0{h}d}{right:0{len(d) - h}d}"


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(reversed(d))) % 10


def refill(shape, digits):
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


def plain_pseudonym(m):
    digits = re.sub(r"\D", "", m)
    if "@" in m:
        return "u" + hashlib.sha256(f"{pseudonyms.KEY}|mail|{m.lower()}".encode()).hexdigest()[:16] + "@example.invalid"
    if re.fullmatch(r"\d+\.\d+\.\d+\.\d+", m):
        n = int(ipaddress.ip_address(m))
        left, right = plain_feistel(n >> 16, n & 65535, 65536, 65536, "ip")
        return str(ipaddress.ip_address(left << 16 | right))
    if re.fullmatch(r"\d{4}-\d\d-\d\d", m):
        k = (date.fromisoformat(m) - date(1800, 1, 1)).days
        left, right = plain_feistel(k // 773, k % 773, 189, 773, "date")
        return (date(1800, 1, 1) + timedelta(left * 773 + right)).isoformat()
    if re.fullmatch(r"\d{3}-\d{2}-\d{4}", m):
        area, group, serial = map(int, m.split("-"))
        left, right = plain_feistel((area - (2 if area > 666 else 1)) * 99 + group - 1, serial - 1, 898 * 99, 9999, "ssn")
        k = left // 99
        return f"{k + (2 if k >= 665 else 1):03d}-{left % 99 + 1:02d}-{right + 1:04d}"
    if m[0] in "+(":
        code = 1 if m.startswith("+1") else 2 if m[0] == "+" else 0
        return refill(m, digits[:code] + plain_digits(digits[code:], "phone"))
    if luhn(digits) == 0:
        payload = plain_digits(digits[:-1], "card")
        return refill(m, payload + str((10 - luhn(payload + "0")) % 10))
    return refill(m, plain_digits(digits, "number"))


VALUES = [
    "4111111111111111", "4111 1111 1111 1111", "5500-0000-0000-0004", "4785380592391130", "1234567890123", "378282246310005", "+1 (743) 555-3824",
    "+49 30 1234 5678", "(743) 555-3824", "152.143.123.131", "0.0.0.0", "2024-02-29", "1999-12-31", "1800-01-01", "2199-12-31", "123-45-6789",
    "899-99-9999", "josé.x+y@mail.example.com", "9999999999999999999",
]


def test_pseudonyms_agree_with_plain_ones(spark):
    rows = [(k, f"before {v}, after {v}.") for k, v in enumerate(VALUES)]
    rows += [(100, None), (101, ""), (102, "no data, 12 and 3.4"), (103, "2023-02-30 and 000-12-3456 stay; 1.2.3.400 too"), (0, rows[0][1]), (None, rows[1][1])]
    docs = frame(spark, rows, DOCS).withColumn("n_private", F.lit("old"))
    out = pseudonyms.pseudonymise(docs)
    assert sorted(out.columns) == sorted(docs.columns)
    got = Counter((r["doc_id"], r["text"], r["n_private"]) for r in out.collect())

    def plain(i, t):
        v = None if i == 102 or i == 103 or not t else t.split("before ")[1].split(", after")[0]
        return (i, t, 0) if v is None else (i, t.replace(v, plain_pseudonym(v)), 2)

    assert got == Counter(plain(i, t) for i, t in rows)
    assert pseudonyms.pseudonymise(spark.createDataFrame([], DOCS)).count() == 0


def test_pseudonyms_are_permutations(spark):
    left, right = F.floor(F.col("id") / 7), F.col("id") % 7
    made = pseudonyms.feistel(left, right, F.lit(11).cast("long"), F.lit(7).cast("long"), "test", "k")
    assert len({tuple(r[0]) for r in spark.range(77).select(made).collect()}) == 77
    cards = {v for v in VALUES if luhn(re.sub(r"\D", "", v)) == 0 and len(v) > 12 and v[0] in "345"}
    out = spark.createDataFrame([(v,) for v in cards], "m string").select(pseudonyms.pseudonym(F.col("m")).alias("p")).collect()
    assert cards and all(luhn(re.sub(r"\D", "", r["p"])) == 0 for r in out)
    secret = spark.createDataFrame([("ab12" * 40,)], "m string").select(pseudonyms.pseudonym(F.col("m")).alias("p")).first()["p"]
    assert len(secret) == 160 and secret != "ab12" * 40


def test_pseudonyms_of_day_first_dates_national_phones_and_ipv6(spark):
    same = [("2001:db8::1", "2001:0DB8:0:0:0:0:0:1"), ("743-555-3824", "(743) 555-3824")]
    values = ["25/12/1990", "31/01/1800", "13/12/2199", "743-555-3824", "743 555 3824", "743.555.3824", "1-743-555-3824", "030 1234567", "0171/1234567"]
    values += ["01 23 45 67 89", "612 345 678", "91 123 45 67", "2001:db8::1", "2001:0DB8:0:0:0:0:0:1", "fe80::", "::1", "a:b:c:d:e:f:a:b", "1:2:3:4:5:6:7::", "(743) 555-3824"]
    stay = ["31/02/2020", "25/13/1990", "std::vector x :: y", "12:34:56", "aa:bb:cc:dd:ee:ff", "3.1415926 and 1,234,567", "40 to 1200 x 300"]
    rows = [(k, f"at={v}: or {v}.") for k, v in enumerate(values)] + [(100 + k, v) for k, v in enumerate(stay)]
    out = {r["doc_id"]: (r["text"], r["n_private"]) for r in pseudonyms.pseudonymise(spark.createDataFrame(rows, DOCS)).collect()}
    new = {}
    for k, v in enumerate(values):
        text, n = out[k]
        assert n == 2 and v not in text, (v, text)
        new[v] = text.split(" or ")[1][:-1]
        assert text == f"at={new[v]}: or {new[v]}."
        if "::" in v or v.count(":") > 2:
            assert ipaddress.ip_address(new[v]).version == 6
        else:
            assert re.sub(r"\d", "0", v) == re.sub(r"\d", "0", new[v])
    assert all(out[100 + k] == (v, 0) for k, v in enumerate(stay))
    assert new[same[0][0]] == new[same[0][1]] and re.sub(r"\D", "", new[same[1][0]]) == re.sub(r"\D", "", new[same[1][1]])
    assert len({new[v] for v in values}) == len(values) - 1
    days = [date(1800, 1, 1) + timedelta(k) for k in range(146097)]
    late = [d.strftime("%d/%m/") + f"{d.year:04d}" for d in days if d.day > 12]
    made = spark.createDataFrame([(d,) for d in late], "m string").select(pseudonyms.pseudonym(F.col("m")).alias("p")).collect()
    assert len(late) == 9 * 9833 and {r["p"] for r in made} == set(late)


# --- quotations


def test_conversations(spark):
    rows = [
        (1, 0, "user", "Hello there.\nHow are you?\n\nSecond part"),
        (1, 1, "user", "Something else"),
        (1, 2, "assistant", "Ann wrote:\n> hello   THERE.\n> How are you?\n>\n> Second part\nFine."),
        (1, 3, "user", "> > Hello there.\n> Fine.\nGood to hear"),
        (1, 4, "user", "> nobody said this\nStill here"),
        (1, 5, "user", "> Something else\n> > How are you?"),
        (2, 0, "user", "> Hello there."),
        (2, 1, None, None),
        (2, 1, None, None),
        (2, None, "user", "> Hello there.\nx"),
        (None, 0, "a", ""),
        (3, 0, "user", "5 > 4 and a > b"),
    ]
    df = quotations.conversations(frame(spark, rows, "conv_id long, turn long, role string, text string"))
    got = Counter((r["conv_id"], r["position"], r["turn"], r["text"], r["reply_to"], r["thread"]) for r in df.collect())
    assert got == Counter(
        [
            (1, 0, 0, "Hello there.\nHow are you?\n\nSecond part", None, 0),
            (1, 1, 2, "Fine.", 0, 0),
            (1, 2, 3, "Good to hear", 2, 0),
            (1, 3, 1, "Something else", None, 1),
            (1, 4, 5, "", 1, 1),
            (1, 5, 4, "Still here", None, 4),
            (2, 0, None, "x", None, None),
            (2, 1, 0, "", None, 0),
            (2, 2, 1, "", None, 1),
            (2, 3, 1, "", None, 1),
            (None, 0, 0, "", None, 0),
            (3, 0, 0, "5 > 4 and a > b", None, 0),
        ]
    )


def test_long_threads_and_hot_messages(spark):
    """A chain of replies, each quoting the one before, and many replies to one message."""
    rows = [(1, k, "u", f"> say {k - 1}\nsay {k}" if k else "say 0") for k in range(40)]
    rows += [(2, k, "u", f"> start\nanswer {k}" if k else "start") for k in range(300)]
    out = quotations.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert all(r["thread"] == 0 and r["position"] == r["turn"] for r in out)
    assert all(r["reply_to"] == (None if r["turn"] == 0 else r["turn"] - 1 if r["conv_id"] == 1 else 0) for r in out)
    assert quotations.conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_partial_quotations_wrapped_anew(spark):
    """Two of three paragraphs, with other line ends than the original's; of two messages the one with most quoted words."""
    first, second, third = "We could meet\non Monday at\nnoon.", "Bring the charts\nand the old\ntapes.", "Greetings\nfrom Ann"
    rows = [
        (1, 0, "u", f"{first}\n\n{second}\n\n{third}"),
        (1, 1, "u", "Another message"),
        (1, 2, "u", "Ann wrote:\n> We could meet on\n> Monday at noon.\n>\n> Bring the charts and\n> the old tapes.\nYes."),
        (2, 0, "u", f"{first}\n\n{second}\n\n{third}".replace("\n", "\r\n")),
        (2, 1, "u", "> Bring the charts and\r\n> the old tapes.\r\n>\r\n> unknown\r\nYes."),
        (3, 0, "u", "one two\nthree four\n\nfive six\nseven eight nine ten"),
        (3, 1, "u", "a b c\nd e f\ng h i j k"),
        (3, 2, "u", "> one two\n> three four\n>\n> five six\n> seven eight nine ten\nwell\n> a b c\n> d e f\n> g h i j k\nso"),
    ]
    out = quotations.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    got = {(r["conv_id"], r["turn"]): (r["reply_to"], r["thread"]) for r in out}
    assert got == {(1, 0): (None, 0), (1, 1): (None, 1), (1, 2): (0, 0), (2, 0): (None, 0), (2, 1): (0, 0), (3, 0): (None, 0), (3, 1): (None, 1), (3, 2): (1, 1)}


# --- pipeline


def test_pipeline(spark, texts, tmp_path):
    import corpus_pipeline

    rnd = random.Random(8)
    rows = list(texts)
    rows += [(1000 + i, " ".join([*(rnd.choice(["foul", "vile"]) for _ in range(4)), *(f"v{rnd.randrange(900)}" for _ in range(40))])) for i in range(80)]
    item = "one two three four five six seven eight nine ten"
    rows += [(2000, f"see {item} there"), (2001, "card 4111111111111111 ok")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t) if t else None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    marks = [(i, 1, int(1000 <= i < 2000)) for i, _ in rows if i is not None]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    now, seen = spark.read.parquet(f"file://{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        before = now
        out = stage(spark, now, f"file://{tmp_path}")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == list(corpus_pipeline.COLUMNS)
        out.write.parquet(f"file://{tmp_path}/{name}")
        now = spark.read.parquet(f"file://{tmp_path}/{name}")
        seen[name] = {r["doc_id"] for r in before.select("doc_id").collect()} - {r["doc_id"] for r in now.select("doc_id").collect()}
    assert seen["toxicity"] == {i for i, _ in rows if i is not None and 1000 <= i < 2000}
    assert {21, 22, 23} <= seen["near_dedup"] and 20 not in seen["near_dedup"]
    assert seen["decontamination"] == {2000} and not seen["pii"] and not seen["bpe"]
    assert all(r["exact"] for r in now.collect())
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == now.count()


def test_near_copies_without_ids_in_the_pipeline(spark, monkeypatch):
    import corpus_pipeline

    seen, taken = [], corpus_pipeline.setsketch.near_documents
    monkeypatch.setattr(corpus_pipeline.setsketch, "near_documents", lambda *a, **k: seen.append(k) or taken(*a, **k))
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(120)) for x in "abcd")
    rows = [(7, a), (9, a), (None, a), (None, f"{a} end"), (None, b), (None, f"{b} end"), (None, b), (None, c), (3, d), (None, ""), (4, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert out.columns == docs.columns
    kept = [(r["doc_id"], r["text"]) for r in out.collect()]
    of_b = [k for k in kept if k in ((None, b), (None, f"{b} end"))]
    assert len(of_b) == 1 and Counter(kept) == Counter([(7, a), *of_b, (None, c), (3, d), (None, ""), (4, None)])
    assert (1 - 0.8**5) ** (seen[0]["registers"] // 5) < 4e-6


def test_contaminated_rows_are_judged_one_by_one(spark, tmp_path):
    """Rows without an id, and rows that share one, neither fall with a contaminated row nor make up an item together."""
    import corpus_pipeline

    item = "one two three four five six seven eight nine ten"
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    first, second = item[: item.index("six")], item[item.index("six") :]
    rows = [(None, f"see {item} there"), (None, "clean"), (None, None), (5, item), (5, "clean too"), (None, first), (None, second), (6, ""), (5, "clean too")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, _row int")
    out = corpus_pipeline.drop_contaminated(spark, docs, f"file://{tmp_path}")
    assert out.columns == list(corpus_pipeline.COLUMNS)
    assert Counter((r["doc_id"], r["text"]) for r in out.collect()) == Counter(r for r in rows if item not in (r[1] or ""))


def test_pipeline_of_no_documents(spark, tmp_path):
    import corpus_pipeline

    schemas = {"documents": "doc_id long, text string, lang string, source string, n_chars long", "labels": "doc_id long, quality int, toxic int", "benchmark": "item_id long, text string"}
    for name, schema in schemas.items():
        spark.createDataFrame([], schema).write.parquet(f"file://{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0


def test_the_library_does_not_need_the_operators():
    import pathlib

    top = pathlib.Path(__file__).parents[2] / "tabspark"
    for path in top.rglob("*.py"):
        if "llm" not in path.parts:
            assert "llm" not in path.read_text(), path


def test_traversal_holds_small_matrices_alone():
    """matrices and lists of pairs grew with the block and with what is near, in every worker of an executor."""
    import tracemalloc

    rnd = np.random.default_rng(3)

    def block(x):
        b = covertree.Block.__new__(covertree.Block)
        x /= np.sqrt((x * x).sum(axis=1))[:, None]
        perm, b.nodes, b.radii = covertree.build_tree(x, 0.04)
        b.ids, b.weight, b.x = perm, np.ones(len(x), np.int64), x[perm]
        b.below = np.arange(len(x) + 1)
        return b

    # Most points stand alone, some have a near one: a root with thousands of children, of both kinds.
    centres = rnd.normal(size=(5000, 24))
    a, b = (block(np.concatenate([centres, centres[:2500] + rnd.normal(size=(2500, 24)) * 0.03]) + rnd.normal(size=(7500, 24)) * s) for s in (0.01, 0.02))
    want = (a.x @ b.x.T >= 0.95).sum()
    tracemalloc.start()
    try:
        links = covertree.traverse(a, b, 0.95, False)["links"].sum()
        assert links == 2 * want and tracemalloc.get_traced_memory()[1] < 35e6
    finally:
        tracemalloc.stop()


def test_near_vectors_in_groups_of_blocks(spark):
    rnd = np.random.default_rng(4)
    x = rnd.normal(size=(500, 6)).round(3)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    unit = x / np.sqrt((x * x).sum(axis=1))[:, None]
    near = unit @ unit.T >= 0.95
    df = covertree.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), block=12)
    got = {r["vec_id"]: r for r in df.collect()}
    assert {i: r["n_links"] for i, r in got.items()} == {i: int(n) - 1 for i, n in enumerate(near.sum(axis=1))}
    for i, j in np.argwhere(near):
        assert got[int(i)]["component_id"] == got[int(j)]["component_id"] <= min(i, j)
