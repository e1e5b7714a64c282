"""Operators on documents, against brute force over the same rows."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from tabspark.llm import bpe, repeats, setsketch, tiling, toxicity
from .conftest import frame

DOCS = "doc_id long, text string"


def same_rows(df, expected, columns):
    got = Counter(tuple(r[c] for c in columns) for r in df.collect())
    assert got == Counter(expected)


# --- byte-level BPE


def test_bpe_agrees_with_the_library(spark, texts):
    rnd = random.Random(3)
    odd = "aAbé ñß\n\t 0123'sreted日本 　\x85​😀—.-_"
    more = ["".join(rnd.choice(odd) for _ in range(rnd.randint(0, 80))) for _ in range(300)]
    more += ["<|endoftext|>", "a<|endoftext|> b<|endoftext", "the" * 500, "z" * 3000, "É" * 300]
    rows = texts + [(1000 + i, t) for i, t in enumerate(more)]
    library = Tokenizer.from_file(bpe.byte_bpe_path())
    expected = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        expected.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    df = bpe.round_trip(frame(spark, rows, DOCS), bpe.byte_bpe_path())
    same_rows(df, expected, df.columns)
    assert bpe.round_trip(spark.createDataFrame([], DOCS), bpe.byte_bpe_path()).count() == 0


def test_bpe_columns(spark, texts):
    docs = frame(spark, texts, DOCS).withColumnRenamed("words", "ids")
    coded = bpe.encode(docs, bpe.byte_bpe_path())
    assert sorted(coded.columns) == sorted(docs.columns) and dict(coded.dtypes)["ids"] == "array<int>"
    back = bpe.decode(coded, bpe.byte_bpe_path())
    assert all((r["text"] or "") == r["decoded"] for r in back.collect())
    nulls = spark.createDataFrame([(1, None), (2, [])], "k long, ids array<int>")
    assert [r["decoded"] for r in bpe.decode(nulls, bpe.byte_bpe_path()).collect()] == ["", ""]


def test_bpe_runs_of_a_long_text(monkeypatch):
    from tabspark.llm import shared

    with open(bpe.byte_bpe_path(), "rb") as f:
        codec = bpe.Codec(f.read())
    text = "some words, 12 of them… and more é\n" * 300
    whole = codec.encode_all([text])[0].tolist()
    monkeypatch.setattr(shared, "LONG_TEXT", 100)
    monkeypatch.setattr(bpe, "MEMO", 8)
    parts = [p.tolist() for p in codec.encode(text)]
    assert sum(parts, []) == whole


# --- SetSketch near-dedup


def shingles(text, width):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))) if w else frozenset()


def near_components(rows, width, percent):
    sets = defaultdict(list)
    for i, t in rows:
        if i is not None and shingles(t, width):
            sets[i].append(shingles(t, width))
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            if any(100 * len(a & b) >= percent * len(a | b) for a in sets[i] for b in sets[j]):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    by_set = {s: root(i) for i, ss in sets.items() for s in ss}
    out = []
    for i, t in rows:
        s = shingles(t, width)
        component = by_set.get(s, i) if s else i
        out.append((i, len(s), component, i == component))
    return out


@pytest.mark.parametrize("width, percent", [(3, 85), (5, 80)])
def test_near_documents(spark, texts, width, percent):
    df = setsketch.near_documents(frame(spark, texts, DOCS), width=width, percent=percent)
    same_rows(df, near_components(texts, width, percent), ["doc_id", "n_shingles", "component_id", "kept"])


def test_near_documents_without_rows(spark):
    assert setsketch.near_documents(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("block, anchors", [(3, 1), (2, 0), (512, 64)])
def test_chain_of_near_copies_over_blocks(spark, monkeypatch, block, anchors):
    """Buckets whose members are linked with few of the others, cut into small blocks; all must still be linked."""
    monkeypatch.setattr(setsketch, "BLOCK", block)
    monkeypatch.setattr(setsketch, "ANCHORS", anchors)
    words = [f"w{i}" for i in range(400)]
    rows = [(k, " ".join(words[6 * k : 6 * k + 200])) for k in range(20)]
    rows += [(5, "an id that is used twice"), (3, rows[9][1]), (None, rows[4][1]), (30, None), (31, " ")]
    df = setsketch.near_documents(spark.createDataFrame(rows, DOCS), width=3, percent=85)
    same_rows(df, near_components(rows, 3, 85), ["doc_id", "n_shingles", "component_id", "kept"])


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(1)
    seeds = setsketch._seeds(1000)
    x = np.unique(rng.integers(0, 2**63, 3000).astype(np.uint64))
    a, b = x[:2000], x[500:]
    sa, sb = setsketch.sketch(a, seeds), setsketch.sketch(b, seeds)
    assert (setsketch.merge(sa, sb) == setsketch.sketch(np.union1d(a, b), seeds)).all()
    j = setsketch.estimate(sa[None], sb[None], np.array([float(len(a))]), np.array([float(len(b))]))[0]
    assert abs(j - 1500 / len(x)) < 0.05


# --- repeated strings


def brute_repeats(rows, length):
    raw = [(i, (t or "").encode()) for i, t in rows]
    count = Counter(b[k : k + length] for _, b in raw for k in range(len(b) - length + 1))
    out = []
    for i, b in raw:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if count[b[k : k + length]] > 1:
                gone[k : k + length] = b"\x01" * length
        runs = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), runs, bytes(x for x, g in zip(b, gone) if not g)))
    return out


def test_repeats(spark, texts):
    df = repeats.without_repeats(frame(spark, texts, DOCS))
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in df.collect())
    assert got == Counter(brute_repeats(texts, 200))


def test_repeats_over_chunks_and_without_rows(spark, texts, monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK", 300)
    for raw in [t.encode() for _, t in texts if t and len(t) > 1000]:
        parts = [np.stack([n[0], n[1], n[2], n[3]]) for n in repeats.nodes_of(raw, 200)]
        windows = sum(int((p[3] - p[2] + 1).sum()) for p in parts)
        assert windows == len(raw) - 199
    assert repeats.without_repeats(spark.createDataFrame([], DOCS)).count() == 0


def test_repeats_of_texts_of_several_chunks(spark, texts):
    """A block that a chunk's end cuts is one block, not two that repeat each other."""
    rnd = random.Random(12)
    once = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(9000))
    raw = once.encode()
    for chunk in (1, 63, 700, 1024):
        whole, cut = ([tuple(x) for n in repeats.nodes_of(raw, 200, c) for x in zip(*n[:4])] for c in (1 << 20, chunk))
        assert cut == whole and len(set(cut)) == len(cut)
    rows = [(1, once), (2, "".join(rnd.choice("abcdef") for _ in range(3000))), (3, f"{once[4000:4500]} and more"), *texts]
    df = repeats.without_repeats(frame(spark, rows, DOCS), chunk=700)
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in df.collect())
    assert got == Counter(brute_repeats(rows, 200))


def test_repeats_when_the_input_is_split_otherwise_in_every_pass(spark, texts, tmp_path, monkeypatch):
    path, setting, taken = f"file://{tmp_path}/documents", "spark.sql.files.minPartitionNum", repeats.bitmap
    spark.createDataFrame(texts, DOCS).repartition(6, "doc_id").write.parquet(path)

    def bitmap(*args):
        out = taken(*args)
        spark.conf.set(setting, "1" if spark.conf.get(setting) == "64" else "64")
        return out

    monkeypatch.setattr(repeats, "bitmap", bitmap)
    spark.conf.set(setting, "64")
    try:
        out = repeats.without_repeats(spark.read.parquet(path)).collect()
    finally:
        spark.conf.unset(setting)
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in out)
    assert got == Counter(brute_repeats(texts, 200))


# --- greedy string tiling


def plain_tiles(item, doc, seed):
    """Tiled words of the item, by the textbook loop over all matches."""
    used_i, used_d = [False] * len(item), [False] * len(doc)
    while True:
        best = (seed - 1, 0, 0)
        for a in range(len(item)):
            for b in range(len(doc)):
                n = 0
                while a + n < len(item) and b + n < len(doc) and item[a + n] == doc[b + n] and not used_i[a + n] and not used_d[b + n]:
                    n += 1
                if n > best[0]:
                    best = (n, a, b)
        n, a, b = best
        if n < seed:
            return sum(used_i)
        used_i[a : a + n] = used_d[b : b + n] = [True] * n


def test_tiles_cover_as_much_as_the_textbook(spark):
    rnd = random.Random(9)
    for _ in range(60):
        words = [rnd.randrange(1, 1 << 60) for _ in range(12)]
        item = [rnd.choice(words) for _ in range(rnd.randint(5, 25))]
        doc = [rnd.choice(words) for _ in range(rnd.randint(5, 40))] + item[len(item) // 2 :] + item[: len(item) // 2]
        found = tiling.tiles(np.array(item, np.uint64), [np.array(doc, np.uint64)], 5)
        marked = set()
        for a, b, n in found:
            assert item[a : a + n] == doc[b : b + n] and n >= 5
            assert marked.isdisjoint(range(a, a + n))
            marked.update(range(a, a + n))
        assert found == sorted(found, key=lambda f: -f[2])
        assert len(marked) >= 0.8 * plain_tiles(item, doc, 5)


def test_contamination(spark, texts):
    items = [(1, "Alpha beta, gamma delta epsilon zeta eta theta iota kappa lambda mu"), (2, "too short an item"), (3, None), (4, ""), (None, "x y z u v w")]
    items += [(5, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu!")]
    a, b = "alpha beta gamma delta epsilon zeta", "ETA theta iota kappa lambda mu"
    rows = texts + [(200, f"text before. {a} {b} after"), (201, f"{b}, and then {a}"), (202, a), (203, f"{a} {a}"), (None, f"{a} {b}")]
    rows += [(204, f"{a} {b}"), (204, f"{a} {b}")]
    df = tiling.verdicts(frame(spark, rows, DOCS), frame(spark, items, "item_id long, text string"))
    got = Counter((r["doc_id"], r["contaminated"], r["n_items"], r["item_id"]) for r in df.collect())
    hit = {200, 201, 204, None}
    assert got == Counter((i, i in hit, int(i in hit), 1 if i in hit else None) for i, _ in rows)
    none = tiling.verdicts(spark.createDataFrame([], DOCS), frame(spark, items, "item_id long, text string"))
    assert none.count() == 0
    clean = tiling.verdicts(frame(spark, rows, DOCS), spark.createDataFrame([], "item_id long, text string"))
    assert clean.where("contaminated").count() == 0 and clean.count() == len(rows)


def test_short_items_are_found_as_a_whole(spark):
    items = [(1, "Too short, an ITEM"), (2, "Yes"), (3, "no way"), (4, "no way"), (5, "..."), (6, "one two three four five six")]
    rows = [(1, "It is too short an item."), (2, "too short; an other item"), (3, "yesterday"), (4, "Oh YES! No way"), (5, None), (5, "way no"), (5, "no"), (None, "no-way")]
    rows += [(6, "one two three four five six yes"), (7, "an item too short")]
    df = tiling.verdicts(frame(spark, rows, DOCS), frame(spark, items, "item_id long, text string"))
    got = Counter((r["doc_id"], r["n_items"], r["item_id"], r["coverage"]) for r in df.collect())
    hits = {1: (1, 1, 1.0), 4: (2, 2, 1.0), None: (1, 3, 1.0), 6: (2, 2, 1.0)}
    assert got == Counter((i, *hits.get(i, (0, None, 0.0))) for i, _ in rows)


# --- toxicity


def labelled(n, seed):
    rnd = random.Random(seed)
    plain = [f"word{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(n):
        toxic = i % 7 == 0
        words = [rnd.choice(plain) for _ in range(60)]
        if toxic:
            for _ in range(3):
                words[rnd.randrange(60)] = rnd.choice(["foul", "vile", "nasty"])
        docs.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def test_toxicity_held_out(spark):
    docs, labels = labelled(700, 1)
    more = docs + [(None, "foul vile nasty"), (9000, None), (9001, ""), (9002, "foul " * 100000), (9002, "foul " * 100000)]
    df = frame(spark, more, DOCS)
    model = toxicity.fit(df, frame(spark, labels + [labels[0], (8, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int"))
    out = toxicity.score(df, model).collect()
    assert len(out) == len(more)
    truth = {i: t for i, _, t in labels}
    held = [r for r in out if r["held_out"] and r["doc_id"] in truth]
    assert held and np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.97
    import zlib

    assert all(r["held_out"] == (r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out)
    by = {r["doc_id"]: r for r in out}
    assert by[9000]["predicted"] == 0 and by[9000]["score"] == by[9001]["score"] and by[9002]["predicted"] == 1
    assert all(0 <= r["score"] <= 1 for r in out)
    kept = toxicity.select(df, model)
    assert kept.columns == df.columns and kept.count() == sum(r["predicted"] == 0 for r in out)


def test_toxicity_without_labels(spark):
    docs = frame(spark, [(1, "a b"), (2, None)], DOCS)
    model = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert [r["score"] for r in toxicity.score(docs, model).collect()] == pytest.approx([0.0, 0.0])
    assert toxicity.score(spark.createDataFrame([], DOCS), model).count() == 0


def test_risk_is_corrected_for_the_prior():
    docs, labels = labelled(400, 2)
    positive = [toxicity.distinct_words(t) for (i, t), (_, _, y) in zip(docs, labels) if y and i % 2]
    unlabelled = [toxicity.distinct_words(t) for i, t in docs]
    model = toxicity.train(positive, unlabelled, 1 / 7, 100, 2)
    assert set(model.words) == {"foul", "vile", "nasty"}
    scores = model.score([t for _, t in docs])
    assert ((scores >= 0.5) == np.array([y for _, _, y in labels], dtype=bool)).mean() > 0.97
    assert re.fullmatch(r"\w+", "foul") and (model.weights > 0).all()
