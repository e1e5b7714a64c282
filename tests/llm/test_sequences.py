"""Periodic runs, token-id files and tokenizer alignment, held against plain loops and the libraries themselves."""

from __future__ import annotations

import bisect
import glob
import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabspark.llm import align, periods, rans
from tabspark.llm.bpe import byte_bpe_path
from tabspark.llm.library_bpe import ByteCodec, PieceCodec, parts
from tests.llm.conftest import frame

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def awkward():
    """Texts that tokenizers and word splitters treat in ways of their own."""
    rnd = random.Random(3)
    letters = list("ab  \n\t.'1é日😀") + ["<|endoftext|>", "▁", "<0x41>", "<s>", "'ll", "　", "\x00", "\r\n", "​"]
    out = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 60))) for _ in range(300)]
    return out + ["", " ", "  ", "a ", " a", "x" * 300, "a b " * 200, "\n\n\n", "é" * 70 + " " + "日本" * 50]


# periodic runs


def brute_runs(w, strong=True):
    n, out = len(w), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            size = j - i + q
            if j > i and size >= (max(6, 4 * q) if strong else 2 * q):
                if not any(all(w[i + k] == w[i + k + p] for k in range(size - p)) for p in range(1, q)):
                    out.append((i, size, q))
            i = max(j, i + 1)
    return sorted(out)


def brute_op12(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        a, g = (h // 10) % n, h // 10
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
    runs = brute_runs(words)
    dropped = {i for s, size, q in runs for i in range(s + q, s + size)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else None
    listed = "".join(f"{s},{size},{q}\n" for s, size, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (len(runs), *top, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def test_all_runs_of_random_words():
    rnd = random.Random(1)
    for _ in range(600):
        w = [rnd.randint(1, rnd.randint(1, 4)) for _ in range(rnd.randint(0, 40))]
        if len(w) > 4 and rnd.random() < 0.5:
            p, b = rnd.randint(1, 5), rnd.randint(0, len(w) - 1)
            w = [w[b + (i - b) % p] if i >= b and b + (i - b) % p < len(w) else w[i] for i in range(len(w))]
        assert [tuple(r) for r in periods.all_runs(np.array(w, np.int64)).tolist()] == brute_runs(w, strong=False)
        sequence = np.array(w, np.int32)
        strong = periods.strong_runs(sequence, periods._stretches_of([sequence])[0])
        assert [tuple(r) for r in strong.tolist()] == brute_runs(w)


def test_common_extensions_cross_blocks_of_the_tour():
    rnd = random.Random(2)
    s = [rnd.randint(1, 2) for _ in range(700)] + [0]
    tree = periods.SuffixTree(s)
    i, j = zip(*(sorted(rnd.sample(range(len(s)), 2)) for _ in range(2000)))

    def common(a, b):
        k = 0
        while b + k < len(s) and s[a + k] == s[b + k]:
            k += 1
        return k

    assert tree.common(np.array(i), np.array(j)).tolist() == [common(a, b) for a, b in zip(i, j)]
    assert tree.leaves == sorted(range(len(s)), key=lambda k: s[k:])


def test_runs_of_texts(spark, texts):
    rows = texts + [(100 + i, "la " * i) for i in range(12)] + [(200, "one two three " * 9 + "four"), (201, "a b " * 3 + "c " + "a b " * 5), (202, " x\x0by\x1cz ")]
    got = periods.detect(frame(spark, rows, "doc_id long, text string"), repeat=True)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr((i, *brute_op12(i, t))) for i, t in rows)
    empty = periods.detect(frame(spark, [], "doc_id long, text string"))
    assert empty.count() == 0 and empty.columns[1:] == periods.NAMES


def test_long_texts_run_through_whole(spark):
    text = "w%d " * 30 % tuple(range(30)) * 10000 + "end"
    assert len(text) > 1 << 20
    row = periods.detect(frame(spark, [(1, text)], "doc_id long, text string")).first()
    assert (row.n_runs, row.start, row.length, row.period, row.exponent_milli) == (1, 0, 300000, 30, 10000000)
    assert row.collapsed_sha256 == hashlib.sha256(("w%d " * 30 % tuple(range(30)) + "end").encode()).hexdigest()


def test_op12_on_the_given_documents(spark):
    documents = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    got = {r[0]: tuple(r)[1:] for r in periods.op12(spark, SMALL).collect()}
    chosen = [(i, t) for i, t in documents if len((t or "").split()) < 1500]
    assert len(got) == len(documents) and len(chosen) > 150 and sum(got[i][0] > 0 for i, _ in chosen) > 5
    for i, t in chosen:
        assert got[i] == brute_op12(i, t), i


# the libraries behind a memo


def test_codecs_equal_the_libraries(awkward):
    import public_tokenizers
    import sentencepiece
    import tokenizers

    raw = open(byte_bpe_path(), "rb").read()
    piece = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    own = PieceCodec(open(align.piece_bpe_path(), "rb").read())
    for plain in (False, True):
        library = tokenizers.Tokenizer.from_str(raw.decode())
        library.encode_special_tokens = plain
        codec = ByteCodec(raw, plain)
        for t in awkward:
            assert codec.encode(t).tolist() == library.encode(t, add_special_tokens=False).ids, t
    for t in awkward:
        assert not t or own.encode(t).tolist() == piece.encode(t), t


def test_long_texts_are_cut_between_words():
    rnd = random.Random(8)
    words = ["alpha", "be", "gamma", "'s", "x1", "<|endoftext|>", " ", "\n", "日本"]
    text = " ".join(rnd.choice(words) for _ in range(300000))
    assert len(text) > 1 << 20 and len([*parts(text)]) > 3 and "".join(parts(text)) == text
    for codec in (ByteCodec(open(byte_bpe_path(), "rb").read()), PieceCodec(open(align.piece_bpe_path(), "rb").read())):
        pieces = [text[i : i + 100_000] for i in range(0, len(text), 100_000)]
        whole = codec.encode(text).tolist()
        if isinstance(codec, ByteCodec):
            assert whole == codec.ids[codec.library.encode_to_numpy(text, allowed_special="all")].tolist()
        else:
            assert whole == codec.library.encode(text)
        assert b"".join(codec.bytes[i] for i in whole).decode().removeprefix(" ") == "".join(pieces).removeprefix(" ")
    assert [*parts("x" * (1 << 21))] == ["x" * (1 << 21)]


# token-id files


def brute_op11(rows):
    """(doc_id, start, n, crc) as a multiset where equal ids are free in their order: starts by id only."""
    import tokenizers

    library = tokenizers.Tokenizer.from_file(byte_bpe_path())
    coded = [(i, [*library.encode(t or "", add_special_tokens=False).ids, 2]) for i, t in rows]
    return [(i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids) for i, ids in coded]


def test_moved_crc():
    rnd = random.Random(4)
    for _ in range(50):
        a, b = rnd.randbytes(rnd.randint(0, 40)), rnd.randbytes(rnd.randint(0, 70))
        assert rans.moved(zlib.crc32(a), len(b)) ^ zlib.crc32(b) == zlib.crc32(a + b)


@pytest.mark.parametrize("n", [0, 1, 15, 16, 17, 1000, 4096])
def test_coder_from_every_checkpoint(n):
    rnd = np.random.default_rng(n)
    ids = np.minimum(rnd.geometric(0.05, n), 300).astype(np.uint32)
    counts = np.bincount(ids, minlength=400)
    counts[350] = 10**12  # an id far more frequent than all others together
    freq = rans.normalised(counts)
    assert int(freq.sum()) == 1 << rans.BITS and ((freq > 0) == (counts > 0)).all()
    coder = rans.Coder(freq)
    words, marks = coder.encode(ids, 64, 16)
    assert len(marks) == -(-n // 64)
    for k, (place, states) in enumerate(marks):
        m = min(64, n - 64 * k)
        stop = marks[k + 1][0] if k + 1 < len(marks) else None
        assert coder.decode(words[place:stop], states, m).tolist() == ids[64 * k : 64 * k + m].tolist()


def one_by_one(freq, ids, segment, lanes):
    """The stream as its format tells it: one id after another, from the last to the first."""
    before = np.cumsum(freq, dtype=np.int64) - freq
    states, words, marks = [rans.LOW] * lanes, [], []
    for at in range((len(ids) - 1) // lanes * lanes, -1, -lanes):
        given = []
        for lane, i in enumerate(ids[at : at + lanes].tolist()):
            f, x = int(freq[i]), states[lane]
            if x >= f << (63 - rans.BITS):
                given.append(x & 0xFFFFFFFF)
                x >>= 32
            states[lane] = (x // f << rans.BITS) + x % f + int(before[i])
        words = given + words
        if at % segment == 0:
            marks.insert(0, (len(words), list(states)))
    return words, [(len(words) - n, s) for n, s in marks]


@pytest.mark.parametrize("n", [0, 1, 15, 16, 17, 1000])
def test_coder_against_one_id_at_a_time(n):
    rnd = np.random.default_rng(n)
    ids = np.minimum(rnd.geometric(0.05, n), 300).astype(np.uint16)
    coder = rans.Coder(rans.normalised(np.bincount(ids, minlength=400)))
    words, marks = coder.encode(ids, 64, 16)
    assert (words.tolist(), [(p, s.tolist()) for p, s in marks]) == one_by_one(coder.freq.astype(np.int64), ids, 64, 16)
    assert "slots" not in vars(coder)  # the large table is only made to decode


@pytest.fixture(scope="module")
def mixed():
    rnd = random.Random(9)
    words = ["alpha", "be", "gamma#", "#", "délta", "日本", "<|endoftext|>", "x" * 90]
    rows = [(rnd.randint(-5, 60), " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 200)))) for _ in range(150)]
    return rows + [(None, "a b c"), (None, None), (None, "a b c"), (7, ""), (7, None), (8, "# " * 3000), (9, "same"), (9, "same")]


def test_files_give_every_document_back(spark, tmp_path, mixed):
    docs = frame(spark, mixed, "doc_id long, text string")
    folder = f"file://{tmp_path}/ids"
    rans.write(docs, folder, byte_bpe_path(), segment=64, block=256, lanes=16, shard_ids=2000)
    expected = brute_op11(mixed)
    got = rans.summary(spark, folder).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter(e[:3] for e in expected)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    keys = [(r.doc_id is not None, r.doc_id or 0) for r in sorted(got, key=lambda r: r.start)]
    assert keys == sorted(keys)
    pieces = defaultdict(list)
    for r in rans.read_pieces(spark, folder).collect():
        pieces[r.shard, r.doc_no, r.doc_id].append((r.at, r.ids))
    whole = Counter((k[2], tuple(i for _, ids in sorted(v) for i in ids)) for k, v in pieces.items())
    assert whole == Counter((i, tuple(ids)) for i, _, _, ids in expected)
    assert len(glob.glob(f"{tmp_path}/ids/blocks/part-*")) > 3


def test_ids_are_counted_while_texts_are_encoded(spark, tmp_path, mixed, monkeypatch):
    """The counts lie beside the pieces: no job reads the ids once more for them."""
    tables, counted = [], []
    plain, normal = rans.stored, rans.normalised
    monkeypatch.setattr(rans, "stored", lambda df: tables.append(plain(df)) or tables[-1])
    monkeypatch.setattr(rans, "normalised", lambda counts: counted.append(counts) or normal(counts))
    docs = frame(spark, mixed, "doc_id long, text string").repartition(3)
    rans.write(docs, f"file://{tmp_path}/ids", byte_bpe_path(), segment=64, block=256, lanes=16)
    sums, pieces = [tables[0].where(c).select("_ids").collect() for c in (F.col("_piece") == rans.COUNTS, F.col("_piece") >= 0)]
    expected = Counter(i for *_, ids in brute_op11(mixed) for i in ids)
    assert {i: n for i, n in enumerate(counted[0].tolist()) if n} == expected
    assert len(sums) == 3 and sum((len(r[0]) // 2 for r in pieces)) == sum(expected.values())
    assert sum(np.frombuffer(r[0], np.int64).sum() for r in sums) == sum(expected.values())


def test_damage_is_noticed(spark, tmp_path, mixed):
    folder = f"{tmp_path}/ids"
    rans.write(frame(spark, mixed, "doc_id long, text string"), f"file://{folder}", byte_bpe_path(), segment=64, block=256, lanes=16)
    path = max(glob.glob(f"{folder}/blocks/part-*"), key=os.path.getsize)
    raw = bytearray(open(path, "rb").read())
    raw[len(raw) // 2] ^= 1
    body = memoryview(raw)
    with pytest.raises(ValueError):
        list(rans.frames(body))
    with pytest.raises(ValueError):
        list(rans.frames(body[: len(raw) // 3]))
    clean = spark.read.format("binaryFile").load(path).select("content").first()[0]
    _, block = next(rans.frames(memoryview(clean)))
    columns = dict(zip(rans._SEGMENT_NAMES, next(rans.segments_of(block))))
    freq, bits, _ = rans.read_table(rans._table_file(spark, f"file://{folder}"))
    states = np.frombuffer(columns["states"], "<u8") ^ np.uint64((1 << bits) - 1)
    ids = rans.Coder(freq, bits).decode(np.frombuffer(columns["words"], "<u4"), states, columns["n"])
    assert zlib.crc32(ids.astype("<u4").tobytes()) != columns["crc"]


def test_no_documents_no_blocks(spark, tmp_path):
    folder = f"file://{tmp_path}/none"
    rans.write(frame(spark, [], "doc_id long, text string"), folder, byte_bpe_path())
    assert rans.summary(spark, folder).count() == 0


def test_op11_on_the_given_documents(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    at, expected = 0, []
    for i, n, crc, _ in brute_op11(map(tuple, rows)):
        expected.append((i, at, n, crc))
        at += n
    assert sorted(map(tuple, rans.op11(spark, SMALL).collect())) == expected


# tokenizer alignment


def brute_op13(rows):
    """Links by the tokens that own each byte, groups by the first common end at or after each token."""
    import public_tokenizers
    import sentencepiece
    import tokenizers

    a = tokenizers.Tokenizer.from_file(byte_bpe_path())
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    raw_a = ByteCodec(open(byte_bpe_path(), "rb").read()).bytes
    raw_b = [b.id_to_piece(i) for i in range(b.get_piece_size())]
    raw_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in raw_b]
    out, counts = [], Counter()
    for doc_id, text in rows:
        spans = []
        whole = (" " + (text or "")).encode()
        for ids, raw in ((a.encode(" " + (text or ""), add_special_tokens=False).ids, raw_a), (b.encode(text or ""), raw_b)):
            at, side = 0, []
            for i in ids:
                side.append((i, at, at + len(raw[i])))
                at += len(raw[i])
            spans.append(side if text and b"".join(raw[i] for i in ids) == whole else None)
        if None in spans:
            out.append((doc_id, 0, 0, 0, [], ""))
            continue
        owners = [[k for k, (_, s, e) in enumerate(side) for _ in range(s, e)] for side in spans]
        links = [(spans[0][i][0], spans[1][j][0]) for i, j in set(zip(*owners))]
        common = sorted({e for *_, e in spans[0]} & {e for *_, e in spans[1]})
        groups = [([], []) for _ in common]
        for k, side in enumerate(spans):
            for i, _, e in side:
                groups[bisect.bisect_left(common, e)][k].append(str(i))
        parts = [",".join(x) + "|" + ",".join(y) for x, y in groups]
        counts.update(links)
        out.append((doc_id, len(spans[0]), len(spans[1]), len(common), links, hashlib.sha256(";".join(parts).encode()).hexdigest()))
    best = defaultdict(int)
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    return [
        (i, na, nb, g, len(ls), sum(counts[x] == best[x[1]] for x in ls), sum(counts[x] for x in ls), sha) for i, na, nb, g, ls, sha in out
    ]


def test_alignment_of_awkward_texts(spark, awkward, monkeypatch):
    rows = [(i, t) for i, t in enumerate(awkward)] + [(None, "a b"), (None, None), (5, "a b"), (5, "a b")]
    got = align.aligned(frame(spark, rows, "doc_id long, text string").repartition(3), byte_bpe_path(), align.piece_bpe_path())
    expected = brute_op13(rows)
    assert sum(e[1] == 0 for e in expected) > 10 and sum(e[3] < min(e[1], e[2]) for e in expected) > 10
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, expected))


def test_links_of_random_ends():
    rnd = random.Random(6)
    for _ in range(300):
        ends = [sorted({rnd.randint(1, 30) for _ in range(rnd.randint(1, 12))} | {31}) for _ in range(2)]
        cuts = align.common_ends(*ends)
        left, right = align.links_of(np.array(ends[0]), np.array(ends[1]), *cuts)
        spans = [list(zip([0, *e], e)) for e in ends]
        expected = {(i, j) for i, (s, e) in enumerate(spans[0]) for j, (t, f) in enumerate(spans[1]) if max(s, t) < min(e, f)}
        assert sorted(zip(left.tolist(), right.tolist())) == sorted(expected)


def test_alignment_of_no_rows(spark):
    got = align.aligned(frame(spark, [], "doc_id long, text string"), byte_bpe_path(), align.piece_bpe_path())
    assert got.count() == 0
    nothing = align.aligned(frame(spark, [(1, None), (2, "")], "doc_id long, text string"), byte_bpe_path(), align.piece_bpe_path())
    assert sorted(map(tuple, nothing.collect())) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_op13_on_the_given_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, align.op13(spark, SMALL).collect())) == sorted(brute_op13(rows))
