"""Queries that SQL cannot express, against plain models of their contracts."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from tokenizers import Tokenizer

from tabflow.llm import bpe, language, simhash, syncmers, wavelet
from tabflow.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of(folder):
    return duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{folder}/documents.parquet'").fetchall()


# --- op3 --------------------------------------------------------------------------------------------------------


def hash_of(*values):
    seed = 42
    for v in values:
        data = v.encode() if isinstance(v, str) else int(v).to_bytes(8, "little", signed=True)
        seed = xxhash.xxh64_intdigest(data, seed)
    return seed - (seed >> 63 << 64)


def marks(text):
    h = [hash_of(w) for w in WORD.findall(text)]
    k, s = syncmers.K, syncmers.S
    if len(h) < k:
        return h
    inner = [hash_of(*h[i : i + s]) for i in range(len(h) - s + 1)]
    out = []
    for i in range(len(h) - k + 1):
        runs = inner[i : i + k - s + 1]
        if min(runs) in (runs[0], runs[-1]):
            out.append(hash_of(runs[0], h[i + s], runs[-1]))
    return out


def test_syncmers(spark, small, odd):
    for folder in (small, odd):
        rows = sorted(rows_of(folder), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
        expected = []
        for i, (doc_id, text) in enumerate(rows):
            following = rows[(i + 1) % len(rows)][1]
            cut = len(text) // 3
            edited = text[: len(text) - cut] + following[:cut]
            a, b, c = ([x & 0xFFFFFFFF for x in marks(t)] for t in (text, edited, following))
            like = [len({*a} & {*x}) / len({*a} | {*x}) if {*a} | {*x} else 1.0 for x in (b, c)]
            digest = ["".join(f"{x:08x}" for x in y) for y in (a, b)]
            expected.append((str(doc_id), len(text), hashlib.sha256(edited.encode()).hexdigest(), *digest, *like))
        got = [(str(r[0]), *r[1:]) for r in QUERIES["op3_closed_syncmers"](spark, folder).collect()]
        assert sorted(got) == sorted(expected)


def test_single_document_follows_itself(spark, tmp_path):
    spark.createDataFrame([(1, "a b c d e f g")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    row = QUERIES["op3_closed_syncmers"](spark, str(tmp_path)).first()
    assert row["near_next"] == 1.0


# --- op5, op9 ---------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def reference(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


PARTS = ["a", "b", " ", "  ", "\n", " \n", "\t", "é", "the", "'s", "'S", "1", "23", "!", "==", " ", "中", "😀", " ", "\r\n", "X",
         "<|endoftext|>", "ing", "J̌", "İ", "ß", "ſ", "Σ", "½", "ŉ", "\x1c", "\x85", "\x00", "ͅ"]


def random_texts(n, seed=5):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 30))) for _ in range(n)]


def test_merges_match_the_library(ranks, reference):
    encode = bpe.Encoder(ranks, public_tokenizers.PATTERN)
    rnd = random.Random(1)
    long = ["a" * 5000, "ab" * 3000, "=" * 4000, "é" * 999, "x" * 47, "y" * 48, "zq" * 24]
    texts = random_texts(3000) + long + ["".join(rnd.choice("abcdefghij") for _ in range(3000))]
    assert [x.tolist() for x in encode(texts)] == [reference.encode_ordinary(t) for t in texts]


def test_store_is_bounded(ranks, reference, monkeypatch):
    monkeypatch.setattr(bpe, "CHUNKS", 20)
    monkeypatch.setattr(bpe, "WORDS", 20)
    encode = bpe.Encoder(ranks, public_tokenizers.PATTERN)
    for t in random_texts(300, 2):
        assert encode([t])[0].tolist() == reference.encode_ordinary(t)
        assert len(encode.chunks.number) <= 20 + 31 and len(encode.words.number) <= 20 + 31


def test_byte_bpe(spark, small, odd, reference):
    for folder in (small, odd):
        expected = []
        for doc_id, text in rows_of(folder):
            ids = reference.encode_ordinary(text)
            digests = [hashlib.sha256(x).hexdigest() for x in (" ".join(map(str, ids)).encode(), text.encode())]
            expected.append((str(doc_id), len(ids), *digests))
        got = [(str(r[0]), *r[1:]) for r in QUERIES["op5_byte_bpe"](spark, folder).collect()]
        assert sorted(got) == sorted(expected)


@pytest.fixture(scope="module")
def word_file():
    with open(public_tokenizers.path("word_bpe_49k.json")) as f:
        return f.read()


@pytest.fixture(scope="module")
def library(word_file):
    return Tokenizer.from_str(word_file)


def test_words_match_the_tokenizer(word_file, library):
    texts = random_texts(4000)
    got = wavelet.WordTokenizer(word_file)(texts)
    assert [x.tolist() for x in got] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_wavelet_shards(spark, small, odd, library, monkeypatch):
    for folder, size in ((small, 3000), (odd, wavelet.SHARD)):
        monkeypatch.setattr(wavelet, "SHARD", size)
        start, expected = 0, []
        for doc_id, text in sorted(rows_of(folder), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode())):
            ids = np.array([*library.encode(text, add_special_tokens=False).ids, 2], "<u4")
            expected.append((str(doc_id), start, len(ids), zlib.crc32(ids.tobytes())))
            start += len(ids)
        got = [(str(r[0]), *r[1:]) for r in QUERIES["op9_wavelet_shards"](spark, folder).collect()]
        assert sorted(got) == sorted(expected)


def test_wavelet_access_count_and_find():
    rnd = random.Random(3)
    ids = np.array([rnd.randrange(49408) if rnd.random() < 0.5 else 7 for _ in range(20_000)])
    shard = wavelet.Shard.build([3, None, 5], [ids[:10], ids[10:10], ids[10:]], 16)
    shard = wavelet.Shard.from_bytes(shard.to_bytes())
    assert (shard.tokens() == ids).all() and shard.docs.tolist() == [3, 0, 5] and shard.nulls.tolist() == [False, True, False]
    sevens = np.flatnonzero(ids == 7)
    for _ in range(200):
        i, (a, b) = rnd.randrange(len(ids)), sorted((rnd.randrange(len(ids) + 1), rnd.randrange(len(ids) + 1)))
        assert shard.access(i) == ids[i]
        assert shard.count(7, a, b) == (ids[a:b] == 7).sum()
        assert shard.find(int(ids[i]), int((ids[:i] == ids[i]).sum())) == i
        k = rnd.randrange(len(sevens))
        assert shard.find(7, k) == sevens[k]
    assert shard.find(7, len(sevens)) == -1 and shard.count(49_408) == 0
    with pytest.raises(ValueError):
        wavelet.Shard.from_bytes(b"no shard")


# --- op6 --------------------------------------------------------------------------------------------------------


def fingerprint(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(fps, distance=3):
    """Smallest member by component, all pairs compared."""
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    names = sorted(fps)
    for i, a in enumerate(names):
        for b in names[:i]:
            if (a ^ b).bit_count() <= distance:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {f: find(f) for f in names}


def test_simhash(spark, small, odd):
    for folder in (small, odd):
        rows = [(d, fingerprint(t)) for d, t in rows_of(folder)]
        root = classes({f for _, f in rows})
        least = {}
        for d, f in rows:
            if d is not None:
                least[root[f]] = min(d, least.get(root[f], d))
        expected = sorted((str(d), f"{f:016x}", least.get(root[f])) for d, f in rows)
        got = sorted((str(r[0]), r[1], r[2]) for r in QUERIES["op6_simhash_near_dedup"](spark, folder).collect())
        assert got == expected


@pytest.mark.parametrize("distance,block", [(1, 2048), (3, 7), (5, 2048)])
def test_links_lose_nothing(spark, monkeypatch, distance, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rnd = random.Random(distance)
    fps = {0, 2**64 - 1}
    for _ in range(40):
        center = rnd.getrandbits(64)
        for _ in range(12):  # chains and balls around a center
            fps.add(center)
            center ^= sum(1 << b for b in rnd.sample(range(64), rnd.randint(1, distance + 2)))
    signed = [(f - (f >> 63 << 64),) for f in fps]
    found = simhash.linked(spark.createDataFrame(signed * 2, "fp long"), distance).collect()
    got = {r["linked_fp"] % 2**64: r["root"] % 2**64 for r in found}
    expected = classes(fps, distance)
    groups = lambda m: {frozenset(f for f in fps if m.get(f, f) == m.get(g, g)) for g in fps}
    assert groups(got) == groups(expected)


def test_rounds_of_labels_write_few_files(spark, monkeypatch):
    """A file per `ROWS` edges, not one per shuffle partition, and nothing is written twice over."""
    chain = [sum(1 << i for i in range(n)) for n in range(1, 60)]  # neighbours differ in one bit
    marked = spark.createDataFrame([(f,) for f in chain], "fp long")
    files, kept_settle = [], simhash.settle

    def noted(df, label):
        out = kept_settle(df, label)
        files.append((label, len(out.inputFiles())))
        return out

    monkeypatch.setattr(simhash, "settle", noted)
    held = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    was = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        found = [simhash.linked(marked, 1).collect()]
        assert [n for label, n in files if label not in ("anchors", "loads", "edges")] == [1] * (len(files) - 3)
        assert len(files) > 5
        files.clear()
        monkeypatch.setattr(simhash, "ROWS", 40)
        found.append(simhash.linked(marked, 1).collect())
        # A part without rows has no file.
        assert 1 < max(n for label, n in files if label == "linked") <= 2 * 58 // 40 + 1
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    for rows in found:
        assert sorted((r["linked_fp"], r["root"]) for r in rows) == [(f, 1) for f in chain]


def test_anchors_cover_the_ball(spark):
    rnd = random.Random(9)
    values = [rnd.getrandbits(64) for _ in range(30)] + [0]
    rows = [(v - (v >> 63 << 64),) for v in values]
    near = {}
    for r in simhash.place(spark.createDataFrame(rows, "fp long"), 3).collect():
        near.setdefault((r["fp"], r["block"]), []).append((r["anchor"], r["home"]))
    blocks, n = simhash.block_plan(3)
    assert (blocks, n) == (2, 31)
    for (fp, block), found in near.items():
        value = (fp >> (block * 32)) & (2**31 - 1)
        assert sum(h for _, h in found) == 1 and len({a for a, _ in found}) == len(found)
        assert all((a ^ value).bit_count() <= (1 if h else 2) for a, h in found)
        assert len(found) in (1, 1 + (n - 1) // 2)


# --- op8, op10 --------------------------------------------------------------------------------------------------


def test_quality_of_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    truth = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{folder}/labels.parquet'").fetchall())
    rows = QUERIES["op8_quality_classifier"](spark, folder).collect()
    assert len(rows) == 1000
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    seen = [r["predicted"] == truth[r["doc_id"]] for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert len(seen) > 50 and sum(seen) / len(seen) > 0.95


def test_language_of_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    truth = dict(duckdb.sql(f"SELECT doc_id, lang FROM '{folder}/documents.parquet'").fetchall())
    rows = QUERIES["op10_language_by_compression"](spark, folder).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    seen = [r["lang_pred"] == truth[r["doc_id"]] for r in rows if r["held_out"]]
    assert len(seen) > 200 and sum(seen) / len(seen) > 0.95


def test_text_without_letters_has_no_language():
    judge = language.Judge({"en": b"the of and to", "de": b"der die und das"})
    for text in (None, "", " \n", "12 34", "\u00b2\u00bd", "_ - !"):
        assert judge(text) == ("und", 0.0, True)
    assert judge("x")[0] in ("de", "en")


def test_odd_rows_are_scored(spark, odd):
    n = len(rows_of(odd))
    languages = QUERIES["op10_language_by_compression"](spark, odd).collect()
    assert len(languages) == n
    assert {r["lang_pred"] for r in languages if r["doc_id"] in (1, 2, 3)} == {"und"}
    assert all(0 <= r["score"] <= 1 for r in languages)
    quality = QUERIES["op8_quality_classifier"](spark, odd).collect()
    assert len(quality) == n and all(0 <= r["score"] <= 1 for r in quality)
