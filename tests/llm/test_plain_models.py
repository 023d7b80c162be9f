"""The quality classifier and the language guess against plain models: dictionaries of floats, one text at a time."""

import math
import re
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
import zstandard

from tabflow.llm import language, quality
from tabflow.llm.queries import QUERIES

M = 2**64


def spark_hash(*values):
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(v.encode(), seed)
    return seed - (seed >> 63 << 64)


def remainder(doc_id, of):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % of


# --- quality ----------------------------------------------------------------------------------------------------


def shape(word):
    upper = "A" if len(word) > 1 and word.isupper() else ""
    bare = word.rstrip(".,")
    if bare.isalpha():
        return upper + "a" + word[len(bare):]
    word = re.sub(r"[^\W\d_]+", "a", word)
    word = re.sub(r"\d+", "9", word)
    return upper + re.sub(r"(\W)\1+", r"\1", word)


def buckets(text):
    words = (text or "").split()
    own = [zlib.crc32(w.lower().encode()) for w in words]
    shapes = [1 if own[i] in own[max(0, i - 4) : i] else zlib.crc32(shape(w).encode(), 1) for i, w in enumerate(words)]
    grams = own + [s * 3 + 1 for s in shapes]
    grams += [a * 31 + b + 2 for a, b in zip(own, own[1:])] + [a * 31 + b + 3 for a, b in zip(shapes, shapes[1:])]
    return [(g * 0x9E3779B97F4A7C15 % M) >> (64 - quality.BITS) for g in grams]


def plain_weights(labelled):
    """labelled: (hash, label, text); follow-the-regularised-leader, one coordinate after the other."""
    rows = []
    for h, y, text in labelled:
        found = buckets(text)
        counts = {b: found.count(b) for b in sorted(set(found))}
        rows.append((h, y, {b: float(np.float32(n * (10.0 / max(1, len(found))))) for b, n in counts.items()}))
    rows.sort(key=lambda r: r[:2])
    z, n, bias = {}, {}, 1 << quality.BITS
    share = sum(y for _, y, _ in rows) / len(rows)
    weight = {1: 1.0, 0: min(4.0, max(1.0, share / max(1 - share, 1e-9) / 2))}

    def w(i):
        zi = z.get(i, 0.0)
        if abs(zi) <= quality.L1:
            return 0.0
        return (math.copysign(quality.L1, zi) - zi) / ((quality.BETA + math.sqrt(n.get(i, 0.0))) / quality.ALPHA + quality.L2)

    for _ in range(quality.PASSES):
        for _, y, x in rows:
            x = x | {bias: 1.0}
            held = {i: w(i) for i in x}
            p = 1 / (1 + math.exp(-sum(held[i] * v for i, v in x.items())))
            for i, v in x.items():
                g = (p - y) * weight[y] * v
                was = n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - (math.sqrt(was + g * g) - math.sqrt(was)) / quality.ALPHA * held[i]
                n[i] = was + g * g
    return {i: float(np.float32(w(i))) for i in z}, bias


def test_quality(spark, small):
    docs = dict(duckdb.sql(f"SELECT doc_id, text FROM '{small}/documents.parquet'").fetchall())
    labels = duckdb.sql(f"SELECT doc_id, quality FROM '{small}/labels.parquet' WHERE quality IS NOT NULL").fetchall()
    learned = [(spark_hash(str(i)), y, docs[i]) for i, y in labels if remainder(i, 4) != 2 and docs.get(i) is not None]
    assert 20 < len(learned) <= quality.SAMPLE
    weights, bias = plain_weights(learned)
    got = {r["doc_id"]: r for r in QUERIES["op8_quality_classifier"](spark, small).collect()}
    assert len(got) == len(docs)
    for i, text in docs.items():
        found = buckets(text)
        score = 1 / (1 + math.exp(-(sum(weights.get(b, 0.0) for b in found) * (10.0 / max(1, len(found))) + weights[bias])))
        assert got[i]["score"] == pytest.approx(score, abs=1e-5)
        assert got[i]["held_out"] == (remainder(i, 4) == 2) and got[i]["predicted"] == int(got[i]["score"] >= 0.7)


def test_more_labels_than_are_learned(spark):
    """The sample is that of the smallest hashes, also where many rows share an id."""
    rows = [(i, f"text {i} has words {i % 7}" if i % 3 else f"### {i} $$$ {i}") for i in range(300)] + [(5, f"copy {i}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(i, 1 if i % 3 else 0) for i in range(300)], "doc_id long, label int")
    chosen = sorted(range(300), key=lambda i: spark_hash(str(i)))[:40]
    assert 5 not in chosen
    weights, bias = plain_weights([(spark_hash(str(i)), 1 if i % 3 else 0, rows[i][1]) for i in chosen])
    got = quality.fit(docs, labels, sample=40)
    assert {i for i in np.flatnonzero(got).tolist()} == {i for i, w in weights.items() if w}
    assert all(got[i] == pytest.approx(w, abs=1e-6) for i, w in weights.items())


# --- language ---------------------------------------------------------------------------------------------------


def normal(text):
    return re.sub(r"[\W\d_]+", " ", (text or "").lower()).strip()


def plain_languages(rows):
    """Per language the last bytes of the openings with the smallest hashes."""
    chosen = {}
    for i, text, lang in rows:
        if text is not None and lang is not None:
            head = text[: language.HEAD]
            chosen.setdefault(lang, set()).add((spark_hash(str(i), head), head))
    return {k: " ".join(normal(head) for _, head in sorted(v)[: language.SAMPLE]).encode()[-language.DICTIONARY :] for k, v in chosen.items()}


def test_language(spark, small):
    rows = duckdb.sql(f"SELECT doc_id, text, lang FROM '{small}/documents.parquet'").fetchall()
    held = plain_languages([r for r in rows if remainder(r[0], 3) != 1])
    got = {r["doc_id"]: r for r in QUERIES["op10_language_by_compression"](spark, small).collect()}
    assert len(got) == len(rows) and len(held) == 4
    for i, text, _ in rows:
        letters = normal(text)
        r = got[i]
        if not any(c.isalpha() for c in letters):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        data, sizes = letters.encode(), {}
        for lang, content in held.items():
            known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            press = zstandard.ZstdCompressor(level=language.LEVEL, dict_data=known, write_checksum=False, write_content_size=False, write_dict_id=False)
            sizes[lang] = sum(len(press.compress(data[at : at + language.PIECE])) for at in range(0, len(data), language.PIECE))
        best, second = sorted(sizes.values())[:2]
        assert sizes[r["lang_pred"]] <= best * 1.02  # a level set by hand may differ from a prepared one by some bytes
        assert r["score"] == pytest.approx(min(1.0, (second - best) / second / language.CERTAIN), abs=0.25)
        assert r["held_out"] == (remainder(i, 3) == 1)
