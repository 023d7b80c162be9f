"""Spelling variants against a comparison of every word with its one-edit patterns."""

import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

from tabflow.llm import spelling
from tabflow.llm.queries import QUERIES

RUN = re.compile("[A-Za-zÀ-ÿ]+")
AZ = str.maketrans({c: chr(c + 32) for c in range(65, 91)})


def count(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(AZ)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def near(counts):
    """Words that become equal by one letter left out of one or of both at one place."""
    out = defaultdict(set)
    replaced = defaultdict(set)
    for w in counts:
        for i in range(len(w)):
            shorter = w[:i] + w[i + 1 :]
            if shorter in counts:
                out[w].add(shorter)
                out[shorter].add(w)
            replaced[w[:i], w[i + 1 :]].add(w)
    for group in replaced.values():
        for w in group:
            out[w] |= group - {w}
    return out


def expected(counts):
    around = near(counts)
    form = {}
    for w, n in counts.items():
        best = min(around[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 10 * n else None
    rows = []
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        rows.append((w, form[w], root, n, len(around[w]), counts.get(form[w])))
    return sorted(rows, key=str)


def test_query(spark, small, odd):
    for folder in (small, odd):
        rows = duckdb.sql(f"SELECT doc_id, text FROM '{folder}/documents.parquet'").fetchall()
        assert sorted(map(tuple, QUERIES["op13_spelling_variants"](spark, folder).collect()), key=str) == expected(count(rows))


def found(spark, counts):
    """All near pairs of the words."""
    counted = spark.createDataFrame(list(counts.items()), "word string, n long")
    pairs = defaultdict(set)
    for r in spelling.neighbours(counted).collect():
        assert (r["n"], r["near_n"]) == (counts[r["word"]], counts[r["near"]])
        assert r["near"] not in pairs[r["word"]]
        pairs[r["word"]].add(r["near"])
    return dict(pairs)


@pytest.mark.parametrize("letters", ["ab", "abcdé", "àÿß"])
def test_dense_words(spark, letters):
    rnd = random.Random(len(letters))
    counts = {"".join(rnd.choices(letters, k=rnd.randint(7, 11))): rnd.randint(2, 90) for _ in range(900)}
    counts |= {letters[0] * n: n for n in range(7, 40)}
    assert found(spark, counts) == {w: x for w, x in near(counts).items() if x}


def test_deep_prefixes(spark):
    stem = "abcdefghij" * 7  # shared beyond one building of the trie
    counts = {stem + tail: 5 for tail in ("", "a", "b", "ab", "abc", "xbc", "zzzzzzz")} | {"x" + stem: 3, stem[:35] + stem[36:]: 2, "q" * 3000: 2, "q" * 2999 + "r": 4}
    assert found(spark, counts) == {w: x for w, x in near(counts).items() if x}


def test_chains_and_ties(spark):
    counts = {"wordform": 5000, "wordfor": 500, "wordfox": 50, "wardfox": 5, "leftside": 100, "leftsida": 3, "leftsidb": 100}
    text = "\n".join(" ".join([w] * n) for w, n in counts.items())
    docs = spark.createDataFrame([(1, text)], "id int, body string")
    got = {r["word"]: (r["form"], r["root"], r["n"], r["form_n"]) for r in spelling.variants(docs, "id", "body", deleted=None).collect()}
    assert got["wardfox"] == ("wordfox", "wordform", 5, 50)
    assert got["wordfox"] == ("wordfor", "wordform", 50, 500)
    assert got["leftsida"] == ("leftsidb", "leftsidb", 3, 100)  # of two with 100 the smaller
    assert got["leftside"] == (None, "leftside", 100, None)


def test_long_run_is_one_word(spark):
    docs = spark.createDataFrame([(None, "é" * 20_000), (None, "é" * 20_000), (3, None), (4, "")], "doc_id int, text string")
    assert [r["n"] for r in spelling.words(docs).collect()] == [2]
