"""Licence scans against a plain comparison of every block with every template."""

import random
import re

import duckdb
import pytest

from tabflow.llm import licenses
from tabflow.llm.queries import QUERIES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
AZ = str.maketrans({c: chr(c + 32) for c in range(65, 91)})


def words(text):
    return WORD.findall((text or "").translate(AZ))


def places(split):
    out = []
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        out += [(i, label) for i in range(len(split) - len(p) + 1) if split[i : i + len(p)] == p]
    return sorted(out)


def matches(split, templates, threshold):
    out = []
    for label, text in templates:
        t = words(text)
        half = 1
        while half < len(t):
            half *= 2
        for at in range(0, len(split), half):
            block = split[at : at + 2 * half]
            shared = len(set(block) & set(t))
            if shared / len(set(t)) >= threshold - 1e-12:
                out.append((label, at, len(block), shared / len(set(t)), shared))
    overlap = lambda a, b: a[1] < b[1] + b[2] and b[1] < a[1] + a[2]
    return sorted((*m[:4], all(m[3:] >= o[3:] for o in out if overlap(m, o))) for m in out)


def expected(text):
    split = words(text)
    at, found = places(split), matches(split, licenses.TEMPLATES, licenses.THRESHOLD)
    base = {label for _, label in at}
    score = 1.0 if at else max((m[3] for m in found), default=0.0)
    firsts = [i for i, _ in at]
    return (
        len(split), len(at), min(firsts, default=None), max(firsts, default=None), ",".join(sorted(base)),
        ",".join(sorted(base | {m[0] for m in found if m[4]})), score,
    )


def test_query(spark, small, odd):
    for folder in (small, odd):
        rows = duckdb.sql(f"SELECT doc_id, text FROM '{folder}/documents.parquet'").fetchall()
        got = QUERIES["op12_license_scan"](spark, folder).collect()
        assert sorted(map(str, (tuple(r) for r in got))) == sorted(str((i, *expected(t))) for i, t in rows)


def planted():
    rnd = random.Random(9)
    vocabulary = sorted({w for _, t in licenses.TEMPLATES for w in words(t)}) + [f"w{i}" for i in range(40)]
    texts = [None, "", "mit", "MIT LICENSE", "mit\n\nlicense", "cc-by cc by", "the GNU General Public Licenses", "x" * 100_000, "ÉÀ mit licenseé", "mit license " * 3000]
    for _, template in licenses.TEMPLATES:
        t = template.split()
        for changed in (0, len(t) // 10, len(t) // 5, len(t) // 4, len(t) // 2):
            some = list(t)
            for i in rnd.sample(range(len(t)), changed):
                some[i] = rnd.choice(vocabulary)
            texts.append(" ".join([rnd.choice(vocabulary) for _ in range(rnd.randrange(60))] + some + [rnd.choice(vocabulary) for _ in range(60)]))
    return texts + [" ".join(rnd.choices(vocabulary, k=rnd.randrange(900))) for _ in range(150)]


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.8, 1.0])
def test_every_block_is_found(spark, threshold):
    texts = planted()
    docs = spark.createDataFrame(list(enumerate(texts)), "f int, text string").withColumnRenamed("f", "row")
    got = licenses.scan(docs.withColumnRenamed("row", "places"), threshold=threshold).collect()
    assert len(got) == len(texts)
    for r in got:
        split = words(texts[r["row"]["places"]])
        assert sorted(tuple(m) for m in r["matches"]) == matches(split, licenses.TEMPLATES, threshold)
        assert [(p["at"], p["label"]) for p in r["places"]] == places(split)


def test_own_templates(spark):
    docs = spark.createDataFrame([("all rights reserved by acme",), ("acme rights",)], "body string")
    got = licenses.scan(docs, "body", [("acme", "all rights reserved acme")], {"by acme": "named"}, 0.75).collect()
    assert [[tuple(m) for m in r["matches"]] for r in got] == [[("acme", 0, 5, 1.0, True)], []]
    assert [[tuple(p) for p in r["places"]] for r in got] == [[("named", 3)], []]


def test_labels_of_like_notices(spark):
    """A notice that holds enough of several templates has the label of the one it holds most of."""
    lines = {
        "This work is licensed under the GNU General Public License, version 3.": "gpl,gpl-3.0",
        "Licensed under CC BY-NC 4.0.": "cc-by,cc-by-nc-4.0",
        "Licensed under the Apache License, Version 2.0.": "apache,apache-2.0",
        "Released under the MIT License.": "mit",
        "licensed under the GNU Lesser General Public License": "lgpl",
    }
    docs = [" ".join(["word"] * 40) + "\n" + line + "\n" + " ".join(["other"] * 40) for line in lines]
    for text, wanted in zip(docs, lines.values(), strict=True):
        assert expected(text)[5] == wanted


def test_words():
    for text in [None, "", "A-Z a_z 09:@[`{ é×÷ÿ\x7f\x80 中文", "\x00a\x01b"]:
        assert [w.decode() for w in licenses.words(text)] == words(text)
