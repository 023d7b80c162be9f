"""The drawn sample's expected tokens against the targets, and the query against a plain fit."""

import hashlib
import math
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from tabflow.llm import mixing
from tabflow.llm.queries import QUERIES


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_expected_tokens_meet_the_targets(spark, folder):
    docs = spark.read.parquet(f"/root/testdata/{folder}/documents.parquet")
    of, by_lang, by_topic = mixing.reachable_goals(mixing.cells(docs))
    by_source = {r["source"]: r["goal"] for r in of.collect()}
    total = sum(r["tokens"] for r in of.collect())
    rows = mixing.mix(docs).withColumn("n", mixing.n_tokens(F.col("row.text"))).collect()
    assert all(0 < r["p"] <= 1 for r in rows) and any(r["p"] < 1 for r in rows)
    for d, goal in (("source", by_source), ("lang", by_lang), ("topic", by_topic)):
        assert sum(goal.values()) == pytest.approx(mixing.KEEP * total)
        for value, wanted in goal.items():
            assert sum(r["n"] * r["p"] for r in rows if r[d] == value) == pytest.approx(wanted, abs=1e-5 * total)


def test_reachable_goals_follow_the_targets():
    """A value with enough tokens has its target; one with too few is kept whole, and the others keep their proportions."""
    assert mixing.reachable({"a": 50, "b": 50}, {"a": 0.6, "b": 0.4}, 80) == pytest.approx({"a": 48, "b": 32})
    assert mixing.reachable({"a": 70, "b": 25, "c": 5}, {"a": 0.5, "b": 0.25, "c": 0.25}, 80) == pytest.approx({"a": 50, "b": 25, "c": 5})
    assert mixing.reachable({"a": 3, "b": 4}, {"a": 0.5, "b": 0.5}, 7) == {"a": 3, "b": 4}


def test_a_reachable_target_is_met_though_cells_are_full(spark):
    """Two sources; German is short in one, so that the other must give more of it than the unbounded weights say."""
    text = " ".join(["word"] * 100)
    rows = [(f"{s}{l}{i}", text, l, s) for s, l, n in (("a", "en", 300), ("a", "de", 5), ("b", "en", 100), ("b", "de", 95)) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, lang string, source string")
    # Of 50,000 tokens 55/70 of the 40,000 kept ones are to be English, 15/70 German: there are 10,000 German ones.
    found = mixing.mix(docs).collect()
    assert sum(r["p"] for r in found if r["lang"] == "de") == pytest.approx(400 * 15 / 70, abs=0.01)


def test_goals_out_of_reach_together(spark):
    """All of one source is wanted, and less of its only language than it has: the sources' goals hold, nothing overflows."""
    text = " ".join(["word"] * 100)
    rows = [(f"{s}{l}{i}", text, l, s) for s, l, n in (("a", "de", 90), ("b", "en", 1000), ("b", "de", 10)) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, lang string, source string")
    of, _, _ = mixing.reachable_goals(mixing.cells(docs))
    goal = {r["source"]: r["goal"] / 100 for r in of.collect()}
    found = mixing.mix(docs).collect()
    for s in "ab":
        assert sum(r["p"] for r in found if r["source"] == s) == pytest.approx(goal[s], rel=1e-6)
    assert all(0 < r["p"] <= 1 for r in found)


def topic_of(text):
    n = len(text)
    if text.count("|") * 50 > n:
        return "table"
    if sum(c in "0123456789" for c in text) * 10 > n:
        return "data"
    return "brief" if n < 1000 else "article" if n < 5000 else "report"


def reachable(tokens, targets, want):
    """The scale under which all values together keep `want` tokens, by halving."""
    low, high = 0.0, 1e12
    for _ in range(300):
        middle = (low + high) / 2
        low, high = (middle, high) if sum(min(tokens[v], middle * targets[v]) for v in tokens) < want else (low, middle)
    return {v: min(tokens[v], high * targets[v]) for v in tokens}


def plain_fit(cells, keep):
    """Rates min(1, product of three factors), each factor by halving until its marginal holds; many sweeps."""
    total = [Counter(), Counter(), Counter()]
    for key, n in cells.items():
        for i in range(3):
            total[i][key[i]] += n
    want = keep * sum(cells.values())
    mean = sum(mixing.LANGUAGES.values()) / len(mixing.LANGUAGES)
    targets = [{v: n**mixing.LEVEL for v, n in total[0].items()}, {v: mixing.LANGUAGES.get(v, mean) for v in total[1]}, {v: mixing.TOPICS[v] for v in total[2]}]
    goals = [reachable(total[i], targets[i], want) for i in range(3)]
    factor = [dict.fromkeys(total[i], 1.0) for i in range(3)]
    for _ in range(400):
        for i in (2, 1, 0):
            for value, goal in goals[i].items():
                mine = [(n, math.prod(factor[j][key[j]] for j in range(3) if j != i)) for key, n in cells.items() if key[i] == value]
                low, high = -60.0, 60.0
                for _ in range(80):
                    middle = (low + high) / 2
                    low, high = (middle, high) if sum(n * min(1.0, f * math.exp(middle)) for n, f in mine) < goal * (1 - 1e-12) else (low, middle)
                factor[i][value] = math.exp(high)
    return {key: min(1.0, math.prod(factor[i][key[i]] for i in range(3))) for key in cells}


def drawn(doc_id, text):
    seen = f"mix:{'' if doc_id is None else doc_id}:{hashlib.md5(text.encode()).hexdigest()}"
    return int(hashlib.md5(seen.encode()).hexdigest()[:8], 16) / 2**32


def test_query(spark, small):
    rows = duckdb.sql(f"SELECT doc_id, coalesce(text, ''), lang, coalesce(source, '') FROM '{small}/documents.parquet'").fetchall()
    cell_of = lambda r: (r[3], r[2] if r[2] in mixing.LANGUAGES else mixing.OTHER, topic_of(r[1]))
    cells = Counter()
    for r in rows:
        cells[cell_of(r)] += len(re.findall(r"[^\x20\x09-\x0D]+", r[1]))
    rates = plain_fit({k: n for k, n in cells.items() if n}, mixing.KEEP)
    got = {r["doc_id"]: r for r in QUERIES["op7_mixing_to_targets"](spark, small).collect()}
    assert len(got) == len(rows)
    for r in rows:
        p, found = rates.get(cell_of(r), mixing.KEEP), got[r[0]]
        assert (found["source"], found["lang"], found["topic"]) == cell_of(r)
        assert found["p"] == pytest.approx(p, abs=1e-3)
        assert found["kept"] == (drawn(r[0], r[1]) < found["p"]) or abs(drawn(r[0], r[1]) - found["p"]) < 1e-5


def test_contradictions_end_and_are_told(spark):
    """Goals that cannot hold together, over many partitions: few tasks per round, an end, and the misses."""
    text = " ".join(["word"] * 10)
    rows = [(f"{s}{l}{i}", text, l, f"s{s}") for s in range(40) for l, n in (("de", 30), ("en", 5 if s else 3000), ("fr", 1)) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, lang string, source string").repartition(101)
    of = mixing.cells(docs)
    assert len(of.inputFiles()) == 1
    found = mixing.calibrate(of)
    assert not found.met and found.rounds < 200
    kept = found.probabilities.join(of.selectExpr("source", "tokens AS all"), "source")
    assert kept.filter("p < 0 OR p > 1").count() == 0
    with pytest.warns(UserWarning, match="contradict"):
        mixing.mix(docs)
