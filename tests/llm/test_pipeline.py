"""Stages of the pipeline: each against a plain model over what the stage before it kept."""

import hashlib
import os

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from tabflow.llm import bpe, chat, host_rules, line_dedup, mixing, simhash
from tabflow.llm.common import drop_settled, passing, settle
from test_brute_force import classes, fingerprint


@pytest.fixture(scope="module")
def steps(spark, small, odd):
    """Input and output of every stage, for both tables."""
    out = {}
    for name, folder in (("small", small), ("odd", odd)):
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        for stage, f in corpus_pipeline.STAGES:
            after = settle(f(spark, docs, folder), "stage")
            out[name, stage] = docs, after
            docs = after
    return out


BOTH = pytest.mark.parametrize("name", ["small", "odd"])


def key(row):
    return tuple(str(x) for x in row)


@BOTH
def test_columns_stay(steps, name):
    for stage, _ in corpus_pipeline.STAGES[:-1]:
        before, after = steps[name, stage]
        assert before.dtypes == after.dtypes


@BOTH
def test_quality_rules(steps, name):
    before, after = (sorted(map(key, x.collect())) for x in steps[name, "quality_rules"])
    expected = []
    for row in steps[name, "quality_rules"][0].collect():
        figures = dict(zip(host_rules.FIGURES, host_rules.text_figures(row["text"]), strict=True))
        if not any(eval(c.replace("OR", "or").replace("AND", "and"), figures) for c in host_rules.RULES.values()):
            expected.append(key(row))
    assert after == sorted(expected) and len(after) <= len(before)


@BOTH
def test_line_dedup(steps, name):
    before, after = (x.collect() for x in steps[name, "line_dedup"])
    sites, first = {}, {}
    blank = " \t\n\x0b\x0c\r"
    for r in before:
        for at, line in enumerate((r["text"] or "").split("\n")):
            if line.strip(blank):
                sites.setdefault(line.strip(blank), set()).add(r["source"])
                place = (r["doc_id"] is None, r["doc_id"], at)
                first[line.strip(blank)] = min(first.get(line.strip(blank), place), place)
    expected = []
    for r in before:
        kept = []
        for at, line in enumerate(r["text"].split("\n")):
            spread = len(sites.get(line.strip(blank), set()) - {None})
            if spread < line_dedup.MIN_SITES or first[line.strip(blank)] == (r["doc_id"] is None, r["doc_id"], at):
                kept.append(line)
        expected.append((str(r["doc_id"]), "\n".join(kept), len("\n".join(kept))))
    assert sorted((str(r["doc_id"]), r["text"], r["n_chars"]) for r in after) == sorted(expected)


@BOTH
def test_near_dedup(steps, name):
    before, after = (x.collect() for x in steps[name, "near_dedup"])
    root = classes({fingerprint(r["text"]) for r in before})
    groups = {}
    for r in before:
        groups.setdefault(root[fingerprint(r["text"])], []).append(r["doc_id"])
    expected = sorted(str(min((d for d in g if d is not None), default=None)) for g in groups.values())
    assert sorted(str(r["doc_id"]) for r in after) == expected


@BOTH
def test_mixing(steps, name):
    before, after = (sorted(map(key, x.collect())) for x in steps[name, "mixing"])
    assert set(after) <= set(before) and (name == "odd" or 0.5 * len(before) < len(after) < len(before))


@BOTH
def test_encoding(steps, name):
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    before, after = (x.collect() for x in steps[name, "byte_bpe"])
    expected = [(str(r["doc_id"]), reference.encode_ordinary(r["text"]), hashlib.sha256(r["text"].encode()).hexdigest()) for r in before]
    assert sorted((str(r["doc_id"]), r["ids"], r["decoded_sha256"]) for r in after) == sorted(expected)


def test_run_on_empty_tables(spark, empty):
    assert corpus_pipeline.run(spark, empty).collect() == []


# --- properties of single operators -----------------------------------------------------------------------------


def test_a_bad_host_takes_its_documents_along(spark):
    good = "many different words make up this text so that it passes every rule that looks at one text alone here {}"
    rows = [(i, good.format(i), f"h{i % 20}") for i in range(400)]
    rows += [(1000 + i, "too short", "bad") for i in range(60)] + [(2000, good.format("x"), "bad"), (3000, "short", "tiny")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    judged = {r["row"]["doc_id"]: r for r in host_rules.judge(host_rules.measure(docs)).collect()}
    assert judged[2000]["host_rejected"] and not judged[2000]["kept"] and not judged[2000]["base_failed"]
    assert judged[0]["kept"] and not judged[3000]["kept"]
    assert sum(r["kept"] for r in judged.values()) == 400


def test_lines_near_the_threshold_are_counted_exactly(spark):
    """As many sites as sketches estimate with an error, on both sides of the threshold."""
    n = 2000
    rows = [(i, "on all\n" + ("on most\n" if i else "") + f"own {i}", f"s{i}") for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = {r["doc_id"]: r["text"] for r in line_dedup.keep_lines(docs, min_sites=n).collect()}
    assert out[0] == "on all\nown 0" and out[1] == "on most\nown 1" and out[n - 1] == f"on most\nown {n - 1}"


def test_ties_and_long_dialogues(spark):
    rows = [(1, i // 50, f"p{i % 2}", f"t{i}") for i in range(1500)]
    parts = chat.rotate(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    for speaker in ("p0", "p1"):
        mine = sorted((r for r in parts if r["assistant"] == speaker), key=lambda r: r["part"])
        assert [r["n_turns"] for r in mine] == [256] * 5 + [220]
        whole = "".join(r["rendered"] for r in mine)
        assert [r["start"] for r in mine] == [sum(len(x["rendered"]) for x in mine[:i]) for i in range(len(mine))]
        said = [whole[s["from"] : s["to"]] for r in mine for s in r["mask"]]
        assert sorted(said) == sorted(t for _, _, p, t in rows if p == speaker)
        turns = [int(x.split("<|im_end|>")[0].split("\nt")[1]) // 50 for x in whole.split("<|im_start|>")[1:]]
        assert turns == sorted(turns)


def test_repeated_rows_leave_one_document(spark):
    rows = [(1, "same text of some words here", "a")] * 3 + [(None, "same text of some words here", "b"), (2, None, "c"), (None, None, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    assert sorted(r["doc_id"] for r in simhash.keep_one(docs).collect()) == [1, 2]


def test_superseded_folders_are_deleted(spark, small):
    """What rounds leave behind goes; of the linked fingerprints one folder stays."""
    root = f"{spark.conf.get('spark.checkpoint.dir')}/tabflow"
    before = set(os.listdir(root)) if os.path.isdir(root) else set()
    marked = spark.read.parquet(f"{small}/documents.parquet").select(simhash.fingerprints(F.col("text"), 3).alias("fp"))
    found = simhash.linked(marked)
    assert {x.split("-")[0] for x in set(os.listdir(root)) - before} == {"linked"}
    assert found.count() >= 0
    with passing(spark) as kept:
        stays, goes = settle(spark.range(3), "a"), settle(spark.range(4), "b")
        kept.append(stays)
    assert stays.count() == 3 and {x.split("-")[0] for x in set(os.listdir(root)) - before} == {"linked", "a"}
    with pytest.raises(Exception):
        goes.count()
    drop_settled(stays)
