"""Conflict policies: the table of cases, and random batches against a row-by-row model."""

import random

import pytest

from tabflow.operators import upsert
from tabflow.operators.upsert import KeyConflictError, apply_policy
from tabflow.runtime import ORD

SCHEMA = "Id long, a string, b string"
TARGET = [(1, "t1", "u1"), (2, "t2", "u2")]
ABSENT = object()


def target_of(spark, rows=TARGET):
    return spark.createDataFrame(rows, SCHEMA)


def batch_of(spark, rows):
    """Boxed rows from (Id, a, b) with ABSENT for cells the row does not have."""
    box = lambda v: None if v is ABSENT else (v,)
    data = [(i, box(a), box(b), (n,)) for n, (i, a, b) in enumerate(rows)]
    return spark.createDataFrame(data, f"Id long, a struct<v:string>, b struct<v:string>, {ORD} struct<n:int>").repartition(5)


def model(target, rows, policy):
    """One row after the other, as separate statements."""
    out = {k: [a, b] for k, a, b in target}
    for k, a, b in rows:
        if k is None:
            raise ValueError
        if k not in out:
            out[k] = [None if v is ABSENT else v for v in (a, b)]
        elif policy == "fail":
            raise ValueError
        elif policy == "update":
            out[k] = [old if new is ABSENT else new for old, new in zip(out[k], (a, b))]
    return sorted((k, *v) for k, v in out.items())


def run(spark, rows, policy, target=TARGET):
    return sorted(map(tuple, apply_policy(target_of(spark, target), batch_of(spark, rows), "Id", policy, boxed=True).collect()))


CASES = [
    [(3, "x", "y")],
    [(1, "x", "y")],
    [(3, "x", "y"), (3, "z", "w")],
    [(1, None, ABSENT)],
    [(3, "x", ABSENT), (3, ABSENT, "y")],
    [(1, "p", ABSENT), (1, ABSENT, None), (2, ABSENT, ABSENT)],
    [(None, "x", "y")],
    [],
]


@pytest.mark.parametrize("policy", ["fail", "ignore", "update"])
@pytest.mark.parametrize("rows", CASES)
def test_cases(spark, rows, policy):
    try:
        expected = model(TARGET, rows, policy)
    except ValueError:
        with pytest.raises(Exception):
            run(spark, rows, policy)
        return
    assert run(spark, rows, policy) == expected


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("policy", ["ignore", "update"])
def test_random_batches(spark, policy, seed):
    rng = random.Random(seed)
    value = lambda: rng.choice([ABSENT, None, "x", "y", "z"])
    target = [(k, rng.choice("pq"), None) for k in range(0, 60, 2)]
    # A third of the batch is one key.
    rows = [(rng.choice([0, rng.randrange(90), rng.randrange(90)]), value(), value()) for _ in range(400)]
    assert run(spark, rows, policy, target) == model(target, rows, policy)


@pytest.mark.parametrize("threshold", ["10MB", "-1"])
def test_both_plans_give_the_same_rows(spark, threshold):
    """A batch that is broadcast, and one that is not."""
    rng = random.Random(5)
    rows = [(rng.randrange(9), rng.choice([ABSENT, None, "x"]), rng.choice([ABSENT, "y"])) for _ in range(40)]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        collapsed = upsert.last_present_per_key(batch_of(spark, rows), "Id")
        merged = upsert.merge(target_of(spark), collapsed, "Id", boxed=True)
        assert sorted(map(tuple, merged.collect())) == model(TARGET, rows, "update")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_plain_batch(spark):
    plain = spark.createDataFrame([(1, "x", (2,)), (1, "w", (1,)), (7, "n", (3,))], f"Id long, a string, {ORD} struct<n:int>")
    got = {p: sorted(map(tuple, apply_policy(target_of(spark), plain, "Id", p).collect())) for p in ("ignore", "update")}
    assert got["update"] == [(1, "x", "u1"), (2, "t2", "u2"), (7, "n", None)]
    assert got["ignore"] == [(1, "t1", "u1"), (2, "t2", "u2"), (7, "n", None)]


def test_key_only_table(spark):
    target = spark.createDataFrame([(1,), (2,)], "Id long")
    batch = spark.createDataFrame([(2, (1,)), (3, (2,)), (3, (3,))], f"Id long, {ORD} struct<n:int>")
    for policy in ("ignore", "update"):
        assert sorted(r[0] for r in apply_policy(target, batch, "Id", policy).collect()) == [1, 2, 3]


def test_conflict_report(spark):
    batch = spark.createDataFrame([(1,), (1,), (2,), (5,), (5,), (6,)], "Id long")
    found = upsert.conflicts(target_of(spark), batch, "Id").collect()
    assert sorted(map(tuple, found)) == [(1, 2, "both"), (2, 1, "table"), (5, 2, "batch")]
    with pytest.raises(KeyConflictError, match="1"):
        upsert.refuse_conflicts(target_of(spark), batch, "Id")


def test_plans_stay_in_the_jvm_and_combine_before_the_shuffle(spark):
    rows = [(k, "x", ABSENT) for k in range(50)]
    for policy in ("ignore", "update"):
        plan = apply_policy(target_of(spark), batch_of(spark, rows), "Id", policy, boxed=True)
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in text and "Cartesian" not in text and "NestedLoop" not in text
        assert "partial_" in text
        exchanged = [line for line in text.splitlines() if "Exchange hashpartitioning" in line]
        assert exchanged


def test_null_key_is_refused_under_every_policy(spark):
    batch = spark.createDataFrame([(None, "x", (1,))], f"Id long, a string, {ORD} struct<n:int>")
    for policy in ("fail", "ignore", "update"):
        with pytest.raises(Exception, match="without a value in key column"):
            apply_policy(target_of(spark), batch, "Id", policy).collect()
