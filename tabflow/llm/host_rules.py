"""Host-level quality rules: rule failures by domain, rates shrunk by an empirical beta prior, verdicts for documents.

Rules look at one text at a time (`figures`). Failures are counted per host; a host's failure rate under a rule is
shrunk towards the corpus by a beta prior whose strength comes from the spread between hosts (method of moments), so a
host with few documents is not condemned by one of them. A host whose shrunk rate is above `host_limit` under any rule
loses all its documents; elsewhere a document goes if it fails a rule itself.

Defined results: a null text has no words and fails; a null host is one host; repeated rows count as often as they
occur; an empty table gives an empty one; extra columns are carried along untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tabflow.llm.common import settle
from tabflow.runtime import col

SPACES = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Bounds of a prior's strength, in documents: what a host without spread, or with nothing but spread, comes to.
STRENGTH = (2.0, 10_000.0)

FIGURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]

#: Rule name -> condition of failure over the figures, valid in Spark and in ANSI SQL.
RULES = {
    "short": "n_words < 20",
    "repeats": "100 * n_repeat_words > 30 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "word_length": "word_chars < 2 * n_words OR word_chars > 12 * n_words",
    "dup_lines": "n_dup_lines > 2 AND 10 * n_dup_lines > 3 * n_lines",
}
BASE = ("short", "repeats")


def repeat_words(words: list[bytes]) -> int:
    """Words inside windows of eight words that occur twice or more; windows are told apart exactly, by doubling."""
    n = len(words)
    if n <= WINDOW:
        return 0
    number = {w: i for i, w in enumerate(set(words))}
    if len(number) == n:
        return 0
    codes = np.fromiter(map(number.__getitem__, words), np.int64, n)
    width = 1
    while True:
        codes = codes[:-width] * n + codes[width:]
        width *= 2
        distinct, codes, counts = np.unique(codes, return_inverse=True, return_counts=True)
        if len(distinct) == len(codes):
            return 0
        if width == WINDOW:
            break
    starts = np.flatnonzero(counts[codes] > 1)
    edges = np.zeros(n + 1, np.int64)
    edges[starts] += 1
    edges[starts + WINDOW] -= 1
    return int((np.cumsum(edges[:-1]) > 0).sum())


def text_figures(text: str | None) -> tuple[int, ...]:
    text = text or ""
    words = text.encode().split()
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return (
        len(words),
        len(text) - sum(map(text.count, SPACES)),
        sum(map(text.count, SYMBOLS)),
        len(lines),
        len(lines) - len(set(lines)),
        repeat_words(words),
    )


@F.pandas_udf(StructType([StructField(name, LongType()) for name in FIGURES]))
def figures(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in texts:
        yield pd.DataFrame([text_figures(t) for t in batch], columns=FIGURES)


def measure(
    docs: DataFrame, host: str = "source", text: str = "text", keep_columns: list[str] | None = None
) -> DataFrame:
    """Host, figures and one boolean per rule, written down once beside the row (all of its columns, or those named)."""
    row = F.struct(*[col(c) for c in keep_columns or docs.columns]).alias("row")
    base = docs.select(row, col(host).cast("string").alias("host"), figures(col(text)).alias("f"))
    rows = base.select("row", "host", "f.*")
    return settle(rows.select("*", *[F.expr(rule).alias(f"fails_{name}") for name, rule in RULES.items()]), "figures")


def host_rates(measured: DataFrame) -> DataFrame:
    """One row per host: documents, and the shrunk failure rate per rule."""
    fails = {r: F.sum(F.col(f"fails_{r}").cast("long")) for r in RULES}
    hosts = settle(measured.groupBy("host").agg(F.count("*").alias("n"), *[f.alias(r) for r, f in fails.items()]), "hosts")
    sums = hosts.agg(
        F.sum("n").alias("n"),
        F.count("*").alias("hosts"),
        *[F.sum(r).alias(r) for r in RULES],
        *[F.sum(F.col(r) * F.col(r) / F.col("n")).alias(f"{r}_squares") for r in RULES],
    ).first()
    return hosts.select("host", "n", *[_shrunk(r, *_prior(sums, r)).alias(f"rate_{r}") for r in RULES])


def _prior(sums, rule: str) -> tuple[float, float]:
    """Mean and strength of the beta prior: what the hosts' rates spread beyond the noise of sampling."""
    if not sums["n"]:
        return 0.0, STRENGTH[0]
    mean = sums[rule] / sums["n"]
    noise = mean * (1 - mean)
    spread = sums[f"{rule}_squares"] / sums["n"] - mean * mean - noise * sums["hosts"] / sums["n"]
    strength = noise / spread - 1 if spread > 0 else STRENGTH[1]
    return mean, min(max(strength, STRENGTH[0]), STRENGTH[1])


def _shrunk(rule: str, mean: float, strength: float) -> Column:
    return (F.col(rule) + F.lit(mean * strength)) / (F.col("n") + F.lit(strength))


def judge(measured: DataFrame, host_limit: float = 0.5) -> DataFrame:
    """Measured rows with `base_failed`, `host_rejected` and `kept`.

    The verdicts go back by a plain join on the host: with one row per host, Spark broadcasts them if they turn out
    small and splits the partition of a hot host otherwise.
    """
    rates = host_rates(measured)
    bad = rates.select(
        F.col("host").alias("judged"),
        F.greatest(*[F.col(f"rate_{r}") for r in RULES]).alias("worst_rate"),
    )
    joined = measured.join(bad, F.col("host").eqNullSafe(F.col("judged")), "left").drop("judged")
    base = F.col(f"fails_{BASE[0]}") | F.col(f"fails_{BASE[1]}")
    any_rule = F.greatest(*[F.col(f"fails_{r}") for r in RULES])
    out = joined.withColumn("base_failed", base).withColumn("host_rejected", F.col("worst_rate") > host_limit)
    return out.withColumn("kept", ~any_rule & ~F.col("host_rejected"))


def keep(docs: DataFrame, host: str = "source", text: str = "text", host_limit: float = 0.5) -> DataFrame:
    """The documents that pass, with their own columns."""
    return judge(measure(docs, host, text), host_limit).filter("kept").select("row.*")
