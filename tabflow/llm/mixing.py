"""Mixing to target weights: token weights raked to source, language and topic marginals, then sampled.

Documents are summed to cells of (source, language, topic). Iterative proportional fitting scales the cells' token
weights in turn so that their sums by source, by language and by topic meet the targets, and each document is kept or
left by a hash of its id and text, with its cell's probability. The weights are raked under the bound that goes with
probabilities: a cell counts with at most the tokens it has, and the others are raked to what is left of each marginal. At
a given kept share a value whose target asks for more tokens than there are cannot meet it, whatever the probabilities: it
is kept whole, and the other values of its dimension share the rest in proportion to their targets.

Rounds go on until all these goals are met. Goals of the three dimensions may contradict each other; then the rounds end
when they bring the worst miss no further down, the best of them counts, the goals of the sources hold, and the misses
of languages and topics are returned and warned of.

There may be any number of sources, but languages and topics are closed sets. So the cells are a table with one row per
source and one column per pair of language and topic: scaling by source is a step within the row, and the factors of
languages and topics follow from one row of sums per round, as many numbers as there are pairs.

Defined results: a null source is a value of its own (empty text); languages without a target, null included, count as
one, `other`, whose target is the mean of the given ones; targets are scaled to the values that occur; a null or empty
text has no tokens and follows its cell like any other document; documents of a source without tokens are kept at the
overall rate; rows equal in id and text share one decision; an empty table gives an empty one.
"""

from __future__ import annotations

import math
import warnings
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabflow.llm.common import drop_settled, packed, settle
from tabflow.runtime import col

DIMENSIONS = ("source", "lang", "topic")
#: Share of the tokens to keep.
KEEP = 0.8
#: Distance from the goals, as a share of the kept tokens, at which they are met.
STABLE = 1e-6
#: Rounds end, too, if so many of them did not lower the worst miss by this share.
PATIENCE, PROGRESS = 6, 0.05
#: Factors stay within this and its inverse, so that products of them stay numbers.
REACH = 1e30
#: Rows of cells per file.
CELL_ROWS = 100_000
#: Sources are levelled: a source's target is its share of the tokens to this power.
LEVEL = 0.5
#: Target weights of languages and topics; a language that is not listed is `OTHER`.
LANGUAGES = {"en": 0.55, "de": 0.15, "fr": 0.15, "es": 0.15}
OTHER = "other"
TOPICS = {"brief": 0.1, "article": 0.45, "report": 0.35, "table": 0.05, "data": 0.05}


def n_tokens(text: Column) -> Column:
    """Words of a text."""
    trimmed = F.trim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, r"[\x20\x09-\x0D]+"))).cast("long")


def topic(text: Column) -> Column:
    """Kind of a text by its form: tables by their bars, data by their digits, prose by its length."""
    text = F.coalesce(text, F.lit(""))
    n = F.length(text)
    less = lambda chars: n - F.length(F.translate(text, chars, ""))
    return (
        F.when(less("|") * 50 > n, "table")
        .when(less("0123456789") * 10 > n, "data")
        .when(n < 1000, "brief")
        .when(n < 5000, "article")
        .otherwise("report")
    )


def _dims(docs: DataFrame, source: str, lang: str, text: str) -> list[Column]:
    known = F.when(col(lang).isin(*LANGUAGES), col(lang)).otherwise(OTHER)
    return [F.coalesce(col(source).cast("string"), F.lit("")).alias("source"), known.alias("lang"), topic(col(text)).alias("topic")]


def _pairs() -> list[tuple[str, str]]:
    return [(l, t) for l in (*LANGUAGES, OTHER) for t in TOPICS]


def cells(docs: DataFrame, source: str = "source", lang: str = "lang", text: str = "text") -> DataFrame:
    """One row per source with its tokens in each pair of language and topic; combined in each task before the shuffle."""
    rows = docs.select(*_dims(docs, source, lang, text), n_tokens(col(text)).alias("n"))
    inside = [F.when((F.col("lang") == l) & (F.col("topic") == t), F.col("n")).otherwise(0) for l, t in _pairs()]
    sums = rows.groupBy("source").agg(F.sum("n").alias("tokens"), *[F.sum(x).alias(f"tokens_{k}") for k, x in enumerate(inside)])
    sums = settle(sums.filter("tokens > 0"), "cells")
    # Every round reads them: few rows are not to lie in as many files as there were tasks.
    few = settle(sums.coalesce(max(1, math.ceil(sums.count() / CELL_ROWS))), "cells")
    drop_settled(sums)
    return few


def goals(of: DataFrame) -> tuple[float, dict[str, float], dict[str, float]]:
    """What source targets, languages and topics are scaled by: the sum over sources, and targets that sum to 1."""
    sums = of.agg(
        F.sum(F.pow(F.col("tokens").cast("double"), F.lit(LEVEL))).alias("levelled"),
        *[F.sum(f"tokens_{k}").alias(f"tokens_{k}") for k in range(len(_pairs()))],
    ).first()
    given = {**LANGUAGES, OTHER: sum(LANGUAGES.values()) / len(LANGUAGES)}
    there = {name for k, pair in enumerate(_pairs()) if sums[f"tokens_{k}"] for name in pair}
    scaled = []
    for targets in (given, TOPICS):
        total = sum(v for name, v in targets.items() if name in there)
        scaled.append({name: v / total for name, v in targets.items() if name in there})
    return sums["levelled"], *scaled


def reachable(tokens: dict[str, float], targets: dict[str, float], want: float) -> dict[str, float]:
    """Tokens to keep of each value: in proportion to the targets, but no more than there are."""
    out: dict[str, float] = {}
    while len(out) < len(targets):
        scale = (want - sum(out.values())) / sum(v for name, v in targets.items() if name not in out)
        short = {name: tokens[name] for name, v in targets.items() if name not in out and scale * v >= tokens[name]}
        if not short:
            return {name: out.get(name, scale * v) for name, v in targets.items()}
        out |= short
    return out


def reachable_goals(of: DataFrame, keep: float = KEEP) -> tuple[DataFrame, dict[str, float], dict[str, float]]:
    """The cells with the tokens to keep of each source as `goal`, and the tokens to keep by language and by topic.

    Sources stay a table: the scale of their targets is found by one row of sums per step, and rises until it holds.
    """
    levelled, by_lang, by_topic = goals(of)
    row = of.agg(F.sum("tokens").alias("tokens"), *[F.sum(f"tokens_{k}").alias(f"tokens_{k}") for k in range(len(_pairs()))]).first()
    inside = {pair: row[f"tokens_{k}"] for k, pair in enumerate(_pairs())}
    want = keep * row["tokens"]
    tokens, level, scale = F.col("tokens").cast("double"), F.pow(F.col("tokens").cast("double"), F.lit(LEVEL)), want / levelled
    while True:
        full = level * F.lit(scale) >= tokens
        sums = of.agg(F.sum(F.when(full, tokens).otherwise(0.0)).alias("full"), F.sum(F.when(full, 0.0).otherwise(level)).alias("open")).first()
        found = (want - sums["full"]) / sums["open"] if sums["open"] else scale
        if found <= scale * (1 + 1e-12):
            break
        scale = found
    by_lang = reachable({l: sum(inside[l, t] for t in TOPICS) for l in by_lang}, by_lang, want)
    by_topic = reachable({t: sum(inside[l, t] for l in (*LANGUAGES, OTHER)) for t in by_topic}, by_topic, want)
    return of.withColumn("goal", F.least(tokens, level * F.lit(scale))), by_lang, by_topic


def _step(factor: float, goal: float, full: float, open_: float) -> float:
    """A factor after a step to its goal: full cells stay as they are, the open ones are scaled to what is left."""
    step = (goal - full) / open_ if open_ > 0 else 1.0 if full <= goal else 0.0
    return min(REACH, max(1 / REACH, factor * min(8.0, max(0.125, step))))


class Calibration(NamedTuple):
    """Probabilities per cell, (source, lang, topic, p), and how far each language and topic is off its goal.

    misses: share of the kept tokens above or below the goal, by (dimension, value); all within `STABLE` if `met`.
    """

    probabilities: DataFrame
    misses: dict[tuple[str, str], float]
    rounds: int

    @property
    def met(self) -> bool:
        return all(abs(m) <= STABLE for m in self.misses.values())


def calibrate(of: DataFrame, keep: float = KEEP) -> Calibration:
    """Probabilities whose expected tokens meet the reachable goals, see the module.

    A source's scale follows from its own row: its kept tokens, min(1, scale * factor) of each cell, rise with the scale
    along straight lines, one per set of full cells, and are the least of these. Languages and topics take one step per
    round, from one row of sums that comes to the driver.
    """
    of, by_lang, by_topic = reachable_goals(of, keep)
    pairs = _pairs()
    want = sum(by_lang.values())
    of = of.selectExpr("source", "goal", "double(tokens) AS tokens", f"array({', '.join(f'double(tokens_{k})' for k in range(len(pairs)))}) AS cells")
    # Factors enter as arrays, which are no part of the generated code: it is compiled once for all rounds.
    given = lambda values, kind: f"array({', '.join(f'{v!r}{kind}' for v in values)})"

    def scaled(lang: dict[str, float], topics: dict[str, float]) -> DataFrame:
        factors = [lang[l] * topics[t] for l, t in pairs]
        order = sorted(range(len(pairs)), key=factors.__getitem__)
        cells_up = f"zip_with({given(order, '')}, {given([factors[k] for k in order], 'D')}, (k, f) -> named_struct('n', cells[k], 'f', f))"
        scale = (
            f"aggregate({cells_up}, named_struct('full', tokens, 'open', 0D, 'scale', 0D), (s, x) -> named_struct("
            "'full', s.full - x.n, 'open', s.open + x.n * x.f, "
            "'scale', greatest(s.scale, (goal - s.full + x.n) / nullif(s.open + x.n * x.f, 0D))), s -> s.scale)"
        )
        rates = f"zip_with(array_repeat({scale}, {len(pairs)}), {given(factors, 'D')}, (s, f) -> s * f)"
        return of.selectExpr("source", "cells", f"{rates} AS rates")

    lang, topics = dict.fromkeys((*LANGUAGES, OTHER), 1.0), dict.fromkeys(TOPICS, 1.0)
    best, waited, rounds = (math.inf, lang, topics, {}), 0, 0
    while True:
        rounds += 1
        row = scaled(lang, topics).selectExpr(
            *[f"sum(if(rates[{k}] >= 1, cells[{k}], 0D)) AS full_{k}" for k in range(len(pairs))],
            *[f"sum(if(rates[{k}] >= 1, 0D, cells[{k}] * rates[{k}])) AS open_{k}" for k in range(len(pairs))],
        ).first()
        full, open_ = ({pair: row[f"{kind}_{k}"] for k, pair in enumerate(pairs)} for kind in ("full", "open"))
        kept = {pair: full[pair] + open_[pair] for pair in pairs}
        misses = {("lang", l): (sum(kept[l, t] for t in TOPICS) - goal) / want for l, goal in by_lang.items()}
        misses |= {("topic", t): (sum(kept[l, t] for l in lang) - goal) / want for t, goal in by_topic.items()}
        worst = max(abs(m) for m in misses.values())
        waited = 0 if worst < (1 - PROGRESS) * best[0] else waited + 1
        if worst < best[0]:
            best = (worst, lang, topics, misses)
        if worst <= STABLE or waited >= PATIENCE:
            break
        before = lang
        lang = {l: _step(v, by_lang[l], sum(full[l, t] for t in topics), sum(open_[l, t] for t in topics)) if l in by_lang else v for l, v in lang.items()}
        moved = {l: v / before[l] for l, v in lang.items()}
        topics = {
            t: _step(v, by_topic[t], sum(full[l, t] for l in lang), sum(open_[l, t] * moved[l] for l in lang)) if t in by_topic else v
            for t, v in topics.items()
        }
    _, lang, topics, misses = best
    entries = ", ".join(f"named_struct('lang', '{l}', 'topic', '{t}', 'n', cells[{k}], 'p', least(1D, rates[{k}]))" for k, (l, t) in enumerate(pairs))
    found = scaled(lang, topics).selectExpr("source", f"inline(array({entries}))").filter("n > 0").select(*DIMENSIONS, "p")
    return Calibration(settle(found, "probabilities"), misses, rounds)


def draw(id_: Column, text: Column) -> Column:
    """A number from 0 up to 1 that depends on the document alone."""
    seen = F.concat(F.lit("mix:"), F.coalesce(id_.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return F.conv(F.substring(F.md5(seen.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)


def mix(
    docs: DataFrame, id_col: str = "doc_id", source: str = "source", lang: str = "lang", text: str = "text", keep: float = KEEP
) -> DataFrame:
    """(row, source, lang, topic, p, kept): every document with its cell's probability and its own decision.

    The probabilities are one row per cell; Spark broadcasts them if they are small, else it splits the hot cell.
    """
    wanted = probabilities_of(docs, source, lang, text, keep)
    rows = packed(docs, *_dims(docs, source, lang, text), draw(col(id_col), col(text)).alias("u"))
    joined = rows.join(wanted, list(DIMENSIONS), "left")
    # A cell without tokens has no rate of its own: its documents are kept at the overall rate.
    joined = joined.withColumn("p", F.coalesce("p", F.lit(keep)))
    return joined.select("row", *DIMENSIONS, "p", (F.col("u") < F.col("p")).alias("kept"))


def probabilities_of(docs: DataFrame, source: str, lang: str, text: str, keep: float) -> DataFrame:
    of = cells(docs, source, lang, text)
    if of.limit(1).count() == 0:
        return of.select("source", F.lit("").alias("lang"), F.lit("").alias("topic"), F.lit(keep).alias("p"))
    found = calibrate(of, keep)
    drop_settled(of)
    if not found.met:
        off = ", ".join(f"{d} {v} {m:+.4f}" for (d, v), m in found.misses.items() if abs(m) > STABLE)
        warnings.warn(f"the mixing goals contradict each other; off by, as shares of the kept tokens: {off}", stacklevel=2)
    return found.probabilities


def sample(docs: DataFrame, keep: float = KEEP, **names: str) -> DataFrame:
    """The documents that are kept, with their own columns; the expected tokens meet the reachable goals."""
    return mix(docs, keep=keep, **names).filter("kept").select("row.*")
