"""Chat formatting by perspective: a dialogue is rendered once for every participant, who then is the assistant.

Each turn becomes a segment: a header, the text and an end mark. In the rendering for a participant that speaker's
turns are the assistant's, all other speakers are users with their names, and system turns stay system turns; the mask
covers exactly the assistant's texts. A rendering is cut into parts of at most `PART` turns, so that a dialogue of any
length is many rows and no row or group grows with it; dialogues up to that length are one part.

Places are counted in characters from the start of the whole rendering: part sums first, then sums over the parts
before, so that the turns of one dialogue never meet in one task.

Defined results: turns are ordered by number (null first), turns of one number by a hash of speaker and text; rows that
repeat a turn are one turn; a null speaker is `unknown`; a null text is empty; rows without a dialogue id belong to one dialogue without an id; a dialogue with no
speaker but the system has no rendering; marks inside texts are broken by a blank, so that a text cannot end its turn;
an empty table gives an empty one; other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabflow.llm.common import settle
from tabflow.runtime import col

#: Turns of one part, turn numbers of one stretch, and buckets that turns of one number are dealt to.
PART, STRETCH, TIES = 256, 256, 64
SYSTEM, UNKNOWN = "system", "unknown"
START, END = "<|im_start|>", "<|im_end|>\n"


def turns(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, tie, speaker, body): each turn once, marks in texts and names made harmless."""
    safe = lambda c, none: F.replace(F.coalesce(c, F.lit(none)), F.lit("<|"), F.lit("< |"))
    name = F.regexp_replace(safe(col(speaker), UNKNOWN), r"[\r\n]+", " ")
    found = rows.select(
        col(conv).alias("conv"), col(turn).cast("long").alias("turn"), name.alias("speaker"), safe(col(text), "").alias("body")
    )
    return found.distinct().withColumn("tie", F.xxhash64("speaker", "body"))


def numbered(said: DataFrame) -> DataFrame:
    """Add `at`, a turn's number in its dialogue, from 0.

    Turns are counted per stretch of turn numbers, per number and bucket of the tie hash, and one by one within a
    bucket; each count is summed over what comes before it on its own level, so a dialogue that holds a third of all
    rows is spread over as many windows as it has stretches.
    """
    stretch = F.floor(F.col("turn") / STRETCH).alias("stretch")
    said = said.select("*", stretch, F.shiftright("tie", 58).alias("bucket"))
    n = F.count("*").alias("n")
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda window: F.coalesce(F.sum("n").over(window), F.lit(0))
    fine = said.groupBy("conv", "stretch", "turn", "bucket").agg(n)
    coarse = fine.groupBy("conv", "stretch").agg(F.sum("n").alias("n"))
    coarse = coarse.select("conv", "stretch", so_far(before("conv").orderBy("stretch")).alias("base"))
    fine = fine.withColumn("skip", so_far(before("conv", "stretch").orderBy("turn", "bucket"))).drop("n")
    place = _meet(fine, coarse, ["conv", "stretch"]).select("conv", "stretch", "turn", "bucket", (F.col("base") + F.col("skip")).alias("skip"))
    within = Window.partitionBy("conv", "turn", "bucket").orderBy("tie", "speaker", "body")
    said = said.withColumn("nth", F.row_number().over(within) - 1)
    met = _meet(said, place.drop("stretch"), ["conv", "turn", "bucket"])
    return met.select("conv", (F.col("skip") + F.col("nth")).alias("at"), "speaker", "body")


def _meet(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Inner join on columns where null equals null."""
    named = right.select(*[F.col(c).alias(f"right_{c}" if c in on else c) for c in right.columns])
    same = [F.col(c).eqNullSafe(F.col(f"right_{c}")) for c in on]
    return left.join(named, same).drop(*[f"right_{c}" for c in on])


def header(as_assistant: Column, speaker: Column) -> Column:
    return (
        F.when(speaker == SYSTEM, F.lit(f"{START}system\n"))
        .when(as_assistant, F.lit(f"{START}assistant\n"))
        .otherwise(F.concat(F.lit(f"{START}user name="), speaker, F.lit("\n")))
    )


def rotate(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text") -> DataFrame:
    """One row per dialogue, participant and part.

    (conv, assistant, part, start, n_turns, rendered, mask): `start` is the place of the part in the whole rendering,
    `mask` the spans [from, to) of the assistant's texts in the whole rendering, in order.
    """
    said = settle(numbered(turns(rows, conv, turn, speaker, text)), "turns")
    people = said.filter(F.col("speaker") != SYSTEM).select("conv", F.col("speaker").alias("assistant")).distinct()
    wide = _meet(said, people, ["conv"])
    mine = (F.col("speaker") == F.col("assistant")) & (F.col("speaker") != SYSTEM)
    segment = F.struct("at", mine.alias("mine"), header(mine, F.col("speaker")).alias("head"), "body")
    by = ["conv", "assistant", "part"]
    wide = wide.select("conv", "assistant", F.floor(F.col("at") / PART).alias("part"), segment.alias("segment"))
    parts = wide.groupBy(*by).agg(F.sort_array(F.collect_list("segment")).alias("said"))
    pieces = F.transform("said", lambda x: F.concat(x["head"], x["body"], F.lit(END)))
    parts = settle(parts.select(*by, "said", F.array_join(pieces, "").alias("rendered")), "parts")
    before = Window.partitionBy("conv", "assistant").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = parts.select(*by, F.length("rendered").cast("long").alias("size"))
    sizes = sizes.select(*by, F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"))
    placed = _meet(parts, sizes, by)
    # Running place of each segment: its end, from the sum so far.
    ends = F.aggregate(
        "said",
        F.struct(F.col("start").alias("at"), F.array().cast("array<struct<from:bigint,to:bigint>>").alias("spans")),
        lambda acc, x: F.struct(
            (acc["at"] + F.length(x["head"]) + F.length(x["body"]) + F.lit(len(END))).alias("at"),
            F.when(
                x["mine"],
                F.concat(
                    acc["spans"],
                    F.array(
                        F.struct(
                            (acc["at"] + F.length(x["head"])).alias("from"),
                            (acc["at"] + F.length(x["head"]) + F.length(x["body"])).alias("to"),
                        )
                    ),
                ),
            ).otherwise(acc["spans"]).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    return placed.select(
        "conv", "assistant", "part", "start", F.size("said").alias("n_turns"), "rendered", ends.alias("mask")
    )
