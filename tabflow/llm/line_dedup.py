"""Cross-site line dedup: lines found on many distinct sites are boilerplate and stay only where they come first.

Lines are compared without outer white space, as 128-bit hashes. Each distinct line gets a HyperLogLog sketch of the
sites it is on; sketches are built per task and merged by aggregation, so a line that is everywhere costs one sketch
per task. Lines whose estimate is within the sketch's error of the threshold are counted exactly; all others are
decided by the estimate. Boilerplate is then removed, but for its first occurrence (smallest document id, then line),
so that no content is lost with a page that was copied to many sites.

Defined results: a null text stays null and has no lines; lines without a word are layout and stay; a null site does
not count towards the spread, but its lines are removed like others; null ids come last when the first occurrence is
sought; rows that agree in id, site and text share one decision; an empty table gives an empty one; extra columns are
carried along untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabflow.llm.common import content_key, drop_settled, packed, settle
from tabflow.runtime import col

#: Distinct sites from which on a line is boilerplate.
MIN_SITES = 10
#: Size of a sketch (2 ** LG buckets), and the relative error within which its estimate does not decide: six times the
#: standard error of 1.04 / sqrt(2 ** LG).
LG = 10
ERROR = 6 * 1.04 / 2 ** (LG / 2)

_BLANK = " \t\n\x0b\x0c\r"


def trimmed(line: Column) -> Column:
    return F.trim(line, F.lit(_BLANK))


def _lines(docs: DataFrame, id_col: str, site: str, text: str) -> DataFrame:
    """One row per line that has a word: the document's key, id and site, the line's number and two hashes."""
    rows = docs.select(
        *content_key(col(id_col), col(site), col(text)),
        col(id_col).alias("id"),
        col(site).cast("string").alias("site"),
        F.posexplode(F.split(col(text), "\n")).alias("at", "line"),
    )
    rows = rows.withColumn("line", trimmed(F.col("line"))).filter("line <> ''")
    return rows.select("key_a", "key_b", "id", "site", "at", F.xxhash64(F.lit(3), "line").alias("a"), F.xxhash64(F.lit(5), "line").alias("b"))


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """(a, b, first): lines on at least `min_sites` distinct sites, with the place of their first occurrence."""
    place = F.struct(F.col("id").isNull().alias("n"), "id", "key_a", "key_b", "at")
    spread = lines.groupBy("a", "b").agg(F.hll_sketch_agg("site", F.lit(LG)).alias("sketch"), F.min(place).alias("first"))
    spread = spread.select("a", "b", "first", F.hll_sketch_estimate("sketch").alias("sites"))
    likely = settle(spread.filter(F.col("sites") >= min_sites * (1 - ERROR)), "spread")
    sure = likely.filter(F.col("sites") > min_sites * (1 + ERROR)).select("a", "b", "first")
    near = likely.filter(F.col("sites") <= min_sites * (1 + ERROR))
    pairs = lines.select("a", "b", "site").join(near.select("a", "b"), ["a", "b"], "left_semi").distinct()
    exact = pairs.groupBy("a", "b").agg(F.count("site").alias("exact")).filter(F.col("exact") >= min_sites)
    found = settle(sure.unionByName(near.join(exact, ["a", "b"]).select("a", "b", "first")), "boilerplate")
    drop_settled(likely)
    return found


def dedup(docs: DataFrame, id_col: str = "doc_id", site: str = "source", text: str = "text", min_sites: int = MIN_SITES) -> DataFrame:
    """(row, clean, n_lines, n_removed): every document as a struct, and its text without the removed lines.

    Only line hashes are shuffled to find what to remove; texts are shuffled once, to meet the numbers of their lines.
    """
    lines = _lines(docs, id_col, site, text)
    common = boilerplate(lines, min_sites)
    hits = lines.join(common, ["a", "b"])
    first = (F.col("first.key_a") == F.col("key_a")) & (F.col("first.key_b") == F.col("key_b")) & (F.col("first.at") == F.col("at"))
    gone = hits.filter(~first).groupBy("key_a", "key_b").agg(F.collect_set("at").alias("gone"))
    rows = packed(docs, *content_key(col(id_col), col(site), col(text)), col(text).alias("t"))
    both = rows.join(gone, ["key_a", "key_b"], "left")
    # Lines to remove are marked by number: an array of flags is filled from the set once, not searched line by line.
    parts = F.split("t", "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("gone"))
    clean = F.when(F.col("gone").isNull(), F.col("t")).otherwise(
        F.array_join(F.transform(kept, lambda i: F.element_at(F.col("parts"), i + 1)), "\n")
    )
    both = both.withColumn("parts", parts)
    return both.select(
        "row",
        clean.alias("clean"),
        F.when(F.col("t").isNull(), 0).otherwise(F.size("parts")).alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).alias("n_removed"),
    )


def keep_lines(docs: DataFrame, id_col: str = "doc_id", site: str = "source", text: str = "text", min_sites: int = MIN_SITES) -> DataFrame:
    """The documents with cleaned texts, in their own columns."""
    found = dedup(docs, id_col, site, text, min_sites)
    return found.select(*[F.col("clean").alias(c) if c == text else F.col("row").getField(c).alias(c) for c in docs.columns])
