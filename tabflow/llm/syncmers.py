"""Document fingerprints of closed syncmers: anchors that depend on nothing but the words they cover.

A window of `K` words is an anchor if the smallest of its inner runs of `S` words, by hash, is the first or the last of
them. Whether a window is an anchor follows from its own words, so an edit moves no anchor but those that touch it, and
equal passages have equal anchors at positions that differ by one shift. Every stretch of K - S + 1 windows has one.

All steps are array functions over one row: shifted copies of the hash array are combined pairwise, so nothing is
looked up by index and the work is linear in the text.

Defined results: a null text is empty; an empty text has no anchors; a text of fewer than `K` words has one
per word; two texts without anchors are alike (1.0), one without and one with are not (0.0); repeated rows and ties of
the id are ordered by text and follow each other.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabflow.runtime import col

#: Words of a window and of its inner runs; K - S + 1 inner runs must be a power of two.
K, S = 5, 2
#: Rows of one range of ids, and the most ranges.
RANGE_ROWS, RANGES = 20_000, 1 << 14


def _shift(array: str, by: int) -> Column:
    return F.slice(F.col(array), by + 1, F.greatest(F.size(array) - by, F.lit(0)))


def _pairwise(array: str, by: int, f) -> Column:
    """f of each element and the one `by` places on."""
    return F.zip_with(F.slice(F.col(array), 1, F.greatest(F.size(array) - by, F.lit(0))), _shift(array, by), f)


def anchors(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add array<struct<at, hash>>: the first word's number, from 0, and the hash of each anchor, in order.

    Each array is a column of its own, used more than once by the next, so Spark computes it once per row.
    """
    h, s, low, least, found = (f"__{out}_{x}" for x in ("h", "s", "low", "least", "found"))
    kept = [col(c) for c in df.columns]
    step = df.select(*kept, F.filter(F.split(F.coalesce(col(text), F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "").alias(h))
    step = step.select(*kept, F.transform(h, lambda w: F.xxhash64(w)).alias(h))
    step = step.select("*", _pairwise(h, 1, lambda a, b: F.xxhash64(a, b)).alias(s))
    # Smallest of four inner runs: of two, then of two of those.
    step = step.select("*", _pairwise(s, 1, lambda a, b: F.least(a, b)).alias(low))
    step = step.select("*", _pairwise(low, 2, lambda a, b: F.least(a, b)).alias(least))
    windows = F.arrays_zip(
        F.slice(s, 1, F.size(least)).alias("a"),
        _shift(s, K - S).alias("b"),
        F.slice(h, S + 1, F.size(least)).alias("m"),
        F.col(least).alias("l"),
        F.when(F.size(least) > 0, F.sequence(F.lit(0), F.size(least) - 1)).alias("i"),
    )
    edge = F.filter(windows, lambda w: (w["a"] == w["l"]) | (w["b"] == w["l"]))
    step = step.select("*", F.transform(edge, lambda w: F.struct(w["i"].alias("at"), F.xxhash64(w["a"], w["m"], w["b"]).alias("hash"))).alias(found))
    words = F.transform(h, lambda x, i: F.struct(i.alias("at"), x.alias("hash")))
    return step.select(*kept, F.when(F.size(h) >= K, F.col(found)).otherwise(words).alias(out))


def digest(anchor_hashes: Column) -> Column:
    """Fingerprint text: eight hex digits per anchor, in order."""
    return F.array_join(F.transform(anchor_hashes, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Shared share of two arrays' distinct anchors."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / both)


def short(anchors_of: Column) -> Column:
    """32 bits of each anchor's hash, as non-negative longs."""
    return F.transform(anchors_of, lambda x: x["hash"].bitwiseAND(F.lit(0xFFFFFFFF).cast("long")))


def dealt_in_order(rows: DataFrame) -> tuple[DataFrame, Window]:
    """Rows (id, text) dealt to ranges of the id, and the window over a range in which `lead` finds the next row.

    The order is by descending integer id, then by text, null ids last; after the last row comes the first. Ranges come
    from the ids' quantiles. The row that opens a range is also sent, marked as a guest, to the range before it, so
    that no window is wider than a range and every row is shuffled once. Only bounds and opening ids pass through the
    driver: two numbers per range.
    """
    spark = rows.sparkSession
    rows = rows.withColumn("key", F.coalesce(F.col("id").cast("long"), F.lit(-(2**63)))).withColumn("guest", F.lit(False))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    wanted = min(RANGES, max(8 * parts, rows.count() // RANGE_ROWS))
    bounds = rows.agg(F.percentile_approx("key", [i / wanted for i in range(1, wanted)], 100 * wanted).alias("b")).first()["b"]
    rows = rows.withColumn("range", _range_of(F.col("key"), sorted(set(bounds or []))))
    opening = {r["range"]: r["top"] for r in rows.groupBy("range").agg(F.max("key").alias("top")).collect()}
    ranges = sorted(opening, reverse=True)
    before = {opening[r]: ranges[i - 1] for i, r in enumerate(ranges)}  # the first row follows the last range
    guests = rows.filter(F.col("key").isin(list(before))).groupBy("key").agg(F.min("text").alias("text"))
    to = F.element_at(F.from_json(F.lit(json.dumps(before)), "map<string,int>"), F.col("key").cast("string"))
    guests = guests.select(F.lit(None).cast("long").alias("id"), "text", "key", F.lit(True).alias("guest"), to.alias("range"))
    both = rows.select(F.col("id").cast("long").alias("id"), "text", "key", "guest", "range").unionByName(guests)
    spread = both.repartition(max(parts, wanted // 8), "range")
    return spread, Window.partitionBy("range").orderBy("guest", F.col("key").desc(), "text")


def _range_of(key: Column, bounds: list[int]) -> Column:
    """Number of bounds up to the key: first among every w-th bound, then among the w from there."""
    if not bounds:
        return F.lit(0)
    w = max(1, int(len(bounds) ** 0.5))
    numbers = lambda x: F.from_json(F.lit(json.dumps(x)), "array<long>")
    groups = F.size(F.filter(numbers(bounds[::w]), lambda b: b <= key))
    skipped = F.greatest(groups - 1, F.lit(0)) * w
    return skipped + F.size(F.filter(F.slice(numbers(bounds), skipped + 1, F.lit(w)), lambda b: b <= key))


def compare(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document beside its edited text: the last third replaced by the start of the next document.

    (id, text, edited, marks, edited_marks, next_marks): marks are the hashes of a text's anchors, 32 bits each.
    """
    rows = docs.select(col(id_col).alias("id"), F.coalesce(col(text), F.lit("")).alias("text"))
    spread, order = dealt_in_order(rows)
    marked = anchors(spread, "text", "anchors").withColumn("marks", short(F.col("anchors"))).drop("anchors")
    beside = marked.select("*", F.lead("text").over(order).alias("next_text"), F.lead("marks").over(order).alias("next_marks"))
    beside = beside.filter(~F.col("guest"))
    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("next_text"), F.lit(1), cut))
    beside = beside.select("id", "text", "marks", "next_marks", edited.alias("edited"))
    return anchors(beside, "edited", "anchors").withColumn("edited_marks", short(F.col("anchors"))).drop("anchors")
