"""Records that do not end where lines do: cut by a state that is carried from split to split.

The scan cuts a file into splits wherever the bytes fall, so a task does not know whether its split begins inside a quoted
text or a nested value. What a split does to such a state is found without knowing the state it begins with; these changes
are summed over the splits of a file, one row per split, and a second pass begins every split with the right state.

A record that goes on in the next split is left in parts: the tail of the split where it begins, and the heads of those
where it goes on. These few parts are put together again by the split of the tail.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabflow.runtime import ORD


def before(change: Column) -> Column:
    """Sum of a change over the splits of a file that come before."""
    w = Window.partitionBy("f").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(change).over(w), F.lit(0))


def with_states(pieces: DataFrame, states: DataFrame) -> DataFrame:
    """(value, ORD, states...) of pieces (value, ORD), in order within each split, with the state that the split begins with.

    states: (f, b, states...), one row per split.
    """
    names = [c for c in states.columns if c not in ("f", "b")]
    placed = pieces.select("value", ORD, F.col(ORD)["f"].alias("f"), F.col(ORD)["b"].alias("b"))
    joined = placed.join(states, ["f", "b"])
    # Whatever the join did to their order, a split's pieces are in one task.
    return joined.sortWithinPartitions("f", "b", F.col(ORD)["m"]).select("value", ORD, *names)


def joined_parts(parts: DataFrame, glue: str) -> DataFrame:
    """(f, b, m, value) of records put together from parts (f, b, m, value, opens), at the place of the part that opens."""
    opening = F.when(F.col("opens"), F.col("b"))
    # A split's head, which goes with a split before it, comes before its tail.
    w = Window.partitionBy("f").orderBy("b", "opens").rowsBetween(Window.unboundedPreceding, 0)
    of = parts.withColumn("of", F.last(opening, ignorenulls=True).over(w))
    texts = F.array_sort(F.collect_list(F.struct("b", F.col("opens").alias("o"), "value")))
    whole = of.groupBy("f", "of").agg(texts.alias("texts"), F.max(F.when(F.col("opens"), F.col("m"))).alias("m"))
    return whole.select("f", F.col("of").alias("b"), "m", F.array_join(F.transform("texts", lambda t: t["value"]), glue).alias("value"))
