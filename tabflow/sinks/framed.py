"""Text files with an opening before the first line and a closing after the last."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def _framer(opening: str, separator: str, closing: str):
    def frame(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        started = False
        for batch in batches:
            if not batch.num_rows:
                continue
            lines = batch.column(0)
            lead = [separator if started else opening] + [separator] * (batch.num_rows - 1)
            started = True
            joined = pc.binary_join_element_wise(pa.array(lead, lines.type), lines, "")
            yield pa.RecordBatch.from_arrays([joined], ["value"])
        if started:
            yield pa.RecordBatch.from_arrays([pa.array([closing])], ["value"])

    return frame


def write_framed(lines: DataFrame, path: str, opening: str, separator: str, closing: str) -> None:
    """Write a column of finished lines, each task's as one whole document; without any line, one empty document.

    Only a task knows which of its rows is the last, hence the pass through Arrow batches; nothing is held back.
    """
    counted = Observation()
    framed = lines.toDF("value").mapInArrow(_framer(opening, separator, closing), "value string")
    framed = framed.observe(counted, F.count(F.lit(1)).alias("n"))
    framed.write.option("maxRecordsPerFile", 0).text(path)
    write_if_empty(lines.sparkSession, counted, path, opening + closing)


def write_if_empty(spark: SparkSession, counted: Observation, path: str, document: str) -> None:
    """Put one document without rows where a write, now done, has seen no row."""
    if not counted.get["n"]:
        one = spark.range(1).select(F.lit(document).alias("value"))
        one.coalesce(1).write.mode("overwrite").text(path)
