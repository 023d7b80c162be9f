"""CSV writer: a folder of files, each with the header."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabflow.functions import cells
from tabflow.runtime import col
from tabflow.types import logical_type


def csv_line(df: DataFrame, multiline: bool = False) -> Column:
    """One output line per row; with `multiline`, cells with line ends are quoted, and the row has more lines."""
    out = [cells.csv_escape(cells.render(col(f.name), logical_type(f)), multiline) for f in df.schema.fields]
    return F.concat_ws(",", *out)


def _first_of_task() -> Column:
    """True for the first row a task writes: the low 33 bits of the running number count rows within the task."""
    return F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0


def write_lines(lines: DataFrame, header: str, path: str) -> None:
    """Write a column of finished lines; the header and the byte order mark precede the first line of each file."""
    text = F.col("value")
    # The count is not used; observing it keeps Spark from working out the numbers of a local frame on the driver,
    # where all rows would count as one task's.
    watched = lines.toDF("value").observe("lines", F.count(F.lit(1)).alias("n"))
    value = F.when(_first_of_task(), F.concat(F.lit("\ufeff" + header + "\n"), text)).otherwise(text)
    watched.select(value.alias("value")).write.option("maxRecordsPerFile", 0).text(path)


def write_csv(df: DataFrame, path: str, multiline: bool = False) -> None:
    """Write rows as text, a line each, see `csv_line`. A table without rows gives no header."""
    names = F.concat_ws(",", *[cells.csv_escape(F.lit(c)) for c in df.columns])
    header = df.sparkSession.range(1).select(names).first()[0]
    write_lines(df.select(csv_line(df, multiline).alias("line")), header, path)
