"""Session settings and the shared scratch folder."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

ORD = "__ord"
LATE = "__late"


def col(name: str) -> Column:
    """Column by its literal name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def ident(name: str) -> str:
    """Quoted SQL identifier."""
    return "`" + name.replace("`", "``") + "`"


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder path below a folder that the whole cluster shares.

    That is the session's checkpoint folder, or where none is set a hidden folder of its warehouse.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return f"{root.rstrip('/')}/tabflow/{label}-{uuid.uuid4().hex[:12]}"


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder that `scratch_dir` named."""
    if "/tabflow/" not in path:
        raise ValueError(f"not a scratch folder: {path}")
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def move_file(spark: SparkSession, source: str | None, target: str) -> None:
    """Move a file to a path where nothing is yet; without a source an empty file is made there."""
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    to = hadoop.Path(target)
    there = to.getFileSystem(conf)
    if there.exists(to):
        raise ValueError(f"there is something at {target}")
    if source is None:
        there.create(to, False).close()
        return
    at = hadoop.Path(source)
    if not hadoop.FileUtil.copy(at.getFileSystem(conf), at, there, to, True, conf):
        raise OSError(f"{target} could not be written")


def file_order() -> Column:
    """Place of a row in its input, to be taken directly on the scan.

    File path, then split offset, then the running number inside the task: unlike the running number alone, this
    follows file order however Spark packs splits into tasks.
    """
    return F.struct(
        F.col("_metadata.file_path").alias("f"),
        F.col("_metadata.file_block_start").alias("b"),
        F.monotonically_increasing_id().alias("m"),
    )


def first_and_largest_file(spark: SparkSession, path) -> tuple[str, str]:
    """The first file of a path by name, and the largest one, as paths to read; contents are not read.

    Empty files do not count: Spark leaves them in its output folders. Characters of a file's name that a reader would
    take for a pattern are escaped.
    """
    files = spark.read.format("binaryFile").load(path).filter("length > 0")
    first, largest = files.agg(F.min("path"), F.max_by("path", "length")).first()
    if first is None:
        raise ValueError(f"nothing to read in {path}")
    return literal_path(first), literal_path(largest)


def literal_path(path: str) -> str:
    """A path that a reader takes as it stands."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)
