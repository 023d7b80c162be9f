"""XML writer: a folder of well-formed documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tabflow.functions import cells
from tabflow.runtime import col
from tabflow.sinks.framed import write_framed, write_if_empty
from tabflow.types import logical_type

# Names of the root and row elements.
ROOT = "ExportedData"
ROW = "Item"

_OPENING = f'<?xml version="1.0" encoding="utf-8" standalone="yes"?>\n<{ROOT}>\n'


def xml_columns(df: DataFrame) -> DataFrame:
    """Rendered columns under their element names; of columns that share a name the last one stays."""
    by_name = {}
    for f in df.schema.fields:
        by_name[cells.xml_name(f.name)] = cells.render(col(f.name), logical_type(f))
    return df.select(*[F.coalesce(value, F.lit("")).alias(name) for name, value in by_name.items()])


def write_elements(elements: DataFrame, path: str) -> None:
    """Write a column of finished row elements as documents."""
    write_framed(elements, path, _OPENING, "", f"</{ROOT}>")


def write_xml(df: DataFrame, path: str) -> None:
    """Write rows as `Item` elements; NULL gives an empty element, a table without rows an empty root."""
    counted = Observation()
    (
        xml_columns(df)
        .observe(counted, F.count(F.lit(1)).alias("n"))
        .write.format("xml")
        .option("rootTag", ROOT)
        .option("rowTag", ROW)
        # Names with a leading underscore are elements here, not attributes.
        .option("attributePrefix", "@")
        .option("valueTag", "#text")
        .option("declaration", "version='1.0' encoding='utf-8' standalone='yes'")
        .option("maxRecordsPerFile", 0)
        .save(path)
    )
    write_if_empty(df.sparkSession, counted, path, f"{_OPENING}</{ROOT}>")
