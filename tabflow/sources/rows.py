"""Rows held as name-to-text maps, for formats where each row lists its own columns.

Such files are cut by the scan into pieces, each piece is parsed once, in whole batches by a real parser inside the
task, and the rows are written to the shared scratch folder. What the pieces say about themselves decides afterwards, file
by file, whether the cuts fell between rows; the rows of files where they did not are left aside, and these files are read
in another way.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable, Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabflow.operators.transform import ROW as WHOLE
from tabflow.operators.transform import Raw
from tabflow.runtime import LATE, ORD, discard, literal_path, scratch_dir
from tabflow.sources.cuts import joined_parts

ROW = "map<string,string>"
_STAGED = (
    "f string, b bigint, m bigint, p bigint, names array<string>, texts array<string>, "
    "opens boolean, closes boolean, error string, root string, part string"
)
_ARROW = pa.schema(
    [("f", pa.string()), ("b", pa.int64()), ("m", pa.int64()), ("p", pa.int64())]
    + [(c, pa.list_(pa.string())) for c in ("names", "texts")]
    + [(c, pa.bool_()) for c in ("opens", "closes")]
    + [("error", pa.string()), ("root", pa.string()), ("part", pa.string())]
)
_BATCH = 5000

#: What a parser gives for one piece or document: (place, rows, opens, closes, error, root). A piece that opens or closes
#: its file names the root, if there is more than one that it could be; both must name the same.
Parsed = tuple[tuple, Iterable[dict[str, str]], bool, bool, str | None, str | None]


def _batches(found: Iterable[Parsed]) -> Iterator[pa.RecordBatch]:
    """A line per row, and one without names per piece."""

    def lines() -> Iterator[tuple]:
        for place, rows, opens, closes, error, root in found:
            yield (*place, -1, None, None, opens, closes, error, root, None)
            for p, row in enumerate(rows):
                yield (*place, p, list(row), list(row.values()), None, None, None, None, None)

    yield from staged(lines())


def staged(lines: Iterable[tuple]) -> Iterator[pa.RecordBatch]:
    for some in itertools.batched(lines, _BATCH):
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(zip(*some), _ARROW, strict=True)], schema=_ARROW
        )


def part_of(place: tuple, opens: bool, text: str) -> tuple:
    """A staged line that is a part of a row; the first one opens it."""
    return (*place, -1, None, None, opens, None, None, None, text)


def in_tasks(parse: Callable[[pa.RecordBatch], Iterable[Parsed]]):
    """A function over Arrow batches from one that parses a batch of pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _batches(parse(batch))

    return run


#: Pieces that are looked at in a file's first reading; each further one takes `_FURTHER` times as many.
_FIRST, _FURTHER = 1000, 8


def reading_on(pieces: DataFrame, find: Callable[[Iterator], tuple[bool, str | None]]) -> str | None:
    """What `find` makes of the first pieces of a file, given in order; one task reads on as far as that takes.

    find: gives whether it needs no more pieces, and what it has found. A function that stops does not stop the scan, which
    is therefore told how many pieces to read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0

        def values() -> Iterator:
            nonlocal seen
            for value in (v for b in batches for v in b.column(0).to_pylist()):
                seen += 1
                yield value

        done, text = find(values())
        yield pa.RecordBatch.from_arrays([pa.array([done]), pa.array([seen]), pa.array([text], pa.string())], ["done", "seen", "text"])

    n = _FIRST
    while True:
        found = pieces.coalesce(1).limit(n).mapInArrow(run, "done boolean, seen bigint, text string").collect()[0]
        if found["done"] or found["seen"] < n:
            return found["text"]
        n *= _FURTHER


def places(batch: pa.RecordBatch) -> list[tuple]:
    order = batch.column(batch.schema.get_field_index(ORD)).to_pylist()
    return [(o["f"], o["b"], o["m"]) for o in order]


class Stage:
    """Parsed rows in the scratch folder."""

    def __init__(self, pieces: DataFrame, parse: Callable[[pa.RecordBatch], Iterable[Parsed]] | None, label: str, run=None):
        """parse: a function over a batch of pieces; or `run`, one over all batches of a task that gives staged lines."""
        self.spark: SparkSession = pieces.sparkSession
        path = scratch_dir(self.spark, label)
        self.paths = [path]
        pieces.mapInArrow(run or in_tasks(parse), _STAGED).write.parquet(path)
        self.lines = self.spark.read.schema(_STAGED).parquet(path)

    def broken(self) -> DataFrame:
        """(f, root): files of which a piece could not be parsed, or that are not opened by their first piece and closed
        by their last under one root; with what a piece says of the root or in front of it."""
        return broken_files(self.lines.filter("names IS NULL AND part IS NULL"))

    def completed(self, parse: Callable[[pa.RecordBatch], Iterable[Parsed]], label: str) -> Stage:
        """With the rows that were left in parts."""
        whole = joined_parts(self.lines.filter("part IS NOT NULL").selectExpr("f", "b", "m", "part AS value", "opens"), "")
        rest = Stage(whole.select("value", F.struct("f", "b", "m").alias(ORD)), parse, label)
        self.lines, self.paths = self.lines.unionByName(rest.lines), self.paths + rest.paths
        return self

    def leaving(self, files: list[str]) -> Stage:
        """With the word that these files, none of which were read, are to be read in another way."""
        if files:
            left = [(f, 0, 0, -1, None, None, False, False, "not read", None, None) for f in files]
            self.lines = self.lines.unionByName(self.spark.createDataFrame(left, _STAGED))
        return self

    def without(self, files: DataFrame, rest: Stage) -> Stage:
        """The rows but those of some files, which another stage has."""
        self.lines = self.lines.join(files.select("f"), "f", "left_anti").select(*self.lines.columns).unionByName(rest.lines)
        self.paths = self.paths + rest.paths
        return self

    def discard(self) -> None:
        for path in self.paths:
            discard(self.spark, path)

    def raw(self, extra: list[str] | None) -> Raw:
        """Text columns of the first row's names, plus `extra` names that later rows may carry."""
        order = F.struct("f", "b", "m", "p").alias(ORD)
        listed = self.lines.filter("names IS NOT NULL").select(order, "names", "texts")
        first = listed.agg(F.min_by("names", ORD)).first()[0]
        rows = listed.select(F.map_from_arrays("names", "texts").alias("row"), ORD)
        raw = raw_of_maps(rows, list(first or []), extra if first is not None else None)
        raw.staging = tuple(self.paths)
        return raw


#: A way to read files, all or those given, to a stage; None if it does not apply.
Way = Callable[[list[str] | None, dict[str, str]], Stage | None]


def read_staged(spark: SparkSession, ways: list[Way]) -> Stage:
    """The rows of all files, each read by the first way that finds it whole; the last way takes what it is given.

    A later way is given the files that are left, and what the way before it found in front of their rows.
    """
    stage: Stage | None = None
    left: list[str] | None = None
    known: dict[str, str] = {}
    broken = None
    try:
        for i, way in enumerate(ways):
            found = way(left, known)
            if found is None:
                continue
            stage = found if stage is None else stage.without(broken, found)
            if i == len(ways) - 1:
                break
            # As many rows as there are such files, whose names the driver lists anyway.
            rows = found.broken().collect()
            if not rows:
                break
            broken = spark.createDataFrame([(r["f"],) for r in rows], "f string")
            left, known = [file_of(r["f"]) for r in rows], {r["f"]: r["root"] for r in rows if r["root"]}
    except BaseException:
        if stage is not None:
            stage.discard()
        raise
    return stage


def broken_files(pieces: DataFrame) -> DataFrame:
    """Files of pieces (f, b, m, opens, closes, error, root) that are not whole, see `Stage.broken`.

    Counted per split on fixed-width values, which a hash aggregate takes in one pass; one row per split is left to be
    put in file order.
    """
    m = F.col("m")
    per_split = pieces.groupBy("f", "b").agg(
        F.every(F.isnull("error")).alias("sound"),
        F.count_if("opens").alias("n_opens"),
        F.count_if("closes").alias("n_closes"),
        (F.min(m) == F.min(F.when(F.col("opens"), m))).alias("opens_first"),
        (F.max(m) == F.max(F.when(F.col("closes"), m))).alias("closes_last"),
    )
    per_file = per_split.groupBy("f").agg(
        F.every("sound").alias("sound"),
        F.sum("n_opens").alias("n_opens"),
        F.sum("n_closes").alias("n_closes"),
        F.min_by("opens_first", "b").alias("opens_first"),
        F.max_by("closes_last", "b").alias("closes_last"),
    )
    # Few pieces name a root, so that these texts are few.
    roots = pieces.filter("root IS NOT NULL").groupBy("f").agg(
        F.max(F.when(F.col("opens"), F.col("root"))).alias("root"),
        F.count_distinct(F.substring_index("root", " ", 1)).alias("n_roots"),
    )
    whole = (
        F.col("sound") & (F.col("n_opens") == 1) & (F.col("n_closes") == 1)
        & F.coalesce("opens_first", F.lit(False)) & F.coalesce("closes_last", F.lit(False))
        & (F.coalesce("n_roots", F.lit(0)) <= 1)
    )
    return per_file.join(roots, "f", "left").filter(~whole).select("f", "root")


def file_of(place: str) -> str:
    """A path to read from a file's place as the scan names it."""
    return literal_path(unquote(place))


def raw_of_maps(rows: DataFrame, names: list[str], extra: list[str] | None) -> Raw:
    """Text columns of the first row's names, plus `extra` names that later rows may carry."""
    known = {n.lower() for n in names}
    names = names + [n for n in extra or [] if n.lower() not in known]
    cells = [
        F.when(
            F.map_contains_key("row", F.lit(n)), F.coalesce(F.try_element_at("row", F.lit(n)), F.lit(""))
        ).alias(n)
        for n in names
    ]
    late = F.array_except(F.map_keys("row"), F.array(*[F.lit(n) for n in names]).cast("array<string>"))
    return Raw(rows.select(*cells, late.alias(LATE), F.col("row").alias(WHOLE), ORD), names, partial=True)
