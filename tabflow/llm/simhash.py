"""SimHash near-duplicates by anchor points of a covering code.

A fingerprint has one bit per position of XXH64 that is set in over half of the text's word shingles. Two texts are
linked if their fingerprints differ in at most `distance` bits.

Search. The 64 bits are cut into ceil((distance + 1) / 2) blocks, so that linked fingerprints differ in at most one bit
of some block. On a block the anchors are the words of a Hamming code: its covering radius is 1, so every block value
has a home anchor within one bit, and a value one bit away from it lies within radius + 1 = 2 bits of that anchor.
Each fingerprint goes to all anchors within two bits (1 or 1 + (n - 1) / 2 of them), the one nearest is its home, and at
every anchor the fingerprints at home are compared with all that are there. No linked pair is missed: the home anchor
of one is among the anchors of the other.

Copies are one fingerprint before anything is compared. An anchor gives out no pairs but the links of a spanning
forest of what it holds, and an anchor with many fingerprints is split into pairs of bounded blocks, all of which are
compared. Components come from rounds of minimum labels with pointer jumping over tables, each round written down, in
as few files as its rows fill.

Defined results: null and empty texts have fingerprint zero and are linked like any other; a null id counts as larger
than all others when the smallest is sought; repeated rows are copies of each other; an empty table has no fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tabflow.llm.common import content_key, drop_settled, packed, passing, settle
from tabflow.runtime import col

SEED = 42
#: Fingerprints of one anchor that are compared in one task; larger anchors are compared block by block.
BLOCK = 2048
#: Edges for which a round of labels has one task and one file.
ROWS = 250_000


def fingerprint(text: str | None, shingle: int) -> int:
    """64 bits as a signed long."""
    words = (text or "").encode().lower().split()  # bytes: A-Z only, and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    starts = [0]
    for w in words:
        starts.append(starts[-1] + len(w) + 1)
    spans = zip(starts, starts[shingle:], strict=False) if len(words) > shingle else [(0, len(joined) + 1)]
    hashes = np.array([xxhash.xxh64_intdigest(joined[a : b - 1], SEED) for a, b in spans], np.uint64)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(counts * 2 > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(text: Column, shingle: int = 3) -> Column:
    @F.pandas_udf(LongType())
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([fingerprint(t, shingle) for t in batch], dtype="int64")

    return of(text)


def block_plan(distance: int) -> tuple[int, int]:
    """Number of blocks and length of the Hamming code on each."""
    blocks = (distance + 2) // 2
    r = 1
    while 2 ** (r + 1) - 1 <= 64 // blocks:
        r += 1
    return blocks, 2**r - 1


def place(distinct: DataFrame, distance: int) -> DataFrame:
    """(fp, block, anchor, home): every anchor within two bits of each fingerprint, in each block.

    Position i of a block, from 1, has the bits of i as its column of the parity check. The syndrome of a value is the
    position to flip for the nearest code word; two flips i and i ^ syndrome lead to the others.
    """
    blocks, n = block_plan(distance)
    long = lambda x: F.lit(x).cast("long")
    values = [F.shiftrightunsigned("fp", b * (64 // blocks)).bitwiseAND(long((1 << n) - 1)) for b in range(blocks)]
    cut = distinct.select("fp", F.explode(F.array(*[F.struct(F.lit(b).alias("block"), v.alias("value")) for b, v in enumerate(values)])).alias("cut")).select("fp", "cut.*")
    syndrome = F.lit(0)
    for j in range(n.bit_length()):
        mask = sum(1 << (i - 1) for i in range(1, n + 1) if i >> j & 1)
        parity = F.bit_count(F.col("value").bitwiseAND(long(mask))).bitwiseAND(F.lit(1))
        syndrome = syndrome.bitwiseOR(F.shiftleft(parity, j))
    flip = lambda i: F.call_function("shiftleft", long(1), (i - 1).cast("int"))
    s, value = F.col("syndrome"), F.col("value")
    near = F.when(s == 0, value).otherwise(value.bitwiseXOR(flip(s)))
    pairs = F.filter(F.sequence(F.lit(1), F.lit(n)), lambda i: (s != 0) & (i < i.bitwiseXOR(s)) & (i != s))
    others = F.transform(
        pairs,
        lambda i: F.struct(value.bitwiseXOR(flip(i)).bitwiseXOR(flip(i.bitwiseXOR(s))).alias("anchor"), F.lit(False).alias("home")),
    )
    here = F.array(F.struct(near.alias("anchor"), F.lit(True).alias("home")))
    found = cut.withColumn("syndrome", syndrome).select("fp", "block", F.explode(F.concat(here, others)).alias("at"))
    return found.select("fp", "block", "at.*")


def _forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[int, int]]:
    """Links that join what was not joined before."""
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for left, right in pairs:
        for i, j in zip(left.tolist(), right.tolist(), strict=True):
            a, b = find(i), find(j)
            if a != b:
                root[max(a, b)] = min(a, b)
                yield i, j


def _links(distance: int):
    edge = ["src", "dst"]

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        fps = group["fp"].to_numpy(np.int64).view(np.uint64)
        home, side = group["home"].to_numpy(bool), group["side"].to_numpy(np.int8)
        first, rest = np.flatnonzero(home & (side != 2)), np.flatnonzero(side != 1)
        turned, other = np.flatnonzero(home & (side == 2)), np.flatnonzero(side == 1)

        def near() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for rows, against in ((first, rest), (turned, other)):
                for at in range(0, len(rows), 256):
                    some = rows[at : at + 256]
                    apart = np.bitwise_count(fps[some][:, None] ^ fps[against][None, :])
                    i, j = np.nonzero(apart <= distance)
                    i, j = some[i], against[j]
                    yield i[i != j], j[i != j]

        found = [(fps[i], fps[j]) for i, j in _forest(len(fps), near())]
        return pd.DataFrame(np.array(found, np.uint64).view(np.int64).reshape(-1, 2), columns=edge)

    return compare


def links(distinct: DataFrame, distance: int = 3) -> DataFrame:
    """(src, dst) fingerprints at most `distance` apart, enough of them to keep every component together.

    distinct: column `fp`, no value twice. An anchor's fingerprints are dealt into blocks of about `BLOCK` by a hash;
    each pair of blocks is one group (`side` 0: the block against itself, 1 and 2: against each other).
    """
    placed = settle(place(distinct, distance), "anchors")
    # An anchor alone, or without anyone at home, has nothing to compare.
    loads = placed.groupBy("block", "anchor").agg(F.count("*").alias("n"), F.max("home").alias("lived"))
    loads = settle(
        loads.filter("n > 1 AND lived").select(
            "block", "anchor", F.ceil(F.col("n") / F.lit(float(BLOCK))).cast("int").alias("parts")
        ),
        "loads",
    )
    busy = placed.join(loads, ["block", "anchor"])
    part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("parts") - 1),
        lambda p: F.struct(
            F.least(p, F.col("part")).alias("low"),
            F.greatest(p, F.col("part")).alias("high"),
            F.when(p == F.col("part"), 0).when(F.col("part") < p, 1).otherwise(2).cast("byte").alias("side"),
        ),
    )
    dealt = busy.withColumn("part", part).select("block", "anchor", "fp", "home", F.explode(pairs).alias("pair"))
    # Groups are few bytes and much work: they are dealt to as many tasks as there are, whatever their size in bytes.
    keys = ["block", "anchor", "low", "high"]
    tasks = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = StructType([StructField("src", LongType()), StructField("dst", LongType())])
    return (
        dealt.select("block", "anchor", "pair.*", "fp", "home")
        .repartition(tasks, *keys)
        .groupBy(*keys)
        .applyInPandas(_links(distance), schema)
        .distinct()
    )


def components(edges: DataFrame) -> DataFrame:
    """(node, was, root): every node of an edge with the smallest node of its component; `was` is the same.

    Each round a node takes the smallest label around it, then the label of its label; that halves long chains, and
    ends when a round changes nothing. One row per node and round goes to the scratch folder. There are no more labels
    than edges, so that the number of edges bounds the files of a round.
    """
    turned = F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))
    both = edges.select(F.explode(F.array(F.struct("src", "dst"), turned)).alias("edge")).select("edge.*").distinct()
    both = settle(both, "edges")
    files = both.count() // ROWS + 1
    state = both.groupBy("src").agg(F.least(F.col("src"), F.min("dst")).alias("root")).withColumnRenamed("src", "node")
    state = settle(state.coalesce(files), "linked")
    while True:
        around = both.join(state, both["dst"] == state["node"]).groupBy("src").agg(F.min("root").alias("near"))
        step = state.join(around, state["node"] == around["src"]).select("node", "root", F.least("root", "near").alias("near"))
        jump = state.select(F.col("node").alias("via"), F.col("root").alias("far"))
        step = step.join(jump, step["near"] == jump["via"]).select("node", F.col("root").alias("was"), F.least("near", "far").alias("root"))
        step = settle(step.coalesce(files), "linked")
        drop_settled(state)
        if not step.filter("was <> root").limit(1).count():
            drop_settled(both)
            return step
        state = step


def linked(marked: DataFrame, distance: int = 3) -> DataFrame:
    """(fp, root): fingerprints that have a link, with one fingerprint that stands for the component.

    marked: column `fp`, any number of rows per fingerprint.
    """
    spark = marked.sparkSession
    with passing(spark) as kept:
        found = components(links(marked.select("fp").distinct(), distance))
        kept.append(found)
    return found.select(F.col("node").alias("linked_fp"), "root")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 3, distance: int = 3) -> DataFrame:
    """One row per document: its id, `fingerprint` (16 hex digits) and `component_id`, the smallest id in reach."""
    marked = settle(docs.select(col(id_col).alias("id"), fingerprints(col(text), shingle).alias("fp")), "fingerprints")
    smallest = marked.groupBy("fp").agg(F.min("id").alias("least"))
    roots = smallest.join(linked(marked, distance), F.col("fp") == F.col("linked_fp"), "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    roots = settle(roots, "roots")
    named = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = settle(roots.join(named, "root").select(F.col("fp").alias("of"), "component_id"), "classes")
    return marked.join(classes, F.col("fp") == F.col("of")).select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 3, distance: int = 3) -> DataFrame:
    """One document of each component: that with the smallest id, null last; of rows with one id, one by content."""
    key = content_key(col(id_col), col(text))
    marked = settle(docs.select(col(id_col).alias("id"), fingerprints(col(text), shingle).alias("fp"), *key), "fingerprints")
    best = marked.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("n"), "id", "key_a", "key_b")).alias("best"))
    rooted = best.join(linked(marked, distance), F.col("fp") == F.col("linked_fp"), "left")
    chosen = rooted.groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("best").alias("best"))
    chosen = settle(chosen.select("best.key_a", "best.key_b"), "chosen")
    # Repeated rows of the chosen document are told apart by nothing: any one of them is the document.
    return packed(docs, *key).join(chosen, ["key_a", "key_b"], "left_semi").dropDuplicates(["key_a", "key_b"]).select("row.*")
