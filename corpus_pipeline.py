"""The corpus pipeline: quality rules, line dedup, near-dedup, mixing, and encoding, one stage after the other.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. `run` writes every stage as
Parquet below the shared scratch folder and reads it again, so that a lost executor costs no more than a stage.

All stages but the last return the columns they were given. The last returns `doc_id`, `n_tokens`, `ids` (one array of
token ids per document) and `decoded_sha256`, the digest of the bytes that the ids decode to.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabflow.llm import bpe, host_rules, line_dedup, mixing, simhash
from tabflow.llm.common import drop_settled, passing, settle, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a rule, or whose host fails too often, go."""
    return host_rules.keep(docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found on many sites stay only where they come first; `n_chars` follows the text."""
    kept = line_dedup.keep_lines(docs)
    if "n_chars" not in docs.columns:
        return kept
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return simhash.keep_one(docs, shingle=3, distance=3)


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose expected tokens meet the source, language and topic targets, as far as there are tokens for them."""
    return mixing.sample(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, and the digest of what they decode to."""
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    coded = bpe.encode(docs, ranks, public_tokenizers.PATTERN, carry=["doc_id"])
    digest = F.sha2(bpe.decode(F.col("ids"), ranks), 256)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", digest.alias("decoded_sha256"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", near_dedup),
    ("mixing", mix_to_targets),
    ("byte_bpe", encode),
]

#: SQL has neither the fingerprints nor the merges; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with passing(spark) as kept:
            after = settle(stage(spark, docs, sf_dir), f"pipeline_{name}")
            kept.append(after)
        drop_settled(docs)  # the stage after it is written down
        docs = after
    return docs


QUERIES = {"pipeline": run}
ORACLES = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
