"""One query per corpus operator, over the whole of its table, with production parameters; SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabflow.llm import (
    bpe, chat, host_rules, language, licenses, line_dedup, mixing, quality, simhash, spelling, syncmers, wavelet, whitening,
)
from tabflow.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


def remainder(of: int) -> Column:
    """crc32 of the id as text, modulo `of`; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % of


def _host_rules_sql(host_limit: float = 0.5) -> str:
    rules = host_rules.RULES
    low, high = host_rules.STRENGTH
    counts = ", ".join(f"sum(CASE WHEN {c} THEN 1 ELSE 0 END) AS k_{r}" for r, c in rules.items())
    means = ", ".join(
        f"sum(k_{r}) / sum(n) AS m_{r}, sum(k_{r} * k_{r} / n) / sum(n) - power(sum(k_{r}) / sum(n), 2) "
        f"- (sum(k_{r}) / sum(n)) * (1 - sum(k_{r}) / sum(n)) * count(*) / sum(n) AS v_{r}"
        for r in rules
    )
    strengths = ", ".join(
        f"least(greatest(CASE WHEN v_{r} > 0 THEN m_{r} * (1 - m_{r}) / v_{r} - 1 ELSE {high} END, {low}), {high}) AS s_{r}"
        for r in rules
    )
    worst = ", ".join(f"(k_{r} + m_{r} * s_{r}) / (n + s_{r})" for r in rules)
    fails = " OR ".join(f"({c})" for c in rules.values())
    base = " OR ".join(f"({rules[r]})" for r in host_rules.BASE)
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
l AS (
  SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
win AS (
  SELECT rid, i, array_to_string(words[i:i + 7], ' ') AS win
  FROM (SELECT rid, words, unnest(range(1, len(words) - 6)) AS i FROM d WHERE len(words) >= 8)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS c FROM win) WHERE c > 1),
covered AS (
  SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY rid),
f AS (
  SELECT d.doc_id, d.source, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(l.n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(l.n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN l USING (rid) LEFT JOIN covered USING (rid)),
hosts AS (SELECT source, CAST(count(*) AS DOUBLE) AS n, {counts} FROM f GROUP BY source),
sums AS (SELECT {means} FROM hosts),
prior AS (SELECT *, {strengths} FROM sums),
verdict AS (SELECT source, greatest({worst}) > {host_limit} AS host_rejected FROM hosts, prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words,
       ({base}) AS base_failed, host_rejected, NOT ({fails}) AND NOT host_rejected AS kept
FROM f JOIN verdict ON f.source IS NOT DISTINCT FROM verdict.source"""


@query("op2_host_quality_rules", _host_rules_sql())
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = host_rules.measure(table(spark, sf_dir, "documents"), keep_columns=["doc_id"])
    return host_rules.judge(measured).select(
        "row.doc_id", *host_rules.FIGURES, "base_failed", "host_rejected", "kept"
    )


@query("op6_simhash_near_dedup")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_copies(table(spark, sf_dir, "documents"), shingle=3, distance=3)


@query("op8_quality_classifier")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    score = quality.scores(F.col("text"), quality.fit(docs, labels.filter(remainder(4) != 2)))
    scored = docs.select("doc_id", (remainder(4) == 2).alias("held_out"), score.alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


@query("op10_language_by_compression")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    dictionaries = language.learn(docs.filter(remainder(3) != 1).select("doc_id", "text", "lang"))
    found = language.predict(F.col("text"), dictionaries)
    return docs.select("doc_id", (remainder(3) == 1).alias("held_out"), found.alias("f")).select(
        "doc_id", "held_out", "f.*"
    )


@query("op5_byte_bpe")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    coded = bpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, carry=["doc_id"])
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2(bpe.decode(F.col("ids"), ranks), 256).alias("decoded_sha256"),
    )


@query("op9_wavelet_shards")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(public_tokenizers.path("word_bpe_49k.json")) as f:
        file = f.read()
    docs = wavelet.stored(table(spark, sf_dir, "documents"), file, end=2)
    return docs.select(
        "doc_id", "start", (F.length("tokens") / 4).cast("long").alias("n_tokens"), F.crc32("tokens").alias("ids_crc32")
    )


@query("op3_closed_syncmers")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = syncmers.compare(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"),
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        syncmers.digest(F.col("marks")).alias("fingerprint"),
        syncmers.digest(F.col("edited_marks")).alias("edited_fingerprint"),
        syncmers.likeness(F.col("marks"), F.col("edited_marks")).alias("near_edited"),
        syncmers.likeness(F.col("marks"), F.col("next_marks")).alias("near_next"),
    )


#: White space around a line, as in `line_dedup`.
_TRIM = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


@query(
    "op1_cross_site_line_dedup",
    f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, text FROM documents),
l AS (
  SELECT rid, doc_id, source, pos, line, trim(line, {_TRIM}) AS word_line
  FROM (SELECT rid, doc_id, source, unnest(string_split(text, chr(10))) AS line,
               unnest(range(len(string_split(text, chr(10))))) AS pos FROM d WHERE text IS NOT NULL)),
common AS (
  SELECT word_line, min(struct_pack(n := doc_id IS NULL, id := doc_id, pos := pos)) AS first FROM l
  WHERE word_line <> '' GROUP BY word_line HAVING count(DISTINCT source) >= {line_dedup.MIN_SITES}),
marked AS (
  SELECT l.*, common.word_line IS NOT NULL AND NOT (
    first.id IS NOT DISTINCT FROM doc_id AND first.pos = l.pos) AS gone
  FROM l LEFT JOIN common USING (word_line)),
clean AS (
  SELECT rid, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
         coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text
  FROM marked GROUP BY rid)
SELECT d.doc_id, clean.text, CAST(coalesce(n_lines, 0) AS INTEGER) AS n_lines,
       CAST(coalesce(n_removed, 0) AS INTEGER) AS n_removed
FROM d LEFT JOIN clean USING (rid)""",
)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return found.select("row.doc_id", F.col("clean").alias("text"), "n_lines", "n_removed")


def _chat_sql() -> str:
    n = chat.PART
    return f"""
WITH t AS (
  SELECT DISTINCT conv_id AS conv, turn, regexp_replace(replace(coalesce(role, '{chat.UNKNOWN}'), '<|', '< |'), '[\\r\\n]+', ' ', 'g') AS speaker,
         replace(coalesce(text, ''), '<|', '< |') AS body FROM conversations),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST) - 1 AS place FROM t),
people AS (SELECT DISTINCT conv, speaker AS assistant FROM t WHERE speaker <> '{chat.SYSTEM}'),
wide AS (
  SELECT n.*, p.assistant, place // {n} AS part,
         CASE WHEN speaker = '{chat.SYSTEM}' THEN '{chat.START}system' || chr(10)
              WHEN speaker = assistant THEN '{chat.START}assistant' || chr(10)
              ELSE '{chat.START}user name=' || speaker || chr(10) END AS head
  FROM numbered n JOIN people p ON n.conv IS NOT DISTINCT FROM p.conv),
sized AS (
  SELECT *, head || body || '<|im_end|>' || chr(10) AS segment,
         coalesce(sum(length(head) + length(body) + {len(chat.END)}) OVER (
           PARTITION BY conv, assistant ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM wide)
SELECT conv AS conv_id, assistant, part, CAST(min(start) AS BIGINT) AS start, CAST(count(*) AS INTEGER) AS n_turns,
       string_agg(segment, '' ORDER BY place) AS rendered,
       coalesce(string_agg((start + length(head)) || '-' || (start + length(head) + length(body)), ',' ORDER BY place)
                FILTER (speaker = assistant), '') AS mask
FROM sized GROUP BY conv, assistant, part"""


@query("op4_perspective_rotation", _chat_sql())
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chat.rotate(table(spark, sf_dir, "conversations"))
    spans = F.transform("mask", lambda m: F.concat_ws("-", m["from"].cast("string"), m["to"].cast("string")))
    return found.withColumnRenamed("conv", "conv_id").withColumn("mask", F.array_join(spans, ","))


@query("op7_mixing_to_targets")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix(table(spark, sf_dir, "documents"))
    return found.select("row.doc_id", *mixing.DIMENSIONS, F.round("p", 6).alias("p"), "kept")


@query("op11_embedding_whitening")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened_components(table(spark, sf_dir, "embeddings"))


@query("op12_license_scan")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base, best_ones = F.transform("places", lambda p: p["label"]), F.filter("matches", lambda m: m["best"])
    methods = F.transform(best_ones, lambda m: m["label"])
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    best = F.coalesce(F.array_max(F.transform("matches", lambda m: m["share"])), F.lit(0.0))
    return found.select(
        "row.doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(F.transform("places", lambda p: p["at"])).alias("first_word"),
        F.array_max(F.transform("places", lambda p: p["at"])).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.concat(base, methods)).alias("labels"),
        # A phrase is there as a whole, which is full containment.
        F.when(F.size("places") > 0, 1.0).otherwise(best).alias("score"),
    )


@query("op13_spelling_variants")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents").select("doc_id", "text"))
