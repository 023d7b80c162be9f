"""Language by compression: a text belongs to the language whose dictionary makes it smallest.

For each language a bounded sample of labelled texts is laid end to end as a raw-content Zstandard dictionary. A text
is normalised (lower case, runs of other characters than letters as one blank), cut into blocks, and all of its blocks
are compressed once per dictionary: a short block draws on the dictionary, where a long text would soon draw on itself.
The language with the smallest sum wins; `score` is the share of the bytes saved against the runner-up, scaled to
0..1, and a text is rejected if the margin is narrow.

Defined results: a text that is null or has no letter is `und` with score 0 and rejected; equal sums go to the first
language in order; null languages are not learned; without any labelled text every text is `und`; repeated rows are
scored alike.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from tabflow.runtime import col

NONE = "und"
#: Bytes of one language's dictionary, and of the blocks that are compressed with it.
DICTIONARY = 48 * 1024
PIECE = 2048
LEVEL = 6
#: Labelled texts per language that a dictionary is made of, and characters taken from each of them.
SAMPLE = 400
HEAD = 1000
#: A margin of this share of the compressed size counts as certain; below `NARROW` of it a text is rejected.
CERTAIN = 0.1
NARROW = 0.02

_OTHERS = re.compile(r"[\W\d_]+")


def normal(text: str | None) -> str:
    return _OTHERS.sub(" ", (text or "").lower()).strip()


def learn(labelled: DataFrame, lang: str = "lang", text: str = "text", key: str = "doc_id", sample: int = SAMPLE) -> dict[str, bytes]:
    """Dictionary bytes per language, from at most `sample` texts of each, chosen by a hash of the key and the head.

    Of the chosen heads, laid end to end, only the last `DICTIONARY` bytes are used: some 50 of them if they are long.
    Texts count by key, so exact copies under several keys can each be chosen.
    Only the chosen heads reach the driver: at most `sample` times `HEAD` characters per language.
    """
    head = F.substring(col(text), 1, HEAD)
    rows = labelled.filter(col(lang).isNotNull() & col(text).isNotNull()).select(
        col(lang).alias("l"), F.xxhash64(col(key).cast("string"), head).alias("h"), head.alias("head")
    )
    # Thin out by rate first, so that ranking sees a bounded number of rows per language however many there are.
    counts = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {}
    part = (F.pmod("h", F.lit(1_000_000)) + 1) / F.lit(1_000_000.0)
    rate = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, 4.0 * sample / n))])
    thin = rows.filter(part <= rate[F.col("l")]).distinct()
    best = thin.groupBy("l").agg(F.slice(F.sort_array(F.collect_list(F.struct("h", "head"))), 1, sample).alias("heads"))
    out = {}
    for r in best.orderBy("l").collect():
        joined = " ".join(normal(x["head"]) for x in r["heads"]).encode()
        out[r["l"]] = joined[-DICTIONARY:]
    return out


class Judge:
    """Compressors of all languages; one per task."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.by_language = {}
        for name, content in sorted(dictionaries.items()):
            held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(level=LEVEL)
            self.by_language[name] = zstandard.ZstdCompressor(
                dict_data=held, write_checksum=False, write_content_size=False, write_dict_id=False
            )

    def __call__(self, text: str | None) -> tuple[str, float, bool]:
        letters = normal(text)
        if not any(map(str.isalpha, letters)) or not self.by_language:  # other digits count as words, not as letters
            return NONE, 0.0, True
        data = letters.encode()
        pieces = [data[i : i + PIECE] for i in range(0, len(data), PIECE)]
        sizes = [(sum(len(c.compress(p)) for p in pieces), name) for name, c in self.by_language.items()]
        sizes.sort()
        if len(sizes) == 1:
            return sizes[0][1], 1.0, False
        margin = (sizes[1][0] - sizes[0][0]) / sizes[1][0]
        return sizes[0][1], min(1.0, margin / CERTAIN), margin < NARROW * CERTAIN


def predict(text: Column, dictionaries: dict[str, bytes]) -> Column:
    """struct<lang_pred, score, rejected>; the dictionaries travel with the task, a bounded size per language."""
    schema = StructType(
        [StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("rejected", BooleanType())]
    )

    @F.pandas_udf(schema)
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        judge = Judge(dictionaries)
        for batch in texts:
            yield pd.DataFrame([judge(t) for t in batch], columns=schema.names)

    return of(text)
