"""Added tokens of the vocabulary file within texts, against the library as it is."""

import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tabflow.llm import wavelet
from tabflow.llm.queries import QUERIES

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["foo <|endoftext|> bar", "a<|endoftext|>b", "<|startoftext|><|endoftext|>", "<|ENDOFTEXT|> <|endoftext|", "don't<|endoftext|>'s it's",
         "e<|endoftext|>\u0301 \u4e2d<|startoftext|>\n", "plain words, no tokens!", ""]


def test_words_with_added_tokens_match_the_library():
    library = Tokenizer.from_file(PATH)
    with open(PATH) as f:
        got = wavelet.WordTokenizer(f.read())(TEXTS)
    assert [x.tolist() for x in got] == [library.encode(t, add_special_tokens=False).ids for t in TEXTS]


def test_shards_with_added_tokens(spark, tmp_path):
    library, start, expected = Tokenizer.from_file(PATH), 0, []
    for i, t in enumerate(TEXTS):
        ids = np.array([*library.encode(t, add_special_tokens=False).ids, 2], "<u4")
        expected.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(tuple(r) for r in QUERIES["op9_wavelet_shards"](spark, str(tmp_path)).collect()) == expected


def test_lettered_words_are_not_stored_whole():
    """Words of letters and marks are parted as columns; the others, and white space at both ends, match as well."""
    library = Tokenizer.from_file(PATH)
    letters = [chr(c) for c in range(0x41, 0x250) if chr(c).isalpha()] + list("\u212a\u1e9e\u0130\u01c5")
    words = [f"{a}{b}{mark}" for a in letters for b, mark in (("", ""), ("x", ","), (a, "?!"))]
    texts = [" ".join(words), "\x0b Word \t", " ", "\u00a0a\u2003b \x1cc\x85", "Ab\x00c d.e f's G,H ?! 12 x2"]
    with open(PATH) as f:
        encode = wavelet.WordTokenizer(f.read())
    for some in (texts, texts[1:3], [" "], []):
        assert [x.tolist() for x in encode(some)] == [library.encode(t, add_special_tokens=False).ids for t in some]
    assert "Word" not in encode.others.number and "word" in encode.pieces.number and "12" in encode.others.number
