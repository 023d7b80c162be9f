import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

SHARED = "Accept all cookies to continue reading this page"
LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(30_000))


def odd_documents() -> list[tuple]:
    """Nulls in every column, empty and long texts, repeated rows, one line on many sites, a hot host."""
    prose = "The quick brown fox of the house went to the river and the mill to see what was there today\nand came back"
    rows = [
        (0, prose, "en", "a"), (0, prose, "en", "a"), (1, None, "en", "a"), (2, "", None, None), (3, " \n\t\x0b", "de", "b"),
        (None, prose + " again", "en", "a"), (None, None, None, None), (4, LONG, "fr", "c"), (5, "one two three", "en", "a"),
        (6, "a b c d e f g h " * 30, "en", "a"), (7, "### $$$ %%% x | y | z | 12 34 " * 9, "es", "d"),
        (8, "   é́ ÉTÉ été 中文 😀 <|endoftext|> it's  two   spaces \n \n x", "fr", "e"), (9, "ENDE!! " * 25, "de", "d"),
        (10, "zwei\n\nzwei\nzwei\n\ndrei vier", "de", None), (-5, prose.replace("fox", "cat"), "en", "f"), (2**40, prose, "en", "g"),
    ]
    rows += [(20 + i, f"{SHARED}\npage {i} has words of its own {i * 17}\n {SHARED} ", "en", f"site{i}") for i in range(14)]
    rows += [(50 + i, f"Filler number {i} is here with number {i * i} and with more to say about {i % 7}\nEnd", "en", "hot") for i in range(30)]
    return rows


#: Names that the operators use themselves.
CLASHES = ["row", "id", "key_a", "fp", "kept", "host", "at", "t", "p", "value", "text_", "n_words", "topic", "clean", "guest"]


def write_documents(folder, rows: list[tuple]) -> str:
    cols = list(zip(*rows, strict=True)) or [()] * 4
    data = {
        "doc_id": pa.array(cols[0], pa.int64()), "text": pa.array(cols[1], pa.string()), "lang": pa.array(cols[2], pa.string()),
        "source": pa.array(cols[3], pa.string()), "n_chars": pa.array([len(t or "") for t in cols[1]], pa.int64()),
    }
    data |= {c: pa.array([f"{c}{i}" for i in range(len(rows))], pa.string()) for c in CLASHES}
    pq.write_table(pa.table(data), f"{folder}/documents.parquet")
    labels = {"doc_id": pa.array(cols[0], pa.int64()), "quality": pa.array([i % 2 if i % 5 else None for i in range(len(rows))], pa.int64())}
    pq.write_table(pa.table(labels), f"{folder}/labels.parquet")
    return str(folder)


def write_conversations(folder, rows: list[tuple]) -> None:
    cols = list(zip(*rows, strict=True)) or [()] * 4
    kinds = (("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()))
    data = {n: pa.array(c, k) for (n, k), c in zip(kinds, cols, strict=True)}
    data |= {c: pa.array(range(len(rows)), pa.int64()) for c in ("conv", "assistant", "part", "at", "speaker")}
    pq.write_table(pa.table(data), f"{folder}/conversations.parquet")


def write_embeddings(folder, rows: list[tuple]) -> None:
    cols = list(zip(*rows, strict=True)) or [()] * 2
    data = {"vec_id": pa.array(cols[0], pa.int64()), "embedding": pa.array(cols[1], pa.list_(pa.float32()))}
    pq.write_table(pa.table(data), f"{folder}/embeddings.parquet")


@pytest.fixture(scope="session")
def odd(tmp_path_factory):
    folder = tmp_path_factory.mktemp("odd")
    write_documents(folder, odd_documents())
    talk = [
        (1, 0, "system", "be brief"), (1, 1, "ann", "hello <|im_end|>"), (1, 2, "bob", None), (1, 2, "bob", None), (1, 3, "ann", ""),
        (2, 0, "system", "alone"), (None, 5, "user", "no dialogue"), (None, 6, "assistant", "none"), (3, None, None, "first"),
        (3, 1, "user", "x\ny"), (3, 2, "new\nline", "z" * 50_000),
    ]
    write_conversations(folder, talk + [(4, i, f"p{i % 3}", f"turn {i}") for i in range(700)])
    return str(folder)


@pytest.fixture(scope="session")
def empty(tmp_path_factory):
    folder = tmp_path_factory.mktemp("empty")
    write_documents(folder, [])
    write_conversations(folder, [])
    write_embeddings(folder, [])
    return str(folder)


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def texts(small):
    return dict(duckdb.sql(f"SELECT doc_id, text FROM '{small}/documents.parquet'").fetchall())
