import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

WORDS = [a + b + c for a in ("ba", "de", "ki", "lo", "mu", "sta", "tri") for b in ("n", "r", "l", "st") for c in ("a", "e", "ion", "er", "o")]


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


def write(folder, documents, benchmark=(), labels=(), more=None):
    """documents: (doc_id, text, lang, source); the tables get extra columns, some with names that operators use inside."""
    folder.mkdir(parents=True, exist_ok=True)
    cols = list(zip(*documents)) if documents else [[]] * 4
    n = len(documents)
    kinds = (pa.int64(), pa.string(), pa.string(), pa.string())
    arrays = {k: pa.array(list(c), t) for k, c, t in zip(("doc_id", "text", "lang", "source"), cols, kinds)}
    arrays["n_chars"] = pa.array([len(x) if x is not None else None for x in cols[1]], pa.int64())
    for clash in ("_text", "k", "h", "key", "node", "shard", "slot", "label", "length", "score", "hits", "n_words", "seed", "_n"):
        arrays[clash] = pa.array([f"{clash}{i}" for i in range(n)], pa.string())
    pq.write_table(pa.table(arrays), folder / "documents.parquet")
    pq.write_table(pa.table({"item_id": pa.array([b[0] for b in benchmark], pa.int64()), "text": pa.array([b[1] for b in benchmark], pa.string()), "w": pa.array(["w"] * len(benchmark), pa.string())}), folder / "benchmark.parquet")
    pq.write_table(
        pa.table({"doc_id": pa.array([x[0] for x in labels], pa.int64()), "quality": pa.array([x[1] for x in labels], pa.int32()), "toxic": pa.array([0] * len(labels), pa.int32()), "label": pa.array(["x"] * len(labels), pa.string())}),
        folder / "labels.parquet",
    )
    return str(folder)


@pytest.fixture(scope="session")
def odd(tmp_path_factory):
    """Nulls in every column, empty, blank, one-word and very long texts, ties, repeated rows, ids shared by different texts."""
    rng = random.Random(3)
    long = prose(rng, 60_000)
    base = prose(rng, 120)
    docs = [
        (1, base, "en", "a"), (2, base, "en", "a"), (3, base.upper(), "en", None), (4, base + " one more", None, "a"),
        (5, None, "en", "a"), (6, "", "en", "a"), (7, " \n\t ", "de", "b"), (8, "word", "de", "b"), (9, "12 34 !!", "de", "b"),
        (10, long, "de", "b"), (11, long + " tail", "de", "b"), (12, "x" * 150_000, "de", "b"), (13, "é ñ ß 🙂 " * 30, "fr", "c"),
        (14, "mail me@example.com or +1 (555) 010-2030, 10.0.0.1, 4111 1111 1111 1111", "en", "c"),
        (15, "same row", "en", "c"), (15, "same row", "en", "c"), (16, "one text here", "en", "c"), (16, "other text there", "en", "c"),
        (None, base, "en", "c"), (None, None, None, None), (None, prose(rng, 50), "en", "c"), (-7, "<|endoftext|> a\x00b\x1cc", "en", "c"), (2**62, "large id", "en", "c"),
        (17, "Der " * 400, "de", "c"), (18, "1" * 20_000, None, "c"),
    ]
    items = [(1, " ".join(base.split()[10:40])), (2, "one text here"), (3, None), (4, ""), (5, "!!"), (None, "other text"), (1, " ".join(base.split()[10:40]))]
    labels = [(d[0], int(bool(d[1]))) for d in docs] + [(None, 1), (1, None), (999, 1)]
    return write(tmp_path_factory.mktemp("odd") / "t", docs, items, labels), docs, items


@pytest.fixture(scope="session")
def empty(tmp_path_factory):
    return write(tmp_path_factory.mktemp("empty") / "t", [])
