"""Helpers shared by the training-data operators: tables, lineage cuts, numbering, words and components."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Bytes of text which one numpy block handles at once; a longer text makes a block of its own.
BLOCK_BYTES = 1 << 20


#: Rows that go to a Python worker at once. Texts are read whole, so this bounds what a worker holds.
BATCH_ROWS = 2500


def bound_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to BATCH_ROWS; smaller ones stay as they are. It changes no result."""
    now = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    if not 0 < now <= BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def columns(df: DataFrame, **kinds: str) -> DataFrame:
    """Only the named columns, cast; columns which the table has besides, clashing names among them, go.

    They are found by exact name and taken by place, so names that differ in case alone don't clash either.
    """
    bound_batches(df.sparkSession)
    places = {c: i for i, c in reversed(list(enumerate(df.columns)))}
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]).select(*[F.col(f"c{places[c]}").cast(k).alias(c) for c, k in kinds.items()])


CARRIED = {"doc_id": "long", "text": "string", "lang": "string", "source": "string", "n_chars": "long"}


def with_carried(docs: DataFrame, carry: list[str] | None) -> DataFrame:
    """The text (as `_text`) and, behind it, the columns that a task hands through."""
    rows = columns(docs, **{c: CARRIED[c] for c in dict.fromkeys(["text", *(carry or ["doc_id"])])})
    return rows.select(F.col("text").alias("_text"), *(carry or ["doc_id"]))


def carried_schema(docs: DataFrame, carry: list[str] | None, found: str) -> str:
    return ", ".join([*[f"{c} {CARRIED[c]}" for c in carry or ["doc_id"]], found])


def carried(batch, *found, names: list[str]):
    """A batch of with_carried with its text replaced by what was found, at the end."""
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([*batch.columns[1:], *found], [*batch.schema.names[1:], *names])


def lean(run):
    """run, for mapInArrow; when its task ends, unused memory goes back to the system, so that workers kept for later tasks are small."""

    def whole(batches):
        import ctypes
        import gc

        import pyarrow as pa

        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return whole


def parallelism(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only where that is unset, as in local tests, one of our own."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"{tempfile.gettempdir()}/lakeloom-shared"
    return found.rstrip("/")


def materialise(df: DataFrame, what: str) -> DataFrame:
    """Cuts the lineage: writes df to the shared folder and reads it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lakeloom/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of materialise() which nothing reads any more; other tables are left alone."""
    for df in tables:
        if path := df.__dict__.pop("written", None):
            delete_path(df.sparkSession, path)


def delete_path(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def crc_mod(col: Column, m: int) -> Column:
    """crc32 of the id as text, modulo m; a null id counts as the empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit(""))) % m


# ---------------------------------------------------------------- numbering without a global window


def prefix_in_order(df: DataFrame, bucket: Column, order: list[Column], sums: dict[str, Column], buckets: int) -> DataFrame:
    """Adds for each name in sums the total over all rows before this one.

    The order is by bucket (0 .. buckets-1, a bound on what is summed in one place), then by `order`. Rows are
    summed by bucket, at most `buckets` such sums are run through a window, and the rest is done per bucket.
    """
    df = df.withColumn("_b", bucket.cast("int"))
    by_bucket = df.groupBy("_b").agg(*[F.sum(c).cast("long").alias(f"_s_{n}") for n, c in sums.items()])
    ahead = W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    starts = by_bucket.select("_b", *[F.coalesce(F.sum(f"_s_{n}").over(ahead), F.lit(0)).alias(f"_p_{n}") for n in sums])
    inside = W.partitionBy("_b").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    df = df.withColumns({n: F.coalesce(F.sum(c).over(inside), F.lit(0)).cast("long") for n, c in sums.items()})
    df = df.join(F.broadcast(starts), "_b")  # at most `buckets` rows
    return df.withColumns({n: F.col(n) + F.col(f"_p_{n}") for n in sums}).drop("_b", *[f"_p_{n}" for n in sums])


# ---------------------------------------------------------------- words as 64-bit hashes, by numpy over Arrow buffers

_R = np.uint64(0x9E3779B97F4A7C15 | 1)


def _byte_table(separators: list[tuple[int, int]]) -> np.ndarray:
    t = np.ones(256, dtype=bool)
    for a, b in separators:
        t[a : b + 1] = False
    t[65:91] = t[97:123]  # A-Z stand for a-z
    return t


#: Words split at ASCII blanks, and words of ASCII letters, digits and all that is not ASCII.
BLANKS = _byte_table([(0x20, 0x20), (0x09, 0x0D)])
PUNCTUATION = _byte_table([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])


def lower_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint64) + np.uint64(1)
    t[65:91] += np.uint64(32)
    return t


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads the bits of 64-bit numbers."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * np.uint64(0xD6E8FEB86659FD93) + mix(b + np.uint64(0x2545F4914F6CDD1D)))


def ranges(first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (length[0] of them), first[1], ..."""
    end = np.cumsum(length)
    return np.arange(end[-1] if len(end) else 0) + np.repeat(first - (end - length), length)


class Tokens:
    """Hashes of the words of many texts, with A-Z in lower case.

    A word's hash is a polynomial in its bytes modulo 2**64, found for all words at once from one running sum.
    """

    def __init__(self, word_byte: np.ndarray):
        self.word_byte, self.low = word_byte, lower_table()
        self.powers = self.inverse = np.ones(1, dtype=np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            n = max(n, BLOCK_BYTES)
            self.powers = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, _R)]))
            inv = np.uint64(pow(int(_R), -1, 1 << 64))
            self.inverse = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, inv)]))

    def blocks(self, texts):
        """texts: an Arrow string array. Yields (first row, row after the last, bytes, offsets of the rows in them)."""
        import pyarrow as pa
        import pyarrow.compute as pc

        texts = pc.fill_null(texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts, "")
        wide = pa.types.is_large_string(texts.type)
        n = len(texts)
        if not n:
            return
        off = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
        data = np.frombuffer(texts.buffers()[2], np.uint8) if off[-1] else np.zeros(0, np.uint8)
        lo = 0
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(off, off[lo] + BLOCK_BYTES, "right")) - 1)
            yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
            lo = hi

    def words(self, data: np.ndarray, off: np.ndarray):
        """Of a block: hashes, start bytes, end bytes, and each row's first word (as offsets, one more than rows)."""
        if not len(data):
            z = np.zeros(0, np.int64)
            return z.astype(np.uint64), z, z, np.zeros(len(off), np.int64)
        inside = self.word_byte[data]
        start, end = inside.copy(), inside.copy()
        start[1:] &= ~inside[:-1]
        end[:-1] &= ~inside[1:]
        edge = off[(off > 0) & (off < len(data))]
        start[edge] = inside[edge]
        end[edge - 1] = inside[edge - 1]
        s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
        self._grow(len(data))
        run = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.low[data] * self.powers[: len(data)], out=run[1:])
        return mix((run[e] - run[s]) * self.inverse[s]), s, e, np.searchsorted(s, off)


# ---------------------------------------------------------------- connected components


#: Edges of a task of components(): where there are few, tasks that shuffles leave small are taken together.
EDGES = 100_000


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges(u, v): returns (node, root), the smallest node that each reaches. Nulls are ignored.

    Alternates the large-star and small-star steps until the edges stay as they are; each step is a grouped minimum
    and a join, written to the shared folder. Sizes at hubs are met by partial sums and by splitting skewed joins.
    The result is a written table.
    """
    e = edges.where("u is not null and v is not null and u <> v").select("u", "v").distinct()
    e, before = materialise(e, "edges"), None
    count = e.count()
    if not count:
        return e.toDF("node", "root")
    for _ in range(rounds):
        tasks = max(e.sparkSession.sparkContext.defaultParallelism, -(-count // EDGES))
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))  # each larger neighbour to the least
        large = large.where("u <> v").coalesce(tasks).distinct().coalesce(tasks)
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(least.select("u", F.col("m").alias("v")))
        after = materialise(small.coalesce(tasks).distinct().coalesce(tasks), "edges")
        discard(e)
        e = after
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before, count = now, now[0]
    else:
        raise RuntimeError("components did not settle")
    found = e.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root").union(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
    out = materialise(found.coalesce(tasks), "roots")
    discard(e)
    return out
