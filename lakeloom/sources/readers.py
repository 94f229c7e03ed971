"""Objects and log files as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def csv(spark: SparkSession, path: str, header: str = "USE", columns: int | None = None, field: str = ",", record: str | None = None, quote: str = '"', comment: str | None = None) -> DataFrame:
    """All columns are text, so `05000` keeps its zero. header: USE (names from it), IGNORE (skipped) or NONE (it is data); the last two name columns _1, _2, ..."""
    options = {"sep": field, "quote": quote, "header": str(header != "NONE").lower(), "inferSchema": "false", "enforceSchema": "true"}
    if record:
        options["lineSep"] = record
    if comment:
        options["comment"] = comment
    t = spark.read.options(**options).csv(path)
    return t if header == "USE" else t.toDF(*[f"_{i + 1}" for i in range(len(t.columns))])


def json_lines(spark: SparkSession, path: str, schema=None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).json(path)


def json_document(spark: SparkSession, path: str, inside: str | None = None) -> DataFrame:
    """A whole document; `inside` names the array whose elements are the rows."""
    t = spark.read.option("multiLine", "true").json(path)
    return t.select(F.explode(F.col(inside)).alias("x")).select("x.*") if inside else t


def parquet_row_groups(spark: SparkSession, path: str, start: int, end: int) -> DataFrame:
    """Rows of the row groups that begin in [start, end], by byte offset. The footer is read on the driver."""
    import pyarrow.parquet as pq

    meta = pq.ParquetFile(path).metadata
    first, keep = 0, F.lit(False)
    for g in range(meta.num_row_groups):
        c = meta.row_group(g).column(0)
        at = min(x for x in (c.dictionary_page_offset, c.data_page_offset) if x is not None)
        n = meta.row_group(g).num_rows
        if start <= at <= end:
            keep = keep | F.col("_metadata.row_index").between(first, first + n - 1)
        first += n
    t = spark.read.parquet(path)
    return t.where(keep)


def text_with_offsets(spark: SparkSession, path: str) -> DataFrame:
    """(offset, text) of every line; the offset is the line's first byte in its file."""
    lines = spark.sparkContext.newAPIHadoopFile(path, "org.apache.hadoop.mapreduce.lib.input.TextInputFormat", "org.apache.hadoop.io.LongWritable", "org.apache.hadoop.io.Text")
    return spark.createDataFrame(lines, "offset long, text string")


def text_range(spark: SparkSession, path: str, start: int, end: int) -> DataFrame:
    """Records whose first byte lies in [start, end], whole."""
    return text_with_offsets(spark, path).where(F.col("offset").between(start, end))


def codec_of(name: Column) -> Column:
    ext = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    known = {"gz": "gzip", "gzip": "gzip", "bz2": "bzip2", "xz": "xz", "zz": "zlib", "zlib": "zlib", "zst": "zstd", "zstd": "zstd", "tar": "tar", "zip": "zip"}
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in known.items() for x in kv]), ext), F.lit("unknown"))


def looks_binary(content: Column) -> Column:
    """More than one NUL in a hundred of the first 8 KiB."""
    head = F.hex(F.substring(content, 1, 8192))
    nul = F.size(F.filter(F.regexp_extract_all(head, F.lit("(..)"), F.lit(1)), lambda b: b == "00"))
    return nul * 100 > F.octet_length(F.substring(content, 1, 8192))


def archives(spark: SparkSession, path: str, depth: int = 3, most_entries: int = 10_000, most_bytes: int = 8 << 30, most_line: int = 1 << 20) -> DataFrame:
    """Lines of files and of the archives among them: (node, file, line, text). Provenance is joined by `!`.

    Archives (zip, tar, gzip and zstd of any number of members or frames) are known by their first bytes. Each is read as
    a stream by one task, in blocks, and its lines leave in batches; only a zip inside another archive is held whole.
    What is left out is named in a row with line 0: `limit reached` at the first entry, byte or level beyond the limits
    of a file, `line N cut` for what a line has over most_line bytes, `binary`, and `unreadable` where a format is broken.
    """

    def expand(batches):
        import gzip
        import io
        import itertools
        import tarfile
        import zipfile
        import zlib

        import pandas as pd
        import zstandard

        broken = (OSError, EOFError, zipfile.BadZipFile, tarfile.TarError, zstandard.ZstdError, zlib.error)

        class Bounded(io.RawIOBase):
            """A stream that ends where its file's budget of bytes does, and notes whether there was more."""

            def __init__(self, inner, left):
                self.inner, self.left = inner, left

            def readable(self):
                return True

            def readinto(self, block):
                got = self.inner.read(min(len(block), self.left["bytes"]) or 1)
                if got and not self.left["bytes"]:
                    self.left["over"] = True
                    return 0
                block[: len(got)] = got
                self.left["bytes"] -= len(got)
                return len(got)

        def entry(left):
            left["entries"] -= 1
            left["over"] |= left["entries"] < 0

        def lines(name, stream):
            for n in itertools.count(1):
                line = stream.readline(most_line + 1)
                if not line:
                    return
                long = len(line) > most_line and not line.endswith(b"\n")
                text = line.removesuffix(b"\n")[:most_line]
                if text:
                    yield name, n, text.decode("utf-8", "replace")
                if long:
                    yield name, 0, f"line {n} cut"
                while long:
                    rest = stream.readline(1 << 16)
                    long = bool(rest) and not rest.endswith(b"\n")

        def walk(name, inner, level, left):
            if level > depth:
                yield name, 0, "limit reached"
                return
            stream = io.BufferedReader(Bounded(inner, left), 1 << 16)
            head = stream.peek(8192)[:8192]
            if head[:4] == b"PK\x03\x04":
                with zipfile.ZipFile(io.BytesIO(stream.read())) as z:
                    for i in z.infolist():
                        if not i.is_dir():
                            entry(left)
                            if left["over"]:
                                return
                            with z.open(i) as member:
                                yield from walk(f"{name}!{i.filename}", member, level + 1, left)
            elif head[:2] == b"\x1f\x8b":
                yield from walk(name, gzip.GzipFile(fileobj=stream), level + 1, left)
            elif head[:4] == b"\x28\xb5\x2f\xfd":
                yield from walk(name, zstandard.ZstdDecompressor().stream_reader(stream, read_across_frames=True), level + 1, left)
            elif head[257:262] == b"ustar":
                with tarfile.open(fileobj=stream, mode="r|") as t:
                    for m in t:
                        if m.isfile():
                            entry(left)
                            if left["over"]:
                                return
                            yield from walk(f"{name}!{m.name}", t.extractfile(m), level + 1, left)
            elif head.count(0) * 100 > len(head):
                yield name, 0, "binary"
            else:
                yield from lines(name, stream)

        def rows_of(path, content):
            parts, left = path.split("/"), {"entries": most_entries, "bytes": most_bytes, "over": False}
            node, name = parts[-2] if len(parts) > 1 else "", parts[-1]
            try:
                for r in walk(name, io.BytesIO(content), 0, left):
                    yield node, *r
            except broken as e:
                if not left["over"]:  # a stream that ends early is broken by the limit
                    yield node, name, 0, f"unreadable: {type(e).__name__}"
            if left["over"]:
                yield node, name, 0, "limit reached"

        for b in batches:
            for p, content in zip(b["path"], b["content"]):
                rows = rows_of(p, content)
                while part := list(itertools.islice(rows, 10_000)):
                    yield pd.DataFrame(part, columns=["node", "file", "line", "text"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInPandas(expand, "node string, file string, line long, text string")


def logs(spark: SparkSession, path: str) -> DataFrame:
    """Lines of plain or gzip/bzip2 log files below a folder: (node, file, text). The folder's name is the node."""
    t = spark.read.option("recursiveFileLookup", "true").text(path)
    parts = F.split(F.col("_metadata.file_path"), "/")
    return t.select(F.element_at(parts, -2).alias("node"), F.element_at(parts, -1).alias("file"), F.col("value").alias("text"))


#: What is read of a table's metadata document.
TABLE_METADATA = "`format-version` int, `table-uuid` string, location string, properties map<string,string>, `current-snapshot-id` long, snapshots array<struct<`snapshot-id`:long,`sequence-number`:long,`timestamp-ms`:long,`manifest-list`:string>>, refs map<string,struct<`snapshot-id`:long,type:string>>"


def table_metadata(spark: SparkSession, path: str) -> DataFrame:
    t = spark.read.option("wholetext", "true").text(path)
    return t.select(F.col("_metadata.file_path").alias("file"), F.from_json("value", TABLE_METADATA).alias("m")).select("file", "m.*")


def pinned(spark: SparkSession, path: str, suffix: str = "") -> list[str]:
    """The files of a folder now, for a read that later files don't change. Overwritten files are not protected."""
    files = spark.read.format("binaryFile").load(path).select("path")
    return sorted(r["path"] for r in files.collect() if r["path"].endswith(suffix))
