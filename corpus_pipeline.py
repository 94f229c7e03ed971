"""The corpus pipeline: language ID, near-duplicates, benchmark decontamination, PII, packing.

Each stage takes (spark, docs, sf_dir) and returns a table; run() writes each as Parquet in the shared folder and reads
it again as the next stage's input. All but the last return the columns of documents.

* language: rows that language ID rejects go (null texts, and texts without a letter); all others stay.
* near_dups: of each group of near copies (five-word shingles, likeness of 0.8 or more) one row stays, that with the
  smallest id; of equal ids that with the smallest hash. Rows count each by itself, those that repeat an id or have
  none too; of rows with the same id and text one stays, that with the smallest other columns (null first).
* decontaminate: words that lie in a benchmark window are cut out of the text; a document of which less than
  KEEP_SHARE of its words is left goes. A null text has no words and stays null.
* pii: each span of personal data is replaced by its kind in brackets; of overlapping spans the first names them all,
  of those that start together the shorter, then the kind first in the alphabet. A null text stays null.
* pack: the documents' token ids, cut and packed into sequences; a null text is an empty one.

In decontaminate, pii and pack rows count each by itself: null ids, repeated ids and repeated rows give a row (or
pieces) each. Columns beyond those of documents, whatever their names, are left out by every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm import decontaminate, langid, neardup, packing, pii
from lakeloom.llm.common import columns, materialise, table

KEEP_SHARE = 0.5
KINDS = {"doc_id": "long", "text": "string", "lang": "string", "source": "string", "n_chars": "long"}


def _documents(docs: DataFrame) -> DataFrame:
    return columns(docs, **KINDS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = _documents(docs)
    return langid.identify(docs, carry=list(KINDS)).where("lang_pred <> 'und'").select(*KINDS)


def near_dups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = _documents(docs)
    docs = docs.withColumn("_row", F.xxhash64("doc_id", "text"))
    linked = neardup.link_documents(docs.select(F.col("_row").alias("doc_id"), "text"))
    linked = linked.groupBy(F.col("doc_id").alias("_row")).agg(F.min("component_id").alias("component"))
    rows = docs.groupBy("_row").agg(F.min("doc_id").alias("id"), F.count("*").alias("n")).join(linked, "_row")
    first = rows.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "_row")).alias("x"))
    rows = rows.join(first.select("x._row", F.lit(True).alias("first")), "_row", "left")
    marks = rows.select("_row", F.col("first").isNull().alias("gone"), "n").where("gone or n > 1").drop("n")
    # only rows that go or are repeated have marks, so all others are taken as they stand
    marked = docs.join(materialise(marks, "marks"), "_row", "left")
    repeated = marked.where("not gone").groupBy("_row").agg(F.min(F.struct(*KINDS)).alias("x")).select("x.*")
    return marked.where("gone is null").select(*KINDS).union(repeated)


def decontaminate_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(_documents(docs), table(spark, sf_dir, "benchmark"), carry=list(KINDS))
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda acc, x: acc + (x["b"] - x["a"]))
    found = found.where((F.size("hits") == 0) | (F.col("n_words") - n_hit >= KEEP_SHARE * F.col("n_words")))
    text = cut_out(F.col("text"), F.col("hits"))
    return found.withColumn("text", text).withColumn("n_chars", F.when(F.size("hits") > 0, F.length("text")).otherwise(F.col("n_chars"))).select(*KINDS)


def cut_out(text, hits):
    """The text without the byte ranges of hits."""
    raw = F.encode(text, "UTF-8")
    starts = F.concat(F.array(F.lit(0)), F.transform(hits, lambda h: h["byte_b"]))
    ends = F.concat(F.transform(hits, lambda h: h["byte_a"]), F.array(F.octet_length(text)))
    pieces = F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda p: F.decode(F.substring(raw, p["a"] + 1, p["b"] - p["a"]), "UTF-8"))
    return F.when(F.size(hits) > 0, F.array_join(pieces, "")).otherwise(text)


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = pii.find_pii(_documents(docs), carry=list(KINDS))
    spans = F.array_sort(F.transform(F.concat("base", "added"), lambda s: F.struct(s["a"].alias("a"), s["b"].alias("b"), s["kind"].alias("kind"))))
    # spans of different kinds may overlap: the first of those that do is named, and reaches to the end of all
    merged = F.aggregate(
        spans,
        F.array().cast("array<struct<a:int,b:int,kind:string>>"),
        lambda acc, s: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["b"] > s["a"]),
            F.concat(
                F.slice(acc, F.lit(1), F.size(acc) - 1),
                F.array(F.struct(F.element_at(acc, -1)["a"].alias("a"), F.greatest(F.element_at(acc, -1)["b"], s["b"]).alias("b"), F.element_at(acc, -1)["kind"].alias("kind"))),
            ),
        ).otherwise(F.concat(acc, F.array(s))),
    )
    found = found.withColumn("spans", merged)
    starts = F.concat(F.array(F.lit(0)), F.transform("spans", lambda s: s["b"]))
    ends = F.concat(F.transform("spans", lambda s: s["a"]), F.array(F.length("text")))
    names = F.concat(F.transform("spans", lambda s: F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))), F.array(F.lit("")))
    zipped = F.arrays_zip(starts.alias("a"), ends.alias("b"), names.alias("name"))
    pieces = F.transform(zipped, lambda p: F.concat(F.substring(F.col("text"), p["a"] + 1, p["b"] - p["a"]), p["name"]))
    text = F.when(F.size("spans") > 0, F.array_join(pieces, "")).otherwise(F.col("text"))
    return found.withColumn("text", text).withColumn("n_chars", F.when(F.size("spans") > 0, F.length("text")).otherwise(F.col("n_chars"))).select(*KINDS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_documents(docs), remember=100_000)  # executors hold what earlier stages left too


STAGES = [("language", language), ("near_dups", near_dups), ("decontaminate", decontaminate_texts), ("pii", mask_pii), ("pack", pack)]

#: Kernel regression, path trees, a fitted field and least squares are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, f"stage-{name}")
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
