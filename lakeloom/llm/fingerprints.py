"""Document fingerprints: a Merkle tree over sections and paragraphs, in DataFrame operations only.

A text is cut into paragraphs (lines, with their line end), a paragraph into pieces (to the end of a sentence, 64
code points at most); nothing of the text is left out. Leaves are md5 sums of pieces, then come nodes for paragraphs
and for sections of SECTION paragraphs, and the root is a sha256 sum: equal roots mean equal texts. The fingerprint
is `root|section,section|leaf,leaf`, sections and leaves by eight hex digits each, so two fingerprints alone show
which branches differ. Likeness is the Dice ratio of the distinct leaves, or 1 for equal roots.

Defined cases: a null text is an empty one, whose tree is a root without leaves. The next document is the one with
the next smaller id, after the smallest the largest; where several rows have that id, the one that sorts first by
text. A null id has no next document: nothing replaces its second half, and near_next is 0. Repeated rows each give a
row. An empty table gives an empty result; other columns go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lakeloom.llm.common import columns, parallelism, table

PARAGRAPH = r"(?s)[^\n]*\n|[^\n]+"
PIECE = r"(?s)[^.!?\n]{0,63}(?:[.!?\n]\s*|.)"
SECTION = 8


def leaf_sums(text: Column) -> Column:
    """array<array<string>>: the md5 sums of the pieces of each paragraph."""
    paragraphs = F.regexp_extract_all(text, F.lit(PARAGRAPH), F.lit(0))
    return F.transform(paragraphs, lambda p: F.transform(F.regexp_extract_all(p, F.lit(PIECE), F.lit(0)), lambda x: F.md5(x)))


def fingerprint(text: Column) -> Column:
    leaves = leaf_sums(text)
    short = lambda c: F.array_join(F.transform(c, lambda x: F.substring(x, 1, 8)), ",")

    def above(paragraphs: Column) -> Column:
        nodes = F.transform(paragraphs, lambda x: F.md5(F.array_join(x, ",")))
        last = F.greatest(F.ceil(F.size(paragraphs) / SECTION).cast("int"), F.lit(1))
        sections = lambda n: F.transform(F.sequence(F.lit(1), last), lambda i: F.md5(F.array_join(F.slice(n, (i - 1) * SECTION + 1, F.lit(SECTION)), ",")))
        whole = lambda s: F.concat_ws("|", F.sha2(F.array_join(s, ","), 256), short(s), short(F.flatten(paragraphs)))
        return bound(bound(nodes, sections), whole)

    return bound(leaves, above)


def bound(value: Column, body) -> Column:
    """body(value) with value computed once, where the optimizer would repeat it."""
    return F.transform(F.array(value), body)[0]


def leaves_of(tree: Column) -> Column:
    return F.array_remove(F.split(F.substring_index(tree, "|", -1), ","), "")


def likeness(tree_a: Column, tree_b: Column) -> Column:
    """From the fingerprints alone: 1 for equal roots, else the Dice ratio of the distinct leaves."""

    def dice(pair: Column) -> Column:
        a, b = pair["a"], pair["b"]
        n = F.size(a) + F.size(b)
        return F.when(n == 0, 0.0).otherwise(2.0 * F.size(F.array_intersect(a, b)) / n)

    pair = F.struct(F.array_distinct(leaves_of(tree_a)).alias("a"), F.array_distinct(leaves_of(tree_b)).alias("b"))
    return F.when(F.substring_index(tree_a, "|", 1) == F.substring_index(tree_b, "|", 1), 1.0).otherwise(bound(pair, dice)).cast("double")


def next_ids(ids: DataFrame, parts: int) -> DataFrame:
    """ids(doc_id): distinct. Adds next_id, the next smaller one, for the smallest the largest.

    Ids are dealt to slices between quantiles; each slice looks back by itself, and its smallest id takes the largest
    of the slices below. What the driver gets is a bounded number of quantiles.
    """
    parts = max(1, min(parts, 512))
    cuts = sorted(set(ids.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.25 / parts))) if parts > 1 else []
    if cuts:
        slices = F.size(F.filter(F.array(*[F.lit(int(c)) for c in cuts]), lambda c: c <= F.col("doc_id")))
    else:
        slices = F.lit(0)
    ids = ids.withColumn("part", slices)
    tops = ids.groupBy("part").agg(F.max("doc_id").alias("top"))
    tops = tops.select("part", F.coalesce(F.lag("top").over(W.orderBy("part")), F.max("top").over(W.partitionBy())).alias("below"))
    looked = ids.withColumn("prev", F.lag("doc_id").over(W.partitionBy("part").orderBy("doc_id")))
    return looked.join(F.broadcast(tops), "part").select("doc_id", F.coalesce("prev", "below").alias("next_id"))  # tops: at most 512 rows


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """The texts are shuffled once, by id; each then goes to the document before it as a head and a fingerprint."""
    n = parallelism(docs)
    docs = columns(docs, doc_id="long", text="string").withColumn("text", F.coalesce("text", F.lit("")))
    # never null, so that no filter on nulls tells the two uses of the shuffled texts apart; rows without id are spread
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("-"), F.xxhash64("text").cast("string")))
    dealt = docs.withColumn("k", key).repartition(n, "k")
    one = dealt.withColumn("_n", F.row_number().over(W.partitionBy("k").orderBy("doc_id", "text"))).where("_n = 1")
    half = F.floor(F.length("text") / 2).cast("int")
    after = next_ids(docs.select("doc_id").where("doc_id is not null").distinct(), n)
    want = docs.where("doc_id is not null").groupBy("doc_id").agg(F.max(half).alias("half")).join(after, "doc_id")
    want = want.select(F.col("doc_id").cast("string").alias("for_k"), F.coalesce(F.col("next_id").cast("string"), F.lit("")).alias("k"), "half")
    got = one.join(want, "k").select(F.col("for_k").alias("k"), F.substring("text", F.lit(1), F.col("half")).alias("head"), fingerprint(F.col("text")).alias("next_fingerprint"))
    both = dealt.join(got, "k", "left")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring(F.coalesce("head", F.lit("")), F.lit(1), half))
    both = both.withColumn("edited", edited).withColumn("fingerprint", fingerprint(F.col("text"))).withColumn("edited_fingerprint", fingerprint(F.col("edited")))
    return both.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.coalesce("next_fingerprint", F.lit(""))).alias("near_next"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents"))
