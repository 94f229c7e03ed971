"""Sharding: minimax contiguous partition of ordered atomic groups, in DataFrame operations only.

Equal texts form a group, which no cut divides. Groups stand in the order of a hash of their text. The smallest
capacity with which a greedy pass needs no more than the wanted number of shards is found by binary search, and the
cuts are made there. The greedy pass runs on atoms: runs of consecutive groups that end in the same one of
shards * ATOMS_PER_SHARD slices of the total, so the driver gets a bounded number of sums however many groups there
are. The capacity is therefore at most two slices (2 / ATOMS_PER_SHARD of a shard) above the best there is.

Defined cases: a null text counts as an empty one in groups and checksum and has no bytes; repeated rows are rows of
one group and get slots of their own; null ids are allowed; an empty table gives an empty result; other columns go.
"""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lakeloom.llm.common import columns, prefix_in_order

ATOMS_PER_SHARD = 4096
#: Slices of the hash order that are summed apart, and parts into which the rows of one text are dealt for numbering.
BUCKETS, SALTS = 1 << 14, 64


def greedy_cuts(ends: list[int], capacity: int) -> list[int] | None:
    """Ends of the shards, taken greedily; ends: running totals of the atoms. None if an atom is larger."""
    cuts, start, i = [], 0, 0
    while i < len(ends):
        j = bisect.bisect_right(ends, start + capacity, lo=i)
        if j == i:
            return None
        start, i = ends[j - 1], j
        cuts.append(start)
    return cuts


def minimax_cuts(ends: list[int], shards: int) -> list[int]:
    """The cuts of the smallest capacity for which the greedy pass needs at most so many shards."""
    if not ends:
        return []
    lo, hi = max(1, -(-ends[-1] // shards)), ends[-1]
    while lo < hi:
        mid = (lo + hi) // 2
        cuts = greedy_cuts(ends, mid)
        lo, hi = (lo, mid) if cuts is not None and len(cuts) <= shards else (mid + 1, hi)
    return even_cuts(ends, shards, lo)


def even_cuts(ends: list[int], shards: int, capacity: int) -> list[int]:
    """Among the cuts that keep every shard within a feasible capacity, those nearest to equal shares."""
    total, earliest, left = ends[-1], [ends[-1]], ends[-1]
    for _ in range(shards - 1):  # from the right: the earliest cut after which the rest still fits
        j = bisect.bisect_left(ends, left - capacity)
        left = ends[j] if left - capacity > 0 else 0
        earliest.append(left)
    earliest.reverse()
    cuts, start = [], 0
    for i in range(1, shards):
        latest = bisect.bisect_right(ends, start + capacity) - 1
        first = bisect.bisect_left(ends, max(earliest[i - 1], start + 1))
        near = min(range(max(first, 0), latest + 1), key=lambda j: abs(ends[j] * shards - i * total), default=latest) if latest - first < 2 else None
        if near is None:
            j = min(max(bisect.bisect_left(ends, i * total / shards), first), latest)
            near = j - 1 if j > first and abs(ends[j - 1] * shards - i * total) < abs(ends[j] * shards - i * total) else j
        start = ends[near]
        cuts.append(start)
        if start == total:
            return cuts
    return [*cuts, total]


def shard_documents(docs: DataFrame, shards: int = 24, overhead: int = 8, buckets: int = BUCKETS, salts: int = SALTS) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, shard, slot."""
    text = F.coalesce("text", F.lit(""))
    rows = columns(docs, doc_id="long", text="string").select(
        "doc_id",
        (F.octet_length(text) + overhead).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.sha2(text, 256).alias("h"),
        F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int").alias("salt"),
    )
    bucket = (F.conv(F.substring("h", 1, 8), 16, 10).cast("long") * buckets / F.lit(1 << 32)).cast("int")
    # units: the rows of one text and one salt; their numbering is local, and so a text in a third of the rows is dealt out
    units = rows.groupBy("h", "salt").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    units = prefix_in_order(units, bucket, [F.col("h"), F.col("salt")], {"row0": F.col("n"), "byte0": F.col("bytes")}, buckets)
    groups = units.groupBy("h").agg(F.max(F.col("byte0") + F.col("bytes")).alias("end"), F.min("byte0").alias("begin"))
    total = units.agg(F.sum("bytes")).first()[0] or 0
    step = max(1, -(-total // (shards * ATOMS_PER_SHARD)))
    atoms = groups.groupBy(F.ceil(F.col("end") / step).alias("slice")).agg(F.max("end").alias("end"))
    ends = sorted(int(r["end"]) for r in atoms.collect())  # at most shards * ATOMS_PER_SHARD + 1
    cuts = minimax_cuts(ends, shards)
    starts = [0, *cuts[:-1]]
    shard_of = sum([(F.col("begin") >= c).cast("int") for c in cuts[:-1]], F.lit(0))
    groups = groups.select("h", shard_of.alias("shard"))
    units = units.join(groups, "h").select("h", "salt", "row0", "shard")
    first = units.groupBy("shard").agg(F.min("row0").alias("row_first"))
    units = units.join(F.broadcast(first), "shard")  # one row per shard
    in_unit = F.row_number().over(W.partitionBy("h", "salt").orderBy("doc_id")) - 1
    assert len(starts) <= max(1, shards)
    return (
        rows.withColumn("i", in_unit)
        .join(units, ["h", "salt"])
        .select("doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), (F.col("row0") - F.col("row_first") + F.col("i")).cast("long").alias("slot"))
    )


def query(spark, sf_dir: str) -> DataFrame:
    from lakeloom.llm.common import table

    out = shard_documents(table(spark, sf_dir, "documents"), 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
