"""Snapshots, references and small files of tables: what may expire, what nothing refers to, what to rewrite together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType
from pyspark.sql.window import Window as W


def expiry(snapshots: DataFrame, refs: DataFrame, now_ms: int, max_age_ms: int, keep: int) -> DataFrame:
    """State of each snapshot: manual (no time), retained (referenced, or among the newest), candidate, with the reasons.

    snapshots(table, snapshot_id, timestamp_ms, idx); refs(table, snapshot_id).
    """
    w = W.partitionBy("table").orderBy(F.desc_nulls_last("timestamp_ms"), "idx")
    t = snapshots.withColumn("rn", F.row_number().over(w)).join(refs.distinct().withColumn("ref", F.lit(True)), ["table", "snapshot_id"], "left")
    manual = F.array_compact(F.array(F.when(F.col("timestamp_ms").isNull(), "missing-timestamp")))
    retained = F.array_compact(F.array(F.when(F.col("ref"), "referenced"), F.when(F.col("rn") <= keep, "recent")))
    old = F.col("timestamp_ms") <= now_ms - max_age_ms
    t = t.withColumn("manual", manual).withColumn("kept", retained)
    state = F.when(F.size("manual") > 0, "manual").when(F.size("kept") > 0, "retained").when(old, "candidate").otherwise("retained")
    return t.select("table", "snapshot_id", state.alias("state"), F.when(F.size("manual") > 0, F.col("manual")).otherwise(F.col("kept")).alias("reasons"))


def object_kind(key: Column) -> Column:
    return (
        F.when(F.rlike(key, F.lit(r"/metadata/[^/]*\.metadata\.json$")), "metadata")
        .when(F.rlike(key, F.lit(r"/metadata/snap-[^/]*\.avro$")), "manifest-list")
        .when(F.rlike(key, F.lit(r"/metadata/[^/]*\.avro$")), "manifest")
        .when(F.rlike(key, F.lit(r"/data/.*-deletes?[^/]*\.parquet$")), "delete")
        .when(F.rlike(key, F.lit(r"/data/[^/].*\.(?:parquet|orc|avro)$")), "data")
        .otherwise("other")
    )


def reachable(metadata: DataFrame, lists: DataFrame, manifests: DataFrame) -> DataFrame:
    """All keys that the metadata reaches, level by level. Each table is (key, refers_to)."""
    first = metadata.select(F.col("refers_to").alias("key"))
    second = first.join(lists, "key").select(F.col("refers_to").alias("key"))
    third = second.join(manifests, "key").select(F.col("refers_to").alias("key"))
    return metadata.select("key").union(first).union(second).union(third).distinct()


def unreferenced(objects: DataFrame, references: DataFrame, now_s: int, safety_s: int = 900) -> DataFrame:
    """Objects that nothing refers to and that are old enough; none at all if any reference needs review.

    objects(key, modified_s); references(key, review).
    """
    doubt = references.agg(F.coalesce(F.max(F.col("review").cast("int")), F.lit(0)).alias("doubt"))
    left = objects.where(F.col("modified_s") <= now_s - safety_s).join(references.select("key"), "key", "left_anti")
    return left.crossJoin(F.broadcast(doubt)).where("doubt = 0").drop("doubt")  # one row


def output_prefix(path: Column) -> Column:
    return F.regexp_replace(path, "[^/]*$", "")


def pack_small_files(files: DataFrame, by: list[str], order: list[str], size: str, cap: int, least: int) -> DataFrame:
    """Next-fit: files of a prefix in order; a group closes when the next file would exceed the cap; small groups go.

    The sum starts anew at each close, so a prefix's files pass through one task in order, batch by batch, and nothing
    but the open group's sum is carried. A null size counts as none.
    """

    def walk(batches):
        import pyarrow as pa

        key, pack, total = None, 0, 0
        for b in batches:
            packs = []
            for k, n in zip(zip(*[b.column(i).to_pylist() for i in range(len(by))]), b.column(len(by) + len(order)).to_pylist()):
                if k != key:
                    key, pack, total = k, 0, 0
                elif total and total + n > cap:
                    pack, total = pack + 1, 0
                total += n
                packs.append(pack)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(packs, pa.int32())], [*b.schema.names, "pack"])

    t = files.select(*by, *order, F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("size"))
    t = t.repartition(*by).sortWithinPartitions(*by, *order, "size").mapInArrow(walk, StructType([*t.schema.fields, StructField("pack", IntegerType())]))
    return t.withColumn("_n", F.count("*").over(W.partitionBy(*by, "pack"))).where(F.col("_n") >= least).drop("_n")


def update_properties(have: Column, updates: dict[str, str], removals: list[str]) -> tuple[Column, Column, Column]:
    """(new properties, keys removed, keys asked to be removed that were missing)."""
    gone = F.array(*map(F.lit, removals)) if removals else F.array().cast("array<string>")
    fresh = F.create_map(*[F.lit(x) for kv in updates.items() for x in kv]) if updates else F.create_map().cast("map<string,string>")
    left = F.map_filter(have, lambda k, v: ~F.array_contains(gone, k))
    return F.map_concat(left, fresh), F.array_intersect(gone, F.map_keys(have)), F.array_except(gone, F.map_keys(have))


def compact(files: DataFrame, path: str) -> int:
    """Rewrites files of one schema as one. Returns the number of rows."""
    files.coalesce(1).write.mode("overwrite").parquet(path)
    return files.sparkSession.read.parquet(path).count()
