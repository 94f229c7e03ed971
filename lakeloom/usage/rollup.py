"""Usage by path: every object counts for each of its ancestors, in one exploded group-by instead of a walk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Upper edges of the size buckets. Fixed values.
SIZES = [(1024, "LESS_THAN_1024_B"), (65536, "BETWEEN_1024_B_AND_64_KB"), (262144, "BETWEEN_64_KB_AND_256_KB"), (1048576, "BETWEEN_256_KB_AND_1_MB")]
VERSIONS = [(1, "SINGLE_VERSION"), (10, "BETWEEN_2_AND_10"), (100, "BETWEEN_10_AND_100")]


def bucket_of(value: Column, edges: list[tuple[int, str]], rest: str, inclusive: bool = False) -> Column:
    out = F.lit(rest)
    for edge, name in reversed(edges):
        out = F.when(value <= edge if inclusive else value < edge, name).otherwise(out)
    return out


def ancestors(path: Column, most: int = 1024) -> Column:
    """`a/b/c` as [`a`, `a/b`, `a/b/c`], to a bounded depth."""
    parts = F.slice(F.split(path, "/"), 1, most)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def tree(objects: DataFrame, path: str, size: str) -> DataFrame:
    """Sums for each node of the tree."""
    return objects.select(F.explode(ancestors(F.col(path))).alias("node"), F.col(size).alias("_s")).groupBy("node").agg(F.count("*").alias("objects"), F.sum("_s").alias("bytes"))


def checked_tree(edges: DataFrame, sizes: DataFrame, depth: int = 24) -> DataFrame:
    """Complete roll-up from (parent, child) edges and (node, bytes, compacted): null bytes where the subtree isn't sound.

    A subtree isn't sound if a child lacks its own row, a node has two parents, a compacted node has children, or it
    is deeper than `depth`. Levels are joined one after another; each is as large as the tree's level.
    """
    parents = edges.groupBy("child").agg(F.count("*").alias("parents"))
    children = edges.groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("children"))
    nodes = sizes.join(parents.withColumnRenamed("child", "node"), "node", "left").join(children, "node", "left")
    sound = (F.coalesce("parents", F.lit(0)) <= 1) & ~(F.col("compacted") & (F.coalesce("children", F.lit(0)) > 0))
    nodes = nodes.select("node", "bytes", sound.alias("sound"))
    level = edges.select(F.col("parent").alias("top"), F.col("child").alias("node"))
    reach = nodes.select(F.col("node").alias("top"), "node")
    for _ in range(depth):
        reach = reach.union(level)
        level = level.join(edges.withColumnRenamed("parent", "node"), "node").select("top", F.col("child").alias("node"))
    deeper = level.select("top").distinct().withColumn("deeper", F.lit(True))
    sums = reach.join(nodes, "node", "left").groupBy("top").agg(F.sum("bytes").alias("bytes"), F.min(F.coalesce("sound", F.lit(False)).cast("int")).alias("ok"))
    return sums.join(deeper, "top", "left").select(F.col("top").alias("node"), F.when((F.col("ok") == 1) & F.col("deeper").isNull(), F.col("bytes")).alias("bytes"))


def compact(nodes: DataFrame, root: str, limit: int, compact_root: bool = False) -> DataFrame:
    """Collapses subtrees, those of fewest objects first, until the root has no more than `limit` descendants.

    nodes(node, objects) with whole paths, as tree() gives them. Returns the nodes that are left, with `collapsed`.
    A node has no more objects than its ancestors, so its own subtree is collapsed before theirs; what a collapse then
    takes away are the node's children. So nodes collapse in order while their children so far are too few. The
    running sum goes by classes of objects (about a thousand), then inside each.
    """
    depth = F.size(F.split("node", "/"))
    parent = F.regexp_extract("node", "^(.*)/[^/]*$", 1)
    t = nodes.select("node", "objects", depth.alias("depth"), F.when(depth > 1, parent).alias("parent"))
    inner = t.join(t.groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("children")), "node").withColumn("class", F.floor(F.log2(F.greatest("objects", F.lit(1))) * 16))
    classes = inner.groupBy("class").agg(F.sum("children").alias("s"))
    starts = classes.select("class", F.coalesce(F.sum("s").over(W.orderBy("class").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    inside = W.partitionBy("class").orderBy("objects", F.desc("depth"), "node").rowsBetween(W.unboundedPreceding, -1)
    before = F.coalesce(F.sum("children").over(inside), F.lit(0))
    total = t.agg(F.count("*").alias("n"))
    ordered = inner.withColumn("before", before).join(F.broadcast(starts), "class").crossJoin(F.broadcast(total))  # one row
    chosen = ordered.where((F.col("before") + F.col("start") < F.col("n") - 1 - limit) & ((F.col("node") != root) | F.lit(compact_root))).select("node")
    left = t.join(chosen.withColumnRenamed("node", "parent"), "parent", "left_anti")
    return left.join(chosen.withColumn("collapsed", F.lit(True)), "node", "left").select("node", "objects", F.coalesce("collapsed", F.lit(False)).alias("collapsed"))


def top_prefixes(objects: DataFrame, prefix: Column, size: str, most: int) -> DataFrame:
    """Largest prefixes, with a flag if there are more."""
    t = objects.groupBy(prefix.alias("prefix")).agg(F.sum(size).alias("bytes"), F.count("*").alias("objects"))
    top = t.orderBy(F.desc("bytes"), "prefix").limit(most + 1)
    ranked = top.withColumn("rn", F.row_number().over(W.orderBy(F.desc("bytes"), "prefix"))).withColumn("truncated", F.max("rn").over(W.partitionBy()) > most)  # at most `most` + 1 rows
    return ranked.where(F.col("rn") <= most).drop("rn")


def merge_sets(parts: list[DataFrame], key: str) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(key).agg(F.sum("bytes").alias("bytes"), F.sum("objects").alias("objects"))


def sampled_capacity(objects: DataFrame, size: str, fraction: float, seed: int = 1) -> DataFrame:
    """An estimate of the sum from a sample, for a report; exact_capacity is the sum."""
    return objects.sample(fraction, seed).agg((F.sum(size) / fraction).alias("bytes"))


def exact_capacity(objects: DataFrame, size: str) -> DataFrame:
    return objects.agg(F.sum(size).alias("bytes"))
