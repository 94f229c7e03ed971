"""MinHash near-dedup: a chosen-path set similarity join over word shingles, confirmed on whole sets.

Documents with equal sets form a class, which counts as one set from here on. A class has a minwise value for each
of COORDINATES hash functions. In each of TREES trees it follows paths: at a node, some of the tree's own OWN
coordinates are selected by a hash of the node (WIDTHS many by level), and the class goes to the children named by its
own minwise tokens there. No two trees have a coordinate in common, so their misses are independent: at likeness 0.8
all trees miss fewer than 1 pair in 30,000 (test_miss_of_the_trees measures it), and fewer above.

1. Classes that reach the same leaf are all compared by short sketches. A row of the leaf gives its nearest earlier
   member, and one near member of each other group of the leaf that it joins: a spanning forest of the near pairs, at
   most about a row per member, never all pairs.
2. Of all its leaves a class takes its nearest member, and those pairs (one a class) are confirmed on whole texts.
   Confirmed pairs make components.
3. Forest edges that still lead from one component to another tell which components could be linked. In each such
   family the members outside its largest component are a query set, compared exactly, on whole sets and in blocks of
   bounded size, with all of the family. A block gives a link only where it joins two components. So every pair of a
   leaf with near sketches is in one component or has been compared, without an unlimited round.

Leaves of more than HOT rows, which only copies so alike that no token splits them make, are dealt to chunks; PIVOTS
rows of the leaf stand in each chunk, so that the forest spans them. Members which are not in the family of most of
their leaf are sent to all of its chunks. What is dealt is joined by leaf, so nothing of it passes through the driver.

Sketches of likeness 0.8 agree in fewer than SKETCH_LEAST of SKETCH places with chance below 1e-8.

Defined cases: null and blank texts have no shingles and are linked with nothing, as are rows whose id is null
(component_id null, kept true); a text of fewer words than a shingle is one shingle; rows that share an id are one
document, which has all their links; an empty table gives an empty result; other columns go.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import BLANKS, Tokens, columns, components, discard, materialise, mix, pair_hash, parallelism, table

TREES, WIDTHS, OWN = 5, (2, 2, 2, 1), 16
COORDINATES, SKETCH, SKETCH_LEAST = TREES * OWN, 64, 32
#: Rows of a leaf, or of a chunk of one, that are compared at once.
HOT, PIVOTS = 1024, 4
#: Bounds on a block of step 3: rows that ask and the bytes of their texts, rows that are asked and the bytes of theirs.
ASK_ROWS, ASK_BYTES, BLOCK_ROWS, BLOCK_TEXT = 256, 2 << 20, 2048, 8 << 20
SIGNED = "doc_id long, n_shingles long, s1 long, s2 long, sig binary, sketch binary"


def shingle_hashes(h: np.ndarray, first: np.ndarray, words: int):
    """Hashes of each row's shingles, and where each row's begin. A row of fewer words is one shingle, of none none."""
    n = np.diff(first)
    count = np.where(n >= words, n - words + 1, (n > 0).astype(np.int64))
    start = np.concatenate([[0], np.cumsum(count)])
    at = np.repeat(first[:-1] - start[:-1], count) + np.arange(start[-1])
    width = np.repeat(np.minimum(n, words), count)
    out = mix(width.astype(np.uint64)) if len(width) else np.zeros(0, np.uint64)
    for k in range(words):
        on = width > k
        out[on] = pair_hash(out[on], h[at[on] + k])
    return out, start


def row_sets(h: np.ndarray, start: np.ndarray):
    """Sorted distinct hashes of each row, and where each row's begin."""
    row = np.repeat(np.arange(len(start) - 1), np.diff(start))
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row = h[new], row[new]
    return h, np.searchsorted(row, np.arange(len(start)))


def multipliers(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    x = mix(np.arange(2 * n, dtype=np.uint64) + np.uint64(seed))
    return x[:n] | np.uint64(1), x[n:]


def sign(words: int):
    def run(batches):
        import pyarrow as pa

        tokens = Tokens(BLANKS)
        mul, add = multipliers(COORDINATES + SKETCH, 1000)
        names = ("doc_id", "n_shingles", "s1", "s2", "sig", "sketch")
        for b in batches:
            for lo, hi, data, off in tokens.blocks(b.column(1)):
                h, _, _, first = tokens.words(data, off)
                h, start = row_sets(*shingle_hashes(h, first, words))
                n = np.diff(start)
                some = np.flatnonzero(n)
                s1, s2 = np.zeros(hi - lo, np.uint64), np.zeros(hi - lo, np.uint64)
                low = np.zeros((COORDINATES + SKETCH, hi - lo), np.uint64)
                if len(some):
                    s1[some] = np.add.reduceat(mix(h), start[some])
                    s2[some] = np.add.reduceat(mix(h ^ np.uint64(0xABCDEF)), start[some])
                    for k in range(COORDINATES + SKETCH):
                        low[k, some] = np.minimum.reduceat(h * mul[k] + add[k], start[some])
                sig = (mix(low[:COORDINATES].T) >> np.uint64(32)).astype("<u4")
                sketch = (mix(low[COORDINATES:].T) >> np.uint64(56)).astype(np.uint8)
                arrays = [b.column(0).slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64))]
                arrays += [pa.array([x.tobytes() for x in m], pa.binary()) for m in (sig, sketch)]
                yield pa.RecordBatch.from_arrays(arrays, names)

    return run


def leaf_hashes(sig: np.ndarray) -> np.ndarray:
    """sig: classes x coordinates. Returns classes x leaves: all paths of all trees."""
    paths = mix(np.arange(TREES, dtype=np.uint64) + np.uint64(5))[None, :].repeat(len(sig), axis=0)
    take = np.arange(len(sig))[:, None]
    for width in WIDTHS:
        nexts = []
        start = np.arange(paths.shape[1], dtype=np.uint64) % np.uint64(TREES) * np.uint64(OWN)  # hstack keeps the trees in turn
        for turn in range(width):
            pick = mix(paths + np.uint64(turn + 1))  # selected by the node alone, so all that are in it agree
            if turn:  # a second coordinate that differs from the first
                pick = start + (nexts[0][1] - start + np.uint64(1) + pick % np.uint64(OWN - 1)) % np.uint64(OWN)
            else:
                pick = start + pick % np.uint64(OWN)
            token = sig[take, pick.astype(np.int64)].astype(np.uint64)
            nexts.append((pair_hash(paths, token + (pick << np.uint64(32))), pick))
        paths = np.hstack([x[0] for x in nexts])
    return paths.view(np.int64)


def only_leaves(batches):
    import pyarrow as pa

    for b in batches:
        if b.num_rows:
            sig = np.frombuffer(b"".join(b.column(0).to_pylist()), "<u4").reshape(b.num_rows, COORDINATES)
            yield pa.RecordBatch.from_arrays([pa.array(leaf_hashes(sig).ravel())], ["leaf"])


def leaf_rows(batches):
    import pyarrow as pa

    for b in batches:
        if b.num_rows:
            sig = np.frombuffer(b"".join(b.column(1).to_pylist()), "<u4").reshape(b.num_rows, COORDINATES)
            leaves = leaf_hashes(sig)
            pick = pa.array(np.repeat(np.arange(b.num_rows), leaves.shape[1]))
            yield pa.RecordBatch.from_arrays([pa.array(leaves.ravel()), b.column(0).take(pick), b.column(2).take(pick)], ["leaf", "node", "sketch"])


def by_group(batches, keys: int):
    """Batches sorted by their first `keys` columns, cut at whole groups: yields (table of whole groups, group starts)."""
    import pyarrow as pa

    def starts(t):
        k = [t.column(i).to_numpy() for i in range(keys)]
        new = np.ones(t.num_rows, bool)
        new[1:] = np.any([c[1:] != c[:-1] for c in k], axis=0)
        return np.flatnonzero(new)

    kept = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = t if kept is None else pa.concat_tables([kept, t])
        if not t.num_rows:
            continue
        s = starts(t)
        kept = t.slice(int(s[-1]))
        if len(s) > 1:
            yield t.slice(0, int(s[-1])).combine_chunks(), s
    if kept is not None and kept.num_rows:
        yield kept.combine_chunks(), np.array([0, kept.num_rows])


def sketches(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), SKETCH)


def alike(sk: np.ndarray, i: int, lo: int, hi: int) -> np.ndarray:
    """In how many places each sketch of lo..hi agrees with that of i."""
    return np.count_nonzero(sk[lo:hi] == sk[i], axis=1)


def forest(batches):
    """Sorted by (leaf, chunk, rank, node): for each row its nearest earlier member, and a near one of each other group it joins."""
    import pyarrow as pa

    for t, s in by_group(batches, 2):
        n = np.diff(s)
        if not (n > 1).any():
            continue
        many = pa.array(np.flatnonzero(np.repeat(n > 1, n)))
        node, sk = t.column("node").to_numpy()[many], sketches(t.column("sketch").take(many))
        s = np.concatenate([[0], np.cumsum(n[n > 1])])
        two = s[:-1][np.diff(s) == 2]
        same = np.count_nonzero(sk[two] == sk[two + 1], axis=1)
        on = (same >= SKETCH_LEAST) & (node[two] != node[two + 1])
        a, b, c = [node[two + 1][on]], [node[two][on]], [same[on]]
        for g in np.flatnonzero(np.diff(s) > 2):
            lo, hi = int(s[g]), int(s[g + 1])
            own = np.arange(lo, hi)
            rows = []
            for i in range(lo + 1, hi):
                same = alike(sk, i, lo, i)
                near = np.flatnonzero((same >= SKETCH_LEAST) & (node[lo:i] != node[i]))
                if not len(near):
                    continue
                best = near[same[near].argmax()]
                rows.append((i, lo + best, same[best]))
                groups = own[near]
                if (groups != groups[0]).any():
                    for other in np.unique(groups):
                        if other != own[best]:
                            x = near[np.flatnonzero(groups == other)[0]]
                            rows.append((i, lo + x, same[x]))
                    own[: i - lo][np.isin(own[: i - lo], groups)] = own[best]
                own[i - lo] = own[best]
            if rows:
                i, j, same = np.array(rows).T
                a.append(node[i])
                b.append(node[j])
                c.append(same)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b)), pa.array(np.concatenate(c).astype(np.int32))], ["a", "b", "same"])


def ask_chunks(batches):
    """Sorted by (leaf, chunk): for each row that asks, one near member of each other family in the chunk."""
    import pyarrow as pa

    for t, s in by_group(batches, 2):
        node, family, asks = (t.column(c).to_numpy() for c in ("node", "family", "asks"))
        sk, a, b = sketches(t.column("sketch")), [], []
        for lo, hi in zip(s[:-1].tolist(), s[1:].tolist()):
            for i in (lo + np.flatnonzero(asks[lo:hi])).tolist():
                near = lo + np.flatnonzero((alike(sk, i, lo, hi) >= SKETCH_LEAST) & (family[lo:hi] != family[i]))
                _, first = np.unique(family[near], return_index=True)
                a.append(np.full(len(first), node[i]))
                b.append(node[near[first]])
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])


def compare_blocks(words: int, percent: int):
    """Sorted by (family, ask_block, block): links that join components, each row that asks against all rows of its block."""

    def run(batches):
        import pyarrow as pa

        tokens = Tokens(BLANKS)
        for t, s in by_group(batches, 3):
            node, label, asks, u, v = (*(t.column(c).to_numpy() for c in ("node", "label", "asks")), [], [])
            for lo, hi in zip(s[:-1].tolist(), s[1:].tolist()):
                sets = text_sets(tokens, t.column("text").slice(lo, hi - lo), words)
                size = np.array([len(x) for x in sets])
                start = np.concatenate([[0], np.cumsum(size)])
                value, at = np.unique(np.concatenate(sets), return_inverse=True)
                own, mark = label[lo:hi].copy(), np.zeros(len(value) + 1, bool)
                for i in np.flatnonzero(asks[lo:hi]).tolist():
                    mark[at[start[i] : start[i + 1]]] = True
                    both = np.concatenate([[0], np.cumsum(mark[at])])
                    both = both[start[1:]] - both[start[:-1]]
                    mark[at[start[i] : start[i + 1]]] = False
                    linked = np.flatnonzero((100 * both >= percent * (size + size[i] - both)) & (both > 0) & (own != own[i]))
                    for j in linked.tolist():
                        if own[j] != own[i]:
                            u.append(node[lo + i])
                            v.append(node[lo + j])
                            own[own == own[j]] = own[i]
            if u:
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return run


def text_sets(tokens: Tokens, column, words: int) -> list[np.ndarray]:
    out = []
    for _, _, data, off in tokens.blocks(column):
        h, _, _, first = tokens.words(data, off)
        h, start = row_sets(*shingle_hashes(h, first, words))
        out += [h[x:y] for x, y in zip(start[:-1].tolist(), start[1:].tolist())]
    return out


def confirm(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Those of pairs(u, v) whose whole sets are alike enough. texts(node, text)."""

    def check(batches):
        import pyarrow as pa

        tokens = Tokens(BLANKS)

        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                b, keep = batch.slice(lo, 500), []
                for x, y in zip(text_sets(tokens, b.column(2), words), text_sets(tokens, b.column(3), words)):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(100 * both >= percent * (len(x) + len(y) - both) and both > 0)
                yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(keep, pa.bool_())), b.column(1).filter(pa.array(keep, pa.bool_()))], ["u", "v"])

    # both joins shuffle the texts alike, and a node with many pairs is split where Spark finds its partition large
    left = pairs.where("u < v").distinct().join(texts.select(F.col("node").alias("v"), F.col("text").alias("text_v")), "v")
    both = left.join(texts.select(F.col("node").alias("u"), F.col("text").alias("text_u")), "u")
    return both.select("u", "v", "text_u", "text_v").mapInArrow(check, "u long, v long")


def dealt(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """rows(leaf, node, sketch) with their chunk: 0, or from 1 in leaves of hot(leaf, chunks)."""
    chunk = F.when(F.col("chunks").isNull(), 0).otherwise(F.pmod(F.xxhash64("node"), F.col("chunks")) + 1).cast("int")
    return rows.join(hot, "leaf", "left").withColumn("chunk", chunk).drop("chunks")


def labelled(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """edges(a, b) as pairs (u, v) of the labels of their ends, where these differ."""
    named = edges.select("a", "b").join(labels.select(F.col("node").alias("a"), F.col("root").alias("u")), "a", "left")
    named = named.join(labels.select(F.col("node").alias("b"), F.col("root").alias("v")), "b", "left")
    return named.select(F.coalesce("u", "a").alias("u"), F.coalesce("v", "b").alias("v")).where("u <> v").distinct()


def edges_of_chunks(rows: DataFrame, hot: DataFrame, family: DataFrame, n: int) -> DataFrame:
    """Edges(a, b) from members outside the family of most of their hot leaf to members of other families in all its chunks.

    rows(leaf, node, sketch) of hot leaves, hot(leaf, chunks), family(node, family).
    """
    own = dealt(rows, hot).join(family, "node", "left").withColumn("family", F.coalesce("family", "node"))
    own = materialise(own.select("leaf", "chunk", "node", "sketch", "family"), "hot-members")
    main = own.groupBy("leaf", "family").count().groupBy("leaf").agg(F.max_by("family", F.struct("count", "family")).alias("main"), F.count("*").alias("families"))
    mixed = own.join(main.where("families > 1"), "leaf")
    asking = mixed.where("family <> main").join(hot, "leaf").withColumn("chunk", F.explode(F.sequence(F.lit(1), F.col("chunks").cast("int"))))
    cols = ["leaf", "chunk", "node", "sketch", "family"]
    both = mixed.select(*cols, F.lit(False).alias("asks")).union(asking.select(*cols, F.lit(True)))
    found = both.repartition(n, "leaf", "chunk").sortWithinPartitions("leaf", "chunk", "node").mapInArrow(ask_chunks, "a long, b long")
    found = materialise(found.distinct(), "hot-edges")
    discard(own)
    return found


def links_of_families(members: DataFrame, texts: DataFrame, words: int, percent: int, n: int) -> DataFrame:
    """Step 3. members(family, label, node), texts(node, text): links (u, v) between components of one family."""
    rows = members.join(texts, "node").withColumn("bytes", F.octet_length("text").cast("long"))
    rows = materialise(rows.select("family", "label", "node", "text", "bytes"), "families")
    by_label = rows.groupBy("family", "label").agg(F.count("*").alias("rows"), F.sum("bytes").alias("bytes"))
    top = F.max(F.struct("rows", "bytes", "label"))
    sizes = by_label.groupBy("family").agg(top.alias("main"), F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"))
    blocks = lambda rows, most, bytes_, bound: F.greatest(F.lit(1), F.ceil(rows / most), F.ceil(bytes_ / bound)).cast("int")
    sizes = sizes.select(
        "family",
        F.col("main.label").alias("main"),
        blocks(F.col("rows") - F.col("main.rows"), ASK_ROWS, F.col("bytes") - F.col("main.bytes"), ASK_BYTES).alias("ask_blocks"),
        blocks(F.col("rows"), BLOCK_ROWS, F.col("bytes"), BLOCK_TEXT).alias("blocks"),
    )
    sized = rows.join(sizes, "family")
    asked = sized.withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int")).withColumn("ask_block", F.explode(F.sequence(F.lit(0), F.col("ask_blocks") - 1)))
    asking = sized.where("label <> main").withColumn("ask_block", F.pmod(F.xxhash64("node"), "ask_blocks").cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cols = ["family", "ask_block", "block", "node", "label", "text"]
    both = asked.select(*cols, F.lit(False).alias("asks")).union(asking.select(*cols, F.lit(True)))
    found = both.repartition(n, "family", "ask_block", "block").sortWithinPartitions("family", "ask_block", "block", "node")
    found = materialise(found.mapInArrow(compare_blocks(words, percent), "u long, v long"), "links")
    discard(rows)
    return found


def link_documents(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    n = parallelism(docs)
    docs = columns(docs, doc_id="long", text="string")
    signed = materialise(docs.mapInArrow(sign(words), SIGNED), "signed")
    key = ["s1", "s2", "n_shingles"]
    classes = signed.where("doc_id is not null and n_shingles > 0").groupBy(*key).agg(F.min("doc_id").alias("node"), F.first("sig").alias("sig"), F.first("sketch").alias("sketch"))
    classes = materialise(classes, "classes")

    counts = classes.select("sig").mapInArrow(only_leaves, "leaf long").groupBy("leaf").count()
    hot = materialise(counts.where(F.col("count") > HOT).select("leaf", F.ceil(F.col("count") / HOT).alias("chunks")), "hot")
    any_hot = bool(hot.head(1))
    rows = classes.select("node", "sig", "sketch").mapInArrow(leaf_rows, "leaf long, node long, sketch binary")
    placed = rows.withColumn("chunk", F.lit(0)).withColumn("rank", F.lit(1))
    if any_hot:
        hot_rows = materialise(rows.join(hot.select("leaf"), "leaf", "left_semi"), "hot-rows")
        some = hot_rows.groupBy("leaf", F.pmod(F.xxhash64("node"), F.lit(PIVOTS)).alias("turn")).agg(F.min(F.struct("node", "sketch")).alias("x"))
        pivots = some.join(hot, "leaf").select("leaf", "x.node", "x.sketch", F.explode(F.sequence(F.lit(1), F.col("chunks").cast("int"))).alias("chunk"), F.lit(0).alias("rank"))
        placed = dealt(rows, hot).withColumn("rank", F.lit(1)).unionByName(pivots)
    placed = placed.select("leaf", "chunk", "rank", "node", "sketch").repartition(n, "leaf", "chunk").sortWithinPartitions("leaf", "chunk", "rank", "node")
    near = placed.mapInArrow(forest, "a long, b long, same int")
    edges = materialise(near.groupBy("a", "b").agg(F.max("same").alias("same")), "near")

    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    if any_hot:
        nodes = nodes.union(hot_rows.select("node")).distinct()
    nodes = materialise(nodes, "nodes")
    texts = materialise(docs.withColumnRenamed("doc_id", "node").join(nodes, "node", "left_semi"), "texts")
    nearest = edges.groupBy("a").agg(F.max_by("b", F.struct("same", -F.col("b"))).alias("b"))
    links = materialise(confirm(nearest.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")), texts, words, percent), "links")
    labels = components(links)

    apart = materialise(labelled(edges, labels), "apart")
    families = components(apart)
    if any_hot:
        family = labels.join(families.select(F.col("node").alias("root"), F.col("root").alias("family")), "root", "left").select("node", F.coalesce("family", "root").alias("family"))
        more = edges_of_chunks(hot_rows, hot, family.union(families.join(labels.select("node"), "node", "left_anti").select("node", "root")), n)
        wider = components(labelled(more, labels).union(families))  # families, as stars, for their own edges
        discard(families, hot_rows, more)
        families = wider
    label = F.coalesce("root", "node").alias("label")
    members = nodes.join(labels, "node", "left").select("node", label).join(families.select(F.col("node").alias("label"), F.col("root").alias("family")), "label")
    joining = links_of_families(members, texts, words, percent, n) if families.head(1) else families.toDF("u", "v")
    roots = components(labelled(joining.toDF("a", "b"), labels))
    merged = roots.select(F.col("node").alias("root"), F.col("root").alias("merged"))
    # a component's label is its smallest node, so the least of merged labels is the smallest node of all
    singles = merged.join(labels.select("root").distinct(), "root", "left_anti").select(F.col("root").alias("node"), F.col("merged").alias("component_id"))
    found = labels.join(merged, "root", "left").select("node", F.coalesce("merged", "root").alias("component_id")).union(singles)

    ids = classes.select(*key, "node").join(found, "node", "left").select(*key, F.coalesce("component_id", "node").alias("component_id"))
    # a document that has rows of several sets is one node only under its own id, so links go by id as well
    own = signed.where("doc_id is not null and n_shingles > 0").select(*key, "doc_id").join(ids, key).groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    own = materialise(own, "found")
    discard(classes, hot, edges, nodes, texts, links, labels, apart, families, joining, roots)
    out = signed.select("doc_id", "n_shingles").join(own, "doc_id", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    return link_documents(table(spark, sf_dir, "documents"), words=2)


ORACLE_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(w) >= 2 THEN list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) ELSE w END) AS sh FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
inter AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT u, v FROM inter JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 80 * (x.n + y.n - c)),
both_ways AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e),
reach AS (SELECT doc_id, doc_id AS root FROM d UNION SELECT b.v, r.root FROM reach r JOIN both_ways b ON b.u = r.doc_id),
comp AS (SELECT doc_id, min(root) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d JOIN comp ON comp.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
