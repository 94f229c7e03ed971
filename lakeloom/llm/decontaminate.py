"""Benchmark decontamination: an FM-index for each shard of training documents, searched backwards for test phrases.

Words are lower-cased runs of ASCII letters, digits and non-ASCII bytes. A window is so many consecutive words of a
benchmark item, or all words of a shorter item. Documents reach a task in batches; each makes a shard (of at most
SHARD_SYMBOLS words that the benchmark knows; words it doesn't know can be in no window and only separate). A shard's
suffixes are sorted, its Burrows-Wheeler transform goes into a wavelet matrix, all windows are searched backwards at
once by wavelet ranks, and occurrences are located by walking to sampled suffix positions. Spans of occurrences are
merged; a document word inside any is hit.

Windows go out in blocks of at most BLOCK_WINDOWS, so a broadcast is bounded; a benchmark of more than
BLOCKS_AT_ONCE blocks is searched in several passes, whose spans are merged per document.

Defined cases: null has no words and is never contaminated; an item without words has no window; windows of an item
whose id is null count as hits, but not as items; repeated item rows are one item, repeated documents give a row
each; empty tables give no hits, or no rows; other columns go.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import PUNCTUATION, Tokens, carried, carried_schema, columns, lean, table, with_carried

WINDOW, SHARD_SYMBOLS, BLOCK_WINDOWS, BLOCKS_AT_ONCE, SAMPLE = 10, 1 << 18, 100_000, 8, 16
FOUND = "n_words long, hits array<struct<a:int,b:int,byte_a:int,byte_b:int>>, items array<string>"


class Wavelet:
    """A wavelet matrix over small numbers: rank(c, i) counts c among the first i, for whole arrays of c and i."""

    def __init__(self, seq: np.ndarray, bits: int):
        self.bits, self.levels = bits, []
        for k in range(bits - 1, -1, -1):
            bit = (seq >> k) & 1
            ones = np.concatenate([[0], np.cumsum(bit)]).astype(np.int64)
            self.levels.append((k, ones, len(seq) - int(ones[-1])))
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        lo = np.zeros_like(i)
        for k, ones, zeros in self.levels:
            one = ((c >> k) & 1) == 1
            i = np.where(one, zeros + ones[i], i - ones[i])
            lo = np.where(one, zeros + ones[lo], lo - ones[lo])
        return i - lo


class FmIndex:
    """Over runs of symbols 1..top, each run ended by a separator of its own (0 in seq)."""

    def __init__(self, seq: np.ndarray, top: int):
        n, stops = len(seq), np.flatnonzero(seq == 0)
        rank = seq + len(stops) - 1
        rank[stops] = np.arange(len(stops))
        width = 1
        while True:  # sort suffixes by prefixes of doubled width; separators all differ, so this ends within the longest run
            nxt = np.full(n, -1)
            nxt[: n - width] = rank[width:] if width < n else nxt[:0]
            order = np.lexsort((nxt, rank))
            fresh = np.ones(n, bool)
            fresh[1:] = (rank[order][1:] != rank[order][:-1]) | (nxt[order][1:] != nxt[order][:-1])
            rank[order] = np.cumsum(fresh) - 1
            if fresh.all() or width >= n:
                break
            width *= 2
        bwt = np.where(order > 0, seq[order - 1], 0)
        self.n, self.bwt = n, bwt
        self.wavelet = Wavelet(bwt, max(1, int(top).bit_length()))
        self.first = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=top + 1))])[: top + 1]
        first_of_run = np.concatenate([[True], seq[:-1] == 0])
        kept = (np.arange(n) % SAMPLE == 0) | first_of_run
        self.kept = kept[order]
        self.kept_before = np.concatenate([[0], np.cumsum(self.kept)])
        self.samples = order[self.kept]

    def search(self, phrases: np.ndarray, size: np.ndarray):
        """phrases: rows of symbols, filled up at the end. Returns the row ranges [lo, hi) of each."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for back in range(1, phrases.shape[1] + 1):
            on = np.flatnonzero((size >= back) & (lo < hi))
            if not len(on):
                continue
            c = phrases[on, size[on] - back]
            lo[on] = self.first[c] + self.wavelet.rank(c, lo[on])
            hi[on] = self.first[c] + self.wavelet.rank(c, hi[on])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of the suffixes at these rows."""
        rows, steps, out = rows.copy(), np.zeros(len(rows), np.int64), np.empty(len(rows), np.int64)
        todo = np.arange(len(rows))
        while len(todo):
            at = rows[todo]
            done = self.kept[at]
            out[todo[done]] = self.samples[self.kept_before[at[done]]] + steps[todo[done]]
            todo, at = todo[~done], at[~done]
            c = self.bwt[at]
            rows[todo] = self.first[c] + self.wavelet.rank(c, at)
            steps[todo] += 1
        return out


def item_windows(benchmark: DataFrame, window: int) -> DataFrame:
    """Distinct (item_id, w): w is a window's word hashes, eight bytes each."""

    def cut(batches):
        import pyarrow as pa

        tokens = Tokens(PUNCTUATION)
        for b in batches:
            ids, out = b.column(0).to_pylist(), []
            for lo, hi, data, off in tokens.blocks(b.column(1)):
                h, _, _, first = tokens.words(data, off)
                for r in range(lo, hi):
                    own = h[first[r - lo] : first[r - lo + 1]]
                    out += [(ids[r], own[k : k + window].tobytes()) for k in range(max(1, len(own) - window + 1)) if len(own)]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.binary())], ["item_id", "w"])

    return columns(benchmark, item_id="string", text="string").mapInArrow(cut, "item_id string, w binary").distinct()


class Block:
    """One broadcast block of windows: its words' hashes in order, the windows as symbols, and their items."""

    def __init__(self, rows: list[tuple[bytes, list[str]]]):
        words = [np.frombuffer(w, np.uint64) for w, _ in rows]
        self.vocabulary = np.unique(np.concatenate(words))
        self.size = np.array([len(w) for w in words])
        self.phrases = np.zeros((len(rows), self.size.max()), np.int64)
        for i, w in enumerate(words):
            self.phrases[i, : len(w)] = np.searchsorted(self.vocabulary, w) + 1
        self.items = [items for _, items in rows]


def window_blocks(windows: DataFrame) -> list:
    """The windows as broadcast variables, each of BLOCK_WINDOWS at most (twice that, if hashes fall unevenly)."""
    n = windows.select("w").distinct().count()
    blocks = -(-n // BLOCK_WINDOWS)
    grouped = windows.groupBy("w").agg(F.collect_set("item_id").alias("items")).withColumn("block", F.pmod(F.xxhash64("w"), F.lit(max(1, blocks))))
    out = []
    for k in range(blocks):
        rows = [(bytes(r["w"]), list(r["items"])) for r in grouped.where(F.col("block") == k).collect()]
        if rows:
            out.append(windows.sparkSession.sparkContext.broadcast(Block(rows)))
    return out


def search_shard(block: Block, h: np.ndarray, first: np.ndarray):
    """h: word hashes of a shard's documents, first: where each begins. Returns hit flags of the words, and (row, window) pairs."""
    at = np.searchsorted(block.vocabulary, h)
    at[at == len(block.vocabulary)] = 0
    known = block.vocabulary[at] == h
    # runs of known words, broken at documents' first words; those shorter than the shortest window go
    begin = known.copy()
    begin[1:] &= ~known[:-1]
    heads = first[:-1][first[:-1] < len(h)]
    begin[heads] = known[heads]
    starts = np.flatnonzero(begin)
    breaks = np.unique(np.concatenate([np.flatnonzero(~known), heads, [len(h)]]))
    ends = breaks[np.searchsorted(breaks, starts, "right")] if len(starts) else starts
    long = ends - starts >= block.size.min()
    starts, ends = starts[long], ends[long]
    hit = np.zeros(len(h), bool)
    none = np.zeros(0, np.int64)
    if not len(starts):
        return hit, none, none
    sizes = ends - starts
    place = np.concatenate([[0], np.cumsum(sizes + 1)])
    where = np.repeat(starts - place[:-1], sizes + 1) + np.arange(place[-1])  # the word at each position of seq
    seq = np.zeros(place[-1], np.int64)
    inner = np.ones(place[-1], bool)
    inner[place[1:] - 1] = False
    seq[inner] = at[where[inner]] + 1
    index = FmIndex(seq, len(block.vocabulary))
    lo, hi = index.search(block.phrases, block.size)
    found = np.flatnonzero(lo < hi)
    many = (hi - lo)[found]
    which = np.repeat(found, many)
    rows = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lo[found], many)
    word = where[index.locate(rows)]
    edge = np.zeros(len(h) + 1, np.int64)
    np.add.at(edge, word, 1)
    np.add.at(edge, word + block.size[which], -1)
    hit = np.cumsum(edge[:-1]) > 0
    doc = np.searchsorted(first, word, "right") - 1
    pairs = np.unique(np.stack([doc, which]), axis=1)
    return hit, pairs[0], pairs[1]


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, carry: list[str] | None = None) -> DataFrame:
    """One row per document: the columns in carry (doc_id, if none are given), n_words, hits (merged spans, as word and byte ranges), items."""
    blocks = window_blocks(item_windows(benchmark, window))

    several = len(blocks) > BLOCKS_AT_ONCE
    own = carry or ["doc_id"]
    sent = list(dict.fromkeys([*own, "text"])) if several else own

    def searched(some):
        def search(batches):
            import pyarrow as pa

            tokens = Tokens(PUNCTUATION)

            def shard(batch, parts):
                """parts: (words, start bytes, end bytes, first word of each row) of consecutive blocks of rows."""
                h, s, e = (np.concatenate([p[k] for p in parts]) for k in range(3))
                first = np.concatenate([[0], *[p[3][1:] + base for p, base in zip(parts, np.cumsum([0] + [len(p[0]) for p in parts]))]])
                hit, items = np.zeros(len(h), bool), [set() for _ in range(batch.num_rows)]
                for b in some:
                    flags, doc, which = search_shard(b.value, h, first)
                    hit |= flags
                    for d, w in zip(doc.tolist(), which.tolist()):
                        items[d].update(b.value.items[w])
                spans = [[] for _ in range(batch.num_rows)]
                on = hit.copy()
                on[1:] &= ~hit[:-1]
                heads = first[:-1][first[:-1] < len(h)]
                on[heads] = hit[heads]
                begins = np.flatnonzero(on)
                breaks = np.unique(np.concatenate([np.flatnonzero(~hit), heads, [len(h)]])).astype(np.int64)
                ends = breaks[np.searchsorted(breaks, begins, "right")] if len(begins) else begins
                for a, z in zip(begins.tolist(), ends.tolist()):
                    d = int(np.searchsorted(first, a, "right")) - 1
                    spans[d].append({"a": a - int(first[d]), "b": z - int(first[d]), "byte_a": int(s[a]), "byte_b": int(e[z - 1])})
                kind = pa.list_(pa.struct([(k, pa.int32()) for k in ("a", "b", "byte_a", "byte_b")]))
                found = pa.array(np.diff(first), pa.int64()), pa.array(spans, kind), pa.array([sorted(x) for x in items], pa.list_(pa.string()))
                return carried(batch, *found, names=["n_words", "hits", "items"])

            for b in batches:
                parts, begin, total = [], 0, 0
                for lo, hi, data, off in tokens.blocks(b.column(0)):
                    h, s, e, first = tokens.words(data, off)
                    base = np.repeat(off[:-1], np.diff(first))
                    parts.append((h, s - base, e - base, first))
                    total += len(h)
                    if total >= SHARD_SYMBOLS or hi == b.num_rows:
                        yield shard(b.slice(begin, hi - begin), parts)
                        parts, begin, total = [], hi, 0

        return with_carried(docs, sent).mapInArrow(lean(search), carried_schema(docs, sent, FOUND))

    passes = [searched(blocks[k : k + BLOCKS_AT_ONCE]) for k in range(0, max(1, len(blocks)), BLOCKS_AT_ONCE)]
    return merged_passes(passes, own) if several else passes[0]


def merged_passes(passes: list[DataFrame], own: list[str]) -> DataFrame:
    """Several passes over the same documents as one: spans merged, items united; equal rows stay as many as they were."""
    parts = [p.select(*own, F.xxhash64("text").alias("same"), "n_words", "hits", "items", F.lit(k).alias("pass")) for k, p in enumerate(passes)]
    every = parts[0]
    for p in parts[1:]:
        every = every.union(p)
    grouped = every.groupBy(*own, "same", "n_words").agg(
        F.array_sort(F.flatten(F.collect_set("hits"))).alias("hits"),
        F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"),
        F.sum((F.col("pass") == 0).cast("int")).alias("copies"),
    )
    merged = F.expr(
        "aggregate(hits, cast(array() as array<struct<a:int,b:int,byte_a:int,byte_b:int>>), (acc, x) -> case when size(acc) > 0 and element_at(acc, -1).b >= x.a"
        " then concat(slice(acc, 1, size(acc) - 1), array(named_struct('a', element_at(acc, -1).a, 'b', greatest(element_at(acc, -1).b, x.b), 'byte_a', element_at(acc, -1).byte_a,"
        " 'byte_b', greatest(element_at(acc, -1).byte_b, x.byte_b)))) else concat(acc, array(x)) end)"
    )
    grouped = grouped.withColumn("hits", merged).withColumn("_c", F.explode(F.sequence(F.lit(1), "copies")))
    return grouped.select(*own, "n_words", "hits", "items")


def query(spark, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda acc, x: acc + (x["b"] - x["a"]))
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
occ AS (SELECT doc_id, i, dw.n AS n, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM occ) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM occ GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN its ON d.doc_id = its.doc_id
"""
