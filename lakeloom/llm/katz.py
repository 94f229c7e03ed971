"""LM scoring: a Katz backoff model of words, Good-Turing discounted, with exactly normalised backoff weights.

Tokens are a text's words and one end. Every token and every pair of tokens (the start is a history) of the training
documents is counted. Counts up to GT_MAX are discounted by Good-Turing (where the counts of counts allow it, else by
one half); larger counts lose ABSOLUTE, so that every history keeps mass for words not seen after it. What discounting
frees goes to the words not seen after the history in proportion to their unigrams, and at the lowest level to the
unknown word:

    P(w | h) = d(c) c(h w) / c(h)    if the bigram has been seen
             = a(h) P(w)             otherwise, with a(h) = 1 for histories that have not been seen

The model's tables are partitioned: words by word, histories by history, bigrams by bucket (of the history; of the
pair for histories of SPLIT tokens or more; of the word for rare words). No task sees a whole table. Documents are
read in groups of about GROUP tokens. A group asks each bucket for its distinct bigrams, with its own counts of them
from training documents, so one shuffle both sums the counts and carries the questions; a bucket replies with a count
for each in the same order. Bigrams that were not seen back off: their word's probability meets its history's weight
by a join. Then each group adds up, token by token, what its documents score. A bigram takes part once a group however
often it stands there, so a frequent one is no hot key.

Words of at least SENT_SHARE of the tokens (at most 1 / SENT_SHARE) are sent to all tasks with their counts, and are
numbers in the questions; rarer ones are hashes and counted in the buckets. That decides only where a value comes
from; the model and the scores don't depend on it.

Defined cases: null is an empty text, which has the end as its one token; repeated rows give a row each and count
each for training; null and shared ids are allowed (training rows by the checksum of the id as text, null as the empty
text); a very long text makes a group of its own; without training rows the unknown word has probability 1; an empty
table gives an empty result; other columns go.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import BLANKS, Tokens, columns, crc_mod, delete_path, discard, materialise, mix, pair_hash, parallelism, shared_dir, table

SENT_SHARE = 3e-7
GT_MAX, ABSOLUTE = 5, 0.05
END, START = np.uint64(1), np.uint64(2)
#: Tokens of a group of documents and, about, of a bucket of bigrams; histories of as many tokens as SPLIT are dealt to several buckets.
GROUP, BUCKET, SPLIT = 1 << 21, 1 << 21, 1 << 20
#: Codes of rare words have this bit; those of words sent to all are their places.
RARE = np.uint64(1 << 63)


def discounts(counts_of_counts: dict[int, int]) -> list[float]:
    """d[r] for r = 1 .. GT_MAX (d[0] is unused): Katz's form of Good-Turing, or (r - 1/2) / r where that isn't in (0, 1)."""
    n = [0] + [counts_of_counts.get(r, 0) for r in range(1, GT_MAX + 2)]
    out = [0.0]
    cut = (GT_MAX + 1) * n[GT_MAX + 1] / n[1] if n[1] else 1.0
    for r in range(1, GT_MAX + 1):
        d = ((r + 1) * n[r + 1] / (r * n[r]) - cut) / (1 - cut) if n[r] and cut < 1 else 0.0
        out.append(d if 0.0 < d < 1.0 else (r - 0.5) / r)
    return out


def discounted(c, d: list[float]):
    """Column or array: the count after discounting."""
    if isinstance(c, np.ndarray):
        return np.where(c > GT_MAX, c - ABSOLUTE, c * np.array(d)[np.minimum(c, GT_MAX).astype(np.int64)])
    out = F.when(c > GT_MAX, c - ABSOLUTE)
    for r in range(1, GT_MAX + 1):
        out = out.when(c == r, r * d[r])
    return out.otherwise(0.0)


class Vocabulary:
    """Words common enough to be sent to all: hashes in order, counts, log10 of their unigram probabilities."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, total: int, distinct: int, starts: int, d: list[float], unknown: float):
        order = np.argsort(words)
        self.words, self.counts = words[order], counts[order]
        self.total, self.distinct, self.d = total, distinct, d
        self.start = np.uint64(len(words))  # the start's code as a history
        self.p = discounted(self.counts, d) / max(1, total)
        self.unknown = unknown
        self.log_c = np.log10(np.maximum(1, np.append(self.counts, starts)))  # by code, the start among them
        self.split = np.append(self.counts, starts) >= SPLIT
        self.split[-1] = True

    def codes(self, h: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return h | RARE
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        return np.where(self.words[at] == h, at.astype(np.uint64), h | RARE)

    def log_p(self, w: np.ndarray, count: np.ndarray) -> np.ndarray:
        """log10 P(w) by code; count is that of rare words, 0 for unknown ones."""
        return np.log10(np.maximum(1e-300, self.prob(w, count)))

    def prob(self, w: np.ndarray, count: np.ndarray) -> np.ndarray:
        rare = (w & RARE) > 0
        out = np.where(count > 0, discounted(count, self.d) / max(1, self.total), self.unknown)
        out[~rare] = self.p[w[~rare].astype(np.int64)]
        return out


def planes(x: np.ndarray) -> bytes:
    """The bytes of numbers, all first ones, then all second ones: high bytes are alike, so they compress."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


class Packed:
    """Reads arrays back in the order in which planes() wrote them."""

    def __init__(self, raw: bytes):
        self.raw, self.at = np.frombuffer(raw, np.uint8), 0

    def take(self, n: int, kind) -> np.ndarray:
        size = np.dtype(kind).itemsize
        x = self.raw[self.at : self.at + n * size].reshape(size, n)
        self.at += n * size
        return np.ascontiguousarray(x.T).reshape(-1).view(kind)


def sequences(tokens: Tokens, column):
    """Blocks of rows: (first row, row after the last, tokens with ends, places of the ends, row of each token)."""
    for lo, hi, data, off in tokens.blocks(column):
        h, _, _, first = tokens.words(data, off)
        n = np.diff(first) + 1
        yield lo, hi, np.insert(np.where(h <= START, h + np.uint64(7), h), first[1:], END), np.cumsum(n) - 1, np.repeat(np.arange(hi - lo), n)


def count_words(batches):
    import pyarrow as pa

    def summed(parts):
        w, c = np.unique(np.concatenate(parts), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(c, pa.int64())], ["w", "c"])

    tokens, parts, size = Tokens(BLANKS), [], 0
    for b in batches:
        for _, _, t, _, _ in sequences(tokens, b.column(0)):
            parts.append(t)
            size += len(t)
            if size >= GROUP:
                yield summed(parts)
                parts, size = [], 0
    if parts:
        yield summed(parts)


def after_start(x: np.ndarray, ends: np.ndarray, start) -> np.ndarray:
    """Of each token: the value in x of the one before it in its text, or start."""
    out = np.empty_like(x)
    out[1:] = x[:-1]
    out[0] = start
    out[ends[:-1] + 1] = start
    return out


def ask(vocabulary, buckets: int):
    """Rows of (doc_id, text, training) to groups: a row of its documents (kind 0), and one for each bucket it asks (kind 1)."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        tokens, v, made = Tokens(BLANKS), vocabulary.value, 0

        def group(parts):
            nonlocal made
            g = (TaskContext.get().partitionId() << 32) + made
            made += 1
            ids, none, train, code, ends, counts = zip(*parts)
            h = np.concatenate([after_start(c, e, v.start) for c, e in zip(code, ends)])
            w, n = np.concatenate(code), np.concatenate(counts)
            train = np.repeat(np.concatenate(train), n)
            start = np.concatenate([[0], np.cumsum(n)[:-1]])
            rare_w, rare_h = (w & RARE) > 0, (h & RARE) > 0
            key = np.where(rare_w | rare_h, pair_hash(h, w) | RARE, (h << np.uint64(32)) | w)
            key, first, place = np.unique(key, return_index=True, return_inverse=True)
            count = np.bincount(place, train, len(key)).astype(np.uint32)
            h1, w1 = h[first], w[first]
            by_pair = (h1 & RARE) == 0
            by_pair[by_pair] = v.split[h1[by_pair].astype(np.int64)]
            bucket = (mix(np.where((w1 & RARE) > 0, w1, np.where(by_pair, key, h1))) % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order), dtype=np.uint32)
            key, h1, w1, count, bucket = key[order], h1[order], w1[order], count[order], bucket[order]
            known = ~rare_w
            log_count = np.zeros(len(w))
            log_count[known] = np.log10(v.counts[w[known].astype(np.int64)] + 1.0)
            log_h = np.zeros(len(w))
            log_h[~rare_h] = -v.log_c[h[~rare_h].astype(np.int64)]
            total = lambda x: np.add.reduceat(x, start)
            docs = [np.array([len(n), len(w)], np.int64), np.concatenate(ids), np.concatenate(none), n, total(known.astype(np.int64)), total(log_count), total(log_h), rank[place]]
            rows = [(0, -1, b"".join(map(planes, docs)))]
            cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(bucket)]):
                mid = lo + int(np.searchsorted(key[lo:hi], RARE))  # known pairs come first
                sizes = np.array([mid - lo, hi - mid], np.int64)
                rows.append((1, int(bucket[lo]), b"".join(map(planes, [sizes, np.diff(key[lo:mid], prepend=np.uint64(0)), h1[mid:hi], w1[mid:hi], count[lo:hi]]))))
            kind, at, blob = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), g, np.int64)), pa.array(kind, pa.int32()), pa.array(at, pa.int32()), pa.array(blob, pa.binary())], ["g", "kind", "bucket", "blob"])

        parts, size = [], 0
        for b in batches:
            ids, train = b.column(0), np.array(b.column(2)).astype(np.uint8)
            none = np.array(ids.is_null()).astype(np.uint8)
            ids = ids.fill_null(0).to_numpy()
            for lo, hi, t, ends, _ in sequences(tokens, b.column(1)):
                parts.append((ids[lo:hi], none[lo:hi], train[lo:hi], v.codes(t), ends, np.diff(ends, prepend=-1).astype(np.int64)))
                size += len(t)
                if size >= GROUP:
                    yield group(parts)
                    parts, size = [], 0
        if parts:
            yield group(parts)

    return run


REPLIES = "kind int, g long, bucket int, blob binary, place int, h long, value double, seen boolean, n array<long>, c_h long"


def reply(vocabulary):
    """Rows asked, sorted by (bucket, g). Kind 1 gives counts in the order asked, kind 2 a bigram that needs its history, kind 3 sums by history."""

    def run(batches):
        import pyarrow as pa

        v = vocabulary.value

        def rows(kind, many, **found):
            out = []
            for name, t in (("g", pa.int64()), ("bucket", pa.int32()), ("blob", pa.binary()), ("place", pa.int32()), ("h", pa.int64()), ("value", pa.float64()), ("seen", pa.bool_()), ("n", pa.list_(pa.int64())), ("c_h", pa.int64())):
                x = found.get(name)
                out.append(pa.nulls(many, t) if x is None else x if isinstance(x, pa.Array) else pa.array(x, t))
            return pa.RecordBatch.from_arrays([pa.array(np.full(many, kind, np.int32)), *out], ["kind", "g", "bucket", "blob", "place", "h", "value", "seen", "n", "c_h"])

        def bucket(at: int, asked: list[tuple[int, bytes]]):
            keys, hs, ws, counts, sizes = [], [], [], [], []
            for _, raw in asked:
                x = Packed(raw)
                a, b = x.take(2, np.int64).tolist()
                key = np.cumsum(x.take(a, np.uint64), dtype=np.uint64)
                h, w = x.take(b, np.uint64), x.take(b, np.uint64)
                keys.append(np.concatenate([key, pair_hash(h, w) | RARE]))
                hs.append(np.concatenate([key >> np.uint64(32), h]))
                ws.append(np.concatenate([key & np.uint64(0xFFFFFFFF), w]))
                counts.append(x.take(a + b, np.uint32))
                sizes.append((a, b))
            key, first, place = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
            h, w = np.concatenate(hs)[first], np.concatenate(ws)[first]
            c = np.bincount(place, np.concatenate(counts), len(key)).astype(np.int64)
            rare = (w & RARE) > 0
            c_w = np.zeros(len(key), np.int64)  # of rare words, all of whose bigrams are here
            if rare.any():
                _, to = np.unique(w[rare], return_inverse=True)
                c_w[rare] = np.bincount(to, c[rare]).astype(np.int64)[to]
            lo = 0
            for (g, _), (a, b) in zip(asked, sizes):
                mine = place[lo : lo + a + b]
                lo += a + b
                blob = [np.array([a, b], np.int64), c[mine].astype(np.uint32), c_w[mine[a:]].astype(np.uint32)]
                yield rows(1, 1, g=[g], bucket=[at], blob=[b"".join(map(planes, blob))])
                open_ = np.flatnonzero((c[mine] == 0) | ((h[mine] & RARE) > 0))
                if len(open_):
                    u = mine[open_]
                    seen = c[u] > 0
                    value = np.where(seen, 0.0, v.log_p(w[u], c_w[u]))
                    yield rows(2, len(u), g=np.full(len(u), g), bucket=np.full(len(u), at), place=open_, h=h[u].view(np.int64), value=value, seen=seen)
            on = c > 0
            if on.any():
                h, c, p = h[on], c[on], v.prob(w[on], c_w[on])
                own, to = np.unique(h, return_inverse=True)
                n = np.stack([np.bincount(to, c == r, len(own)) for r in range(1, GT_MAX + 2)] + [np.bincount(to, c > GT_MAX + 1, len(own))], axis=1).astype(np.int64)
                lists = pa.ListArray.from_arrays(np.arange(len(own) + 1, dtype=np.int32) * (GT_MAX + 2), n.ravel())
                yield rows(3, len(own), h=own.view(np.int64), value=np.bincount(to, p, len(own)), n=lists, c_h=np.bincount(to, c, len(own)).astype(np.int64))

        at, asked = -1, []
        for b in batches:
            for g, k, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                if k != at:
                    if asked:
                        yield from bucket(at, asked)
                    at, asked = k, []
                asked.append((g, raw))
        if asked:
            yield from bucket(at, asked)

    return run


SCORED = "doc_id long, n_tokens long, n_known long, base double, score double"


def add_up(d: list[float]):
    """A group's documents (kind 0) with the replies to it: sums over each document's tokens."""

    def run(left, right):
        import pyarrow as pa

        right = right.sort_by([("bucket", "ascending"), ("kind", "ascending")])
        kind = right.column("kind").to_numpy()
        counts, known, base, offset, at = [], [], [], {}, 0
        said = right.filter(pa.array(kind == 1))
        for k, raw in zip(said.column("bucket").to_pylist(), said.column("blob").to_pylist()):
            x = Packed(raw)
            a, b = x.take(2, np.int64).tolist()
            counts.append(x.take(a + b, np.uint32))
            c_w = x.take(b, np.uint32)
            known.append(np.concatenate([np.zeros(a), c_w > 0]))
            base.append(np.concatenate([np.zeros(a), np.log10(c_w + 1.0)]))
            offset[k], at = at, at + a + b
        counts = np.concatenate(counts).astype(np.int64)
        value = np.log10(np.where(counts > 0, discounted(counts, d), 1.0))
        more = right.filter(pa.array(kind == 2))
        if more.num_rows:
            value[np.array([offset[k] for k in more.column("bucket").to_pylist()]) + more.column("place").to_numpy()] += more.column("value").to_numpy()
        known, base, out = np.concatenate(known), np.concatenate(base), []
        for raw in left.column("blob").to_pylist():
            x = Packed(raw)
            docs, size = x.take(2, np.int64).tolist()
            ids, none, n = x.take(docs, np.int64), x.take(docs, np.uint8), x.take(docs, np.int64)
            n_known, own_base, own = x.take(docs, np.int64), x.take(docs, np.float64), x.take(docs, np.float64)
            place = x.take(size, np.uint32)
            total = lambda y: np.add.reduceat(y[place], np.concatenate([[0], np.cumsum(n)[:-1]]))  # noqa: E731, B023
            out.append([pa.array(ids, mask=none > 0), pa.array(n), pa.array(n_known + total(known).astype(np.int64)), pa.array(own_base + total(base)), pa.array(own + total(value))])
        return pa.Table.from_arrays([pa.chunked_array(c) for c in zip(*out)], ["doc_id", "n_tokens", "n_known", "base", "score"])

    return run


def train_words(text: DataFrame):
    """The table of words, and the vocabulary for all tasks."""
    words = materialise(text.mapInArrow(count_words, "w long, c long").groupBy("w").agg(F.sum("c").alias("c")), "unigrams")
    sums = words.agg(F.sum("c"), F.count("*"), F.max(F.when(F.col("w") == int(END), F.col("c"))), *[F.sum((F.col("c") == r).cast("long")) for r in range(1, GT_MAX + 2)]).first()
    total, distinct, starts = int(sums[0] or 0), int(sums[1]), int(sums[2] or 0)
    d = discounts({r: int(sums[2 + r] or 0) for r in range(1, GT_MAX + 2)})
    kept = float(words.agg(F.sum(discounted(F.col("c"), d))).first()[0] or 0.0)
    common = words.where(F.col("c") >= SENT_SHARE * total).toArrow()  # at most 1 / SENT_SHARE
    v = Vocabulary(common["w"].to_numpy().view(np.uint64), common["c"].to_numpy(), total, distinct, starts, d, max(0.0, 1.0 - kept / total) if total else 1.0)
    return words, v


def score_documents(docs: DataFrame, training) -> DataFrame:
    """One row per document: doc_id, n_tokens, n_known, train_tokens, base_score, score. training: Column on doc_id."""
    spark, n = docs.sparkSession, parallelism(docs)
    docs = columns(docs, doc_id="long", text="string").withColumn("text", F.coalesce("text", F.lit(""))).withColumn("training", training)
    words, v = train_words(docs.where("training").select("text"))
    vocabulary = spark.sparkContext.broadcast(v)
    buckets = max(4 * n, -(-v.total // BUCKET))

    # written once, by group, so that questions and documents are of the same reading, and the groups' files are joined where they lie
    name, path = f"katz_{uuid.uuid4().hex}", f"{shared_dir(spark)}/lakeloom/katz-groups-{uuid.uuid4().hex}"
    asked = docs.select("doc_id", "text", "training").mapInArrow(ask(vocabulary, buckets), "g long, kind int, bucket int, blob binary")
    asked.write.partitionBy("kind").bucketBy(n, "g").option("compression", "zstd").option("path", path).saveAsTable(name)
    groups = spark.table(name)
    questions = groups.where("kind = 1").select("g", "bucket", "blob").repartition(n, "bucket").sortWithinPartitions("bucket", "g")
    replies = materialise(questions.mapInArrow(reply(vocabulary), REPLIES), "bigrams")
    delete_path(spark, f"{path}/kind=1")

    sums = replies.where("kind = 3").groupBy("h").agg(F.sum("c_h").alias("c_h"), F.sum("value").alias("mass"), *[F.sum(F.col("n")[r]).alias(f"n{r + 1}") for r in range(GT_MAX + 2)])
    sums = materialise(sums, "history-sums")
    found = sums.agg(*[F.sum(f"n{r}") for r in range(1, GT_MAX + 2)]).first()
    d2 = discounts({r: int(found[r - 1] or 0) for r in range(1, GT_MAX + 2)})
    free = sum((F.col(f"n{r}") * (r * (1 - d2[r])) for r in range(1, GT_MAX + 1)), (F.col(f"n{GT_MAX + 1}") + F.col(f"n{GT_MAX + 2}")) * ABSOLUTE)
    log_a = F.log10(F.greatest(F.lit(1e-300), free / F.col("c_h"))) - F.log10(F.greatest(F.lit(1e-300), 1.0 - F.col("mass")))
    histories = materialise(sums.select("h", F.log10("c_h").alias("log_c"), log_a.alias("log_a")), "histories")

    # a token was given 1 / c(h) where h is sent to all: rare histories get theirs here, and those backed off from give it back
    log_c = F.coalesce("log_c", F.lit(0.0))
    value = F.when(F.col("seen"), -log_c).otherwise(F.col("value") + F.coalesce("log_a", F.lit(0.0)) + F.when(F.col("h") < 0, 0.0).otherwise(log_c))
    opened = replies.where("kind = 2").select("g", "bucket", "place", "h", "value", "seen").join(histories, "h", "left")
    opened = opened.select("g", F.lit(2).alias("kind"), "bucket", F.lit(None).cast("binary").alias("blob"), "place", value.alias("value"))
    got = replies.where("kind = 1").select("g", "kind", "bucket", "blob", "place", "value").union(opened)
    scored = groups.where("kind = 0").select("g", "blob").groupBy("g").cogroup(got.groupBy("g")).applyInArrow(add_up(d2), SCORED)
    scored = materialise(scored, "scores")
    spark.sql(f"DROP TABLE {name}")
    delete_path(spark, path)
    discard(words, replies, sums, histories)
    base = F.col("base") - F.col("n_tokens") * math.log10(v.total + v.distinct + 1)
    return scored.select("doc_id", "n_tokens", "n_known", F.lit(v.total).cast("long").alias("train_tokens"), base.alias("base_score"), "score")


def query(spark, sf_dir: str) -> DataFrame:
    held_out = crc_mod(F.col("doc_id"), 7) == 2
    out = score_documents(table(spark, sf_dir, "documents"), ~held_out)
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
