"""Substring dedup: fuzzy passages that documents share, by collinear chaining of k-mer seeds.

Words are lower-cased runs of ASCII letters, digits and non-ASCII bytes. Of every SPAN consecutive K-word shingles the
one with the least hash is a seed, so an exact run of K + SPAN - 1 words always has one. Documents are dealt to CLASSES
by a hash of their id, and each occurrence of a seed is joined to the occurrence in the document with the smallest id
of each class (its centres, where they are smaller than its own), so a passage that thousands of documents share
gives CLASSES links a document, not all pairs. What centres leave is compared exactly: wherever a document shares a
seed and no aligned part lies over it, its pairs of seeds NEAR to FAR words apart are looked up among those of all
documents (see `rest_chains`). The links of two documents are chained: a Fenwick tree over the
centre's positions gives, for each link in order, the best chain that ends before it in both documents, less a cost
for the gap. Chains are aligned word by word (between seeds, and outwards from the ends), and kept if they hold at
least LEAST_PART words of which SIMILARITY are equal. Passages of one document that touch are taken together, so one
that is shared in parts with several centres isn't lost; at least LEAST words must come together.

Result: one row for each part: doc_id and other_id (the centre's; in a centre's own rows, which name each of its ranges
once, the smallest document's that shares it), word ranges in both (end exclusive), the number of
equal words, and the range of the whole passage in doc_id.

Defined cases: null and short texts have no passages; rows whose id is null are left out (no id can name them); rows
that share an id are one document, whose first such row in text order is used; repeats inside one document alone
are not looked for, but each copy of a passage in a document is linked to the first place of its seeds in the centre; an empty table gives an empty result; other columns go.
"""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import PUNCTUATION, Tokens, columns, discard, materialise, mix, pair_hash, ranges, table

K, SPAN, CLASSES, SIMILARITY, LEAST, LEAST_PART, MARGIN = 5, 12, 4, 0.8, 40, 12, 48
#: Any run alike of 35 words has two seeds that are NEAR to FAR words apart, as neighbours are at most SPAN apart.
NEAR, FAR = LEAST_PART - K, LEAST_PART - K + SPAN
GAP, MOST_GAP, MOST_SHIFT = 0.1, 64, 8
#: Two neighbouring seeds of a run alike in both texts are at most SPAN words apart, and make a chain.
LEAST_SCORE = 2 * K - 2 * GAP * SPAN - 1e-6
#: The same for two seeds FAR words apart in both texts.
LEAST_FAR = 2 * K - 2 * GAP * FAR - 1e-6
SEEDS = "seed long, doc_id long, pos int, after int, before int"
CHAINED = "doc_id long, other_id long, a int, b int, c int, d int, xs array<int>, ys array<int>"
CROPPED = "doc_id long, other_id long, a int, b int, c int, d int, xs array<int>, ys array<int>, base int, words binary"
ALIGNED = "doc_id long, start int, end int, other_id long, other_start int, other_end int, n_equal int"


def kmers(h: np.ndarray, first: np.ndarray, k: int = K):
    """Hashes of all k-word shingles, their rows and positions."""
    n = np.maximum(np.diff(first) - k + 1, 0)
    row = np.repeat(np.arange(len(n)), n)
    pos = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at = first[row] + pos
    out = h[at] if len(at) else np.zeros(0, np.uint64)
    for i in range(1, k):
        out = pair_hash(out, h[at + i])
    return out, row, pos


def winnow(h: np.ndarray, row: np.ndarray, span: int = SPAN) -> np.ndarray:
    """Which shingles are seeds: the least of some window of `span` in their row (or of the row, if it has fewer)."""
    n = len(h)
    picked = np.zeros(n, bool)
    if not n:
        return picked
    least, at = h.copy(), np.arange(n)
    width = 1
    while width < span:  # least[i] over the row's part of [i, i + span), by doubling
        step = min(width, span - width)
        i = np.flatnonzero(row[step:] == row[:-step])
        better = least[i + step] < least[i]
        j = i[better]
        least_new, at_new = least.copy(), at.copy()
        least_new[j], at_new[j] = least[j + step], at[j + step]
        least, at, width = least_new, at_new, width + step
    full = np.zeros(n, bool)
    if n >= span:
        full[: n - span + 1] = row[span - 1 :] == row[: n - span + 1]
    head = np.ones(n, bool)
    head[1:] = row[1:] != row[:-1]
    full |= head  # a row shorter than the window has its first
    picked[at[full]] = True
    return picked


def find_seeds(batches):
    """Seeds of a text: hash, document, place, and hashes of the LEAST_PART words that start and that end with the seed."""
    import pyarrow as pa

    tokens = Tokens(PUNCTUATION)
    for b in batches:
        for lo, hi, data, off in tokens.blocks(b.column(1)):
            h, _, _, first = tokens.words(data, off)
            s, row, pos = kmers(h, first)
            keep = winnow(s, row)
            s, row, pos = s[keep], row[keep], pos[keep]
            ids = b.column(0).take(pa.array(row + lo))
            at, run = first[row] + pos, np.zeros(len(h) + 1, np.uint64)
            np.cumsum(h * tokens.powers[: len(h)], out=run[1:])
            around = []
            for start, end in ((at, np.minimum(at + LEAST_PART, first[row + 1])), (np.maximum(at - NEAR, first[row]), at + K)):
                around.append((mix((run[end] - run[start]) * tokens.inverse[start]) >> np.uint64(32)).astype(np.uint32).view(np.int32))
            columns = [pa.array(s.view(np.int64)), ids, pa.array(pos.astype(np.int32)), *map(pa.array, around)]
            yield pa.RecordBatch.from_arrays(columns, ["seed", "doc_id", "pos", "after", "before"])


def best_chains(left: list[int], xs: list[int], ys: list[int]) -> tuple[dict, dict]:
    """For each link the score of the best chain that ends in it, and the link before it in that chain (-1: none).

    f(j) = K + max over links before j in both texts of f(i) - GAP * (distance in both); the maximum of
    f(i) + GAP * (x_i + y_i) is kept by a Fenwick tree over y. Links are taken in order of x.
    """
    places = {y: r + 1 for r, y in enumerate(sorted({ys[i] for i in left}))}
    tree: list[tuple[float, int]] = [(float("-inf"), -1)] * (len(places) + 1)
    score, back, entered = {}, {}, 0
    for i in left:
        while xs[left[entered]] < xs[i]:  # links at the same x don't follow each other
            j = left[entered]
            entered += 1
            value, r = (score[j] + GAP * (xs[j] + ys[j]), j), places[ys[j]]
            while r < len(tree):
                tree[r] = max(tree[r], value)
                r += r & -r
        best, r = (float("-inf"), -1), places[ys[i]] - 1
        while r:
            best = max(best, tree[r])
            r -= r & -r
        gain = best[0] - GAP * (xs[i] + ys[i])
        j = best[1]
        if gain > 0 and xs[i] - xs[j] <= MOST_GAP and ys[i] - ys[j] <= MOST_GAP:
            score[i], back[i] = K + gain, j
        else:
            score[i], back[i] = float(K), -1
    return score, back


def chains(xs: list[int], ys: list[int], least: float) -> list[list[int]]:
    """Disjoint collinear chains of links (places in one text, in the other), best first.

    A chain takes the links of its stretch of the first text with it. Chains are taken in the order of their scores as
    long as none of their links has gone; then those of the links left are found anew. So many copies of a passage in
    one text cost a pass or two, not one each.
    """
    left = sorted(range(len(xs)), key=lambda i: (xs[i], ys[i]))
    out = []
    while len(left) >= 2:
        score, back = best_chains(left, xs, ys)
        gone, broken, stop = set(), False, False
        place = {i: n for n, i in enumerate(left)}
        for end in sorted(left, key=lambda i: (-score[i], place[i])):
            if end in gone:
                continue
            if score[end] < least:
                stop = True
                break
            chain = [end]
            while back[chain[-1]] >= 0:
                chain.append(back[chain[-1]])
            chain.reverse()
            if broken := any(i in gone for i in chain):
                break
            piece = [chain[0]]
            for i, j in zip(chain, chain[1:]):  # a long insertion ends a passage
                if abs((xs[j] - xs[i]) - (ys[j] - ys[i])) > MOST_SHIFT:
                    out.append(piece)
                    piece = []
                piece.append(j)
            out.append(piece)
            a, b = xs[chain[0]], xs[chain[-1]]
            for step, n in ((-1, place[chain[0]]), (1, place[chain[0]] + 1)):
                while 0 <= n < len(left) and a <= xs[left[n]] <= b:
                    gone.add(left[n])
                    n += step
        if stop or not broken:
            break
        left = [i for i in left if i not in gone]
    return [c for c in out if len(c) > 1]


def plain_chains(row: np.ndarray, x: np.ndarray, y: np.ndarray, n: int, least: float):
    """Chains of the rows whose links, in order of x and y, all follow each other closely: what chains() gives for them.

    Where both texts go on from link to link, by steps whose cost is less than K, each link's best chain goes through all
    links before it, and the last link's is the best of all; so the row has one chain, of all its links, cut at long
    insertions. Returns which rows are others, and (row, first link, link after the last) of each chain.
    """
    dx, dy = np.diff(x), np.diff(y)
    inner = row[1:] == row[:-1]
    close = (dx > 0) & (dy > 0) & (np.maximum(dx, dy) <= MOST_GAP) & (GAP * (dx + dy) < K - 1e-6)
    other = np.zeros(n, bool)
    other[row[1:][inner & ~close]] = True
    step = np.zeros(len(row))
    step[1:] = np.where(inner, K - GAP * (dx + dy), K)
    step[:1] = K
    score = np.bincount(row, step, n)
    breaks = np.ones(len(row), bool)
    breaks[1:] = ~inner | (np.abs(dx - dy) > MOST_SHIFT)
    first = np.flatnonzero(breaks)
    after = np.append(first[1:], len(row))
    keep = (after - first > 1) & ~other[row[first]] & (score[row[first]] >= least)
    return other, row[first][keep], first[keep], after[keep]


def chain_links(batches, least: float = LEAST_SCORE):
    import pyarrow as pa

    for batch in batches:
        links, n = batch.column(2), batch.num_rows
        off = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.diff(links.offsets.to_numpy()).astype(np.int64))])
        x, y = (v.to_numpy(zero_copy_only=False).astype(np.int64) for v in links.flatten().flatten())
        row = np.repeat(np.arange(n), np.diff(off))
        order = np.lexsort((y, x, row))  # ties must not depend on the order in which rows came
        x, y = x[order], y[order]
        other, of, first, after = plain_chains(row, x, y, n, least)
        of, at, ends = [of], [ranges(first, after - first)], [after - first]
        for r in np.flatnonzero(other).tolist():
            for chain in chains(x[off[r] : off[r + 1]].tolist(), y[off[r] : off[r + 1]].tolist(), least):
                of.append(np.full(1, r))
                at.append(off[r] + np.array(chain))
                ends.append(np.full(1, len(chain)))
        of, at, ends = np.concatenate(of), np.concatenate(at), np.cumsum(np.concatenate(ends))
        x, y, starts = x[at].astype(np.int32), y[at].astype(np.int32), np.concatenate([np.zeros(1, np.int64), ends[:-1]])[: len(ends)]
        places = [x[starts], x[ends - 1] + K, y[starts], y[ends - 1] + K]
        off = pa.array(np.concatenate([np.zeros(1, np.int64), ends]).astype(np.int32))
        lists = [pa.ListArray.from_arrays(off, pa.array(v)) for v in (x, y)]
        of = pa.array(of)
        out = [batch.column(0).take(of), batch.column(1).take(of), *[pa.array(v.astype(np.int32)) for v in places], *lists]
        yield pa.RecordBatch.from_arrays(out, ["doc_id", "other_id", "a", "b", "c", "d", "xs", "ys"])


def crop(batches):
    """The words of doc_id around the chain, as hashes. Columns: those of CHAINED, and text."""
    import pyarrow as pa

    tokens = Tokens(PUNCTUATION)
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            b = batch.slice(at, 200)
            base, words = [], []
            a, z = b.column(2).to_pylist(), b.column(3).to_pylist()
            ids = b.column(0).to_numpy()
            heads = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])  # chains of one document come together
            ends = [*heads[1:].tolist(), b.num_rows]
            for lo, hi, data, off in tokens.blocks(b.column(8).take(pa.array(heads))):
                h, _, _, first = tokens.words(data, off)
                for k in range(lo, hi):
                    own = h[first[k - lo] : first[k - lo + 1]]
                    for r in range(heads[k], ends[k]):
                        base.append(max(0, a[r] - MARGIN))
                        words.append((own[base[-1] : z[r] + MARGIN] >> np.uint64(32)).astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([*b.columns[:8], pa.array(base, pa.int32()), pa.array(words, pa.binary())], ["doc_id", "other_id", "a", "b", "c", "d", "xs", "ys", "base", "words"])


def outwards(x: np.ndarray, y: np.ndarray) -> tuple[int, int]:
    """How far two texts that start here go on alike (+1 for equal words, -2 for others, until 5 below the best), and how many words are equal."""
    n = min(len(x), len(y), MARGIN)
    if not n:
        return 0, 0
    equal = x[:n] == y[:n]
    run = np.cumsum(np.where(equal, 1, -2))
    over = np.flatnonzero(np.maximum.accumulate(np.maximum(run, 0)) - run > 5)
    run = run[: over[0]] if len(over) else run
    if not len(run) or run.max() <= 0:
        return 0, 0
    best = int(run.argmax()) + 1
    return best, int(equal[:best].sum())


def common_words(x: np.ndarray, y: np.ndarray) -> int:
    """Length of a longest common subsequence of two short stretches."""
    if not len(x) or not len(y):
        return 0
    if len(x) == len(y) and (same := int((x == y).sum())) >= len(x) - 1:
        return same
    row = np.zeros(len(y) + 1, np.int64)
    for w in x:
        take = np.concatenate([[0], row[:-1] + (y == w)])
        row = np.maximum.accumulate(np.maximum(row, take))
    return int(row[-1])


def align(x: np.ndarray, y: np.ndarray, xs: list[int], ys: list[int]):
    """Aligns two texts along a chain of equal k-mers: (start, end, other start, other end, equal words)."""
    equal, px, py = 0, xs[0], ys[0]
    for cx, cy in zip(xs, ys):
        if cx + K <= px or cy + K <= py:
            continue
        equal += common_words(x[px:cx], y[py:cy]) if cx > px or cy > py else 0
        cut = max(0, px - cx, py - cy)
        equal += K - cut
        px, py = cx + K, cy + K
    more, same = outwards(x[px:], y[py:])
    less, before = outwards(x[: xs[0]][::-1], y[: ys[0]][::-1])
    if equal + same + before < SIMILARITY * (max(px - xs[0], py - ys[0]) + more + less):  # ends may not spoil what lies between
        more = same = less = before = 0
    return xs[0] - less, px + more, ys[0] - less, py + more, equal + same + before


def outwards_of(x: np.ndarray, y: np.ndarray, ax: np.ndarray, ay: np.ndarray, n: np.ndarray, way: int):
    """outwards() of many stretches: from the places ax of x and ay of y, n words each, onwards (way 1) or back (-1)."""
    k = np.arange(MARGIN)
    there = k < np.minimum(n, MARGIN)[:, None]
    equal = there & (x[np.clip(ax[:, None] + way * k, 0, len(x) - 1)] == y[np.clip(ay[:, None] + way * k, 0, len(y) - 1)])
    run = np.cumsum(np.where(equal, 1, -2), axis=1)
    over = ~there | (np.maximum.accumulate(np.maximum(run, 0), axis=1) - run > 5)
    run[np.logical_or.accumulate(over, axis=1)] = -1
    best, at = run.argmax(axis=1), np.arange(len(run))
    found = run[at, best] > 0
    return np.where(found, best + 1, 0), np.where(found, np.cumsum(equal, axis=1)[at, best], 0)


def align_all(x, y, xo, yo, off, xs, ys):
    """align() of many chains at once: row r has the words x[xo[r]:xo[r + 1]], y[yo[r]:yo[r + 1]], and the links off[r] to off[r + 1] of xs and ys.

    Chains go on in both texts, and lie inside them. Stretches between seeds that are equal but for a word count by place.
    """
    n = len(off) - 1
    row = np.repeat(np.arange(n), np.diff(off))
    inner = np.flatnonzero(row[1:] == row[:-1])
    gx, gy = xs[inner + 1] - xs[inner] - K, ys[inner + 1] - ys[inner] - K  # words between two seeds; less than none: they overlap
    equal = K * np.diff(off) - np.bincount(row[inner], np.maximum(0, np.maximum(-gx, -gy)), n).astype(np.int64)
    between = (gx > 0) & (gy > 0)
    of, gx, gy = row[inner][between], gx[between], gy[between]
    ax, ay = xo[of] + xs[inner][between] + K, yo[of] + ys[inner][between] + K
    count, straight = np.full(len(of), -1), np.flatnonzero(gx == gy)
    if len(straight):
        same = x[ranges(ax[straight], gx[straight])] == y[ranges(ay[straight], gx[straight])]
        count[straight] = np.add.reduceat(same.astype(np.int64), np.cumsum(gx[straight]) - gx[straight])
    for i in np.flatnonzero((gx != gy) | (count < gx - 1)).tolist():
        count[i] = common_words(x[ax[i] : ax[i] + gx[i]], y[ay[i] : ay[i] + gy[i]])
    equal += np.bincount(of, count, n).astype(np.int64)
    sx, sy, ex, ey = xs[off[:-1]], ys[off[:-1]], xs[off[1:] - 1] + K, ys[off[1:] - 1] + K
    more, same = outwards_of(x, y, xo[:-1] + ex, yo[:-1] + ey, np.minimum(np.diff(xo) - ex, np.diff(yo) - ey), 1)
    less, before = outwards_of(x, y, xo[:-1] + sx - 1, yo[:-1] + sy - 1, np.minimum(sx, sy), -1)
    spoilt = equal + same + before < SIMILARITY * (np.maximum(ex - sx, ey - sy) + more + less)  # ends may not spoil what lies between
    for v in (more, same, less, before):
        v[spoilt] = 0
    return sx - less, ex + more, sy - less, ey + more, equal + same + before


def align_chains(batches):
    """Columns: those of CROPPED, and the centre's text."""
    import pyarrow as pa

    tokens = Tokens(PUNCTUATION)
    for whole in batches:
        for at in range(0, whole.num_rows, 500):
            b = whole.slice(at, 500)
            ids, c, d, base = (b.column(i).to_numpy().astype(np.int64) for i in (1, 4, 5, 8))
            low, theirs = np.maximum(0, c - MARGIN), []
            heads = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])  # chains of one centre come together
            ends = [*heads[1:].tolist(), b.num_rows]
            for lo, hi, data, off in tokens.blocks(b.column(10).take(pa.array(heads))):
                h, _, _, first = tokens.words(data, off)
                for k in range(lo, hi):
                    known = h[first[k - lo] : first[k - lo + 1]]
                    theirs += [(known[low[r] : d[r] + MARGIN] >> np.uint64(32)).astype("<u4") for r in range(heads[k], ends[k])]
            own = [np.frombuffer(w, "<u4") for w in b.column(9).to_pylist()]
            xo, yo = (np.concatenate([np.zeros(1, np.int64), np.cumsum([len(w) for w in v])]) for v in (own, theirs))
            off = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.diff(b.column(6).offsets.to_numpy()).astype(np.int64))])
            row = np.repeat(np.arange(b.num_rows), np.diff(off))
            xs, ys = (b.column(i).flatten().to_numpy().astype(np.int64) for i in (6, 7))
            xs, ys = xs - base[row], ys - low[row]
            inside = (xs[off[1:] - 1] + K <= np.diff(xo)) & (ys[off[1:] - 1] + K <= np.diff(yo))
            if inside.all():
                s, e, os, oe, same = align_all(np.concatenate(own), np.concatenate(theirs), xo, yo, off, xs, ys)
            else:  # an id that several texts share
                got = [align(own[r], theirs[r], xs[off[r] : off[r + 1]].tolist(), ys[off[r] : off[r + 1]].tolist()) for r in range(b.num_rows)]
                s, e, os, oe, same = np.array(got, np.int64).T
            keep = np.flatnonzero((np.minimum(e - s, oe - os) >= LEAST_PART) & (same >= SIMILARITY * np.maximum(e - s, oe - os)))
            places = [pa.array(v[keep].astype(np.int32)) for v in (s + base, e + base, os + low, oe + low, same)]
            rows = pa.array(keep)
            out = [b.column(0).take(rows), *places[:2], b.column(1).take(rows), *places[2:]]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "start", "end", "other_id", "other_start", "other_end", "n_equal"])


def chained(links: DataFrame, least: float) -> DataFrame:
    """Links (doc_id, other_id, x, y) as chains. Columns: CHAINED."""
    paired = links.groupBy("doc_id", "other_id").agg(F.collect_list(F.struct("x", "y")).alias("links")).where("size(links) > 1")
    return paired.mapInArrow(partial(chain_links, least=least), CHAINED).where(f"b - a >= {K + 1}")


def centre_links(shared: DataFrame) -> DataFrame:
    """Links (doc_id, other_id, x, y) of each occurrence to the first one in the smallest document of each class."""
    place = F.struct(F.col("doc_id").alias("other_id"), F.col("pos").alias("y"))  # its least is the first place in the first document
    least_of = [F.min(F.when(F.pmod(F.xxhash64("doc_id"), F.lit(CLASSES)) == k, place)).alias(f"c{k}") for k in range(CLASSES)]
    centres = shared.groupBy("seed").agg(*least_of)
    links = shared.join(centres, "seed").select("doc_id", F.col("pos").alias("x"), F.inline(F.array_compact(F.array(*[f"c{k}" for k in range(CLASSES)]))))
    return links.where("other_id < doc_id")


def rest_chains(shared: DataFrame, parts: DataFrame) -> DataFrame:
    """Chains for the occurrences over which no part lies ("open"), however many documents hold their seeds.

    Seeds NEAR to FAR words apart in one document are a pair; pairs of equal seeds whose words between are equal too
    (by the hashes around both seeds; they meet, as FAR + K <= 2 * LEAST_PART) are a stretch. All documents that hold
    a stretch with an open seed are linked to the first of them (its own places: to the last): they all hold those words, so what a document shares
    of it doesn't depend on the one it is compared with. A stretch that one document alone holds is linked to the
    first document of each other stretch between the same two seeds. Stretches on one diagonal that touch are one
    chain. In a run of one seed (a word or a line again and
    again) the first occurrence of every SPAN words is taken, counted from the run's start.
    """
    from pyspark.sql.window import Window as W

    sides = [parts.select("doc_id", F.col("start").alias("pos"), F.col("end").alias("reach"))]
    sides.append(parts.select(F.col("other_id").alias("doc_id"), F.col("other_start").alias("pos"), F.col("other_end").alias("reach")))
    lying = sides[0].union(sides[1]).groupBy("doc_id", "pos").agg(F.max("reach").alias("reach"))
    rows = shared.unionByName(lying, allowMissingColumns=True)
    order = W.partitionBy("doc_id").orderBy("pos", F.col("seed").asc_nulls_first())
    so_far = order.rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("open", F.coalesce(F.max("reach").over(so_far), F.lit(0)) < F.col("pos") + K).where("seed is not null").drop("reach")
    rows = rows.withColumns({"s0": F.lag("seed").over(order), "x0": F.lag("pos").over(order)})
    rows = rows.withColumn("head", F.when((F.col("seed") == F.col("s0")) & (F.col("pos") - F.col("x0") <= SPAN), False).otherwise(True))
    rows = rows.withColumn("run", F.max(F.when(F.col("head"), F.col("pos"))).over(so_far))
    rows = rows.where(f"head or floor((pos - run) / {SPAN}) <> floor((x0 - run) / {SPAN})").drop("s0", "x0", "head", "run")
    around = W.partitionBy("doc_id").orderBy("pos").rangeBetween(-FAR, FAR)
    rows = materialise(rows.withColumn("by", F.max("open").over(around)), "rest")
    rows = rows.join(rows.where("by").select("seed").distinct(), "seed", "left_semi")  # the other seed of a pair may be open nowhere
    later = F.struct(F.col("seed").alias("s2"), F.col("pos").alias("x2"), F.col("before").alias("b2"), F.col("open").alias("o2"))
    ahead = W.partitionBy("doc_id").orderBy("pos").rangeBetween(NEAR, FAR)
    pairs = rows.withColumn("later", F.collect_list(later).over(ahead)).select("doc_id", "seed", "pos", "after", "open", F.inline("later"))
    apart = F.col("x2") - F.col("pos")
    pairs = pairs.select("doc_id", F.col("pos").alias("x"), apart.alias("dx"), "seed", "s2", F.xxhash64(apart, "after", "b2").alias("words"), (F.col("open") | F.col("o2")).alias("open"))
    pairs = materialise(pairs, "pairs")
    key = ["seed", "s2", "words"]
    first = F.min(F.struct(F.col("doc_id").alias("other_id"), F.col("x").alias("y"), F.col("dx").alias("dy")))
    last = F.max(F.struct(F.col("doc_id").alias("hi"), F.col("x").alias("z")))
    stretches = pairs.groupBy(*key).agg(first.alias("p"), last.alias("q"), F.max("open").alias("open")).select(*key, "p.*", "q.*", "open")
    stretches = materialise(stretches, "stretches")
    alike = pairs.join(stretches.where("open and other_id < hi").select(*key, "other_id", "y", "hi", "z"), key)
    # the first document's own places go to the last document that holds the stretch
    own = F.col("doc_id") == F.col("other_id")
    x, y = F.when(own, F.col("z")).otherwise(F.col("x")), F.when(own, F.col("x")).otherwise(F.col("y"))
    alike = alike.select(F.when(own, F.col("hi")).otherwise(F.col("doc_id")).alias("doc_id"), "other_id", x.alias("x"), "dx", y.alias("y"), F.col("dx").alias("dy"))
    alone = stretches.where("open and other_id = hi").select("seed", "s2", F.col("other_id").alias("doc_id"), F.col("y").alias("x"), F.col("dy").alias("dx"))
    near = alone.join(stretches.select("seed", "s2", "other_id", "y", "dy"), ["seed", "s2"]).where(f"doc_id <> other_id and abs(dx - dy) <= {MOST_SHIFT}")
    turned = [F.when(F.col("doc_id") > F.col("other_id"), F.col(a)).otherwise(F.col(b)).alias(a) for a, b in (("doc_id", "other_id"), ("other_id", "doc_id"), ("x", "y"), ("dx", "dy"), ("y", "x"), ("dy", "dx"))]
    near = near.select(*turned)
    ends = F.array(F.struct("x", "y"), F.struct((F.col("x") + F.col("dx")).alias("x"), (F.col("y") + F.col("dy")).alias("y")))
    near = chained(near.select("doc_id", "other_id", F.inline(ends)).distinct(), LEAST_FAR)
    alike = alike.groupBy("doc_id", "other_id", "x", "y").agg(F.max("dx").alias("dx")).withColumn("off", F.col("y") - F.col("x"))
    diagonal = W.partitionBy("doc_id", "other_id", "off").orderBy("x")
    reach = F.max(F.col("x") + F.col("dx") + K).over(diagonal.rowsBetween(W.unboundedPreceding, -1))
    alike = alike.withColumn("new", F.when(F.col("x") <= reach, 0).otherwise(1)).withColumn("g", F.sum("new").over(diagonal.rowsBetween(W.unboundedPreceding, 0)))
    xs = F.array_sort(F.array_distinct(F.concat(F.collect_list("x"), F.collect_list(F.col("x") + F.col("dx")))))
    alike = alike.groupBy("doc_id", "other_id", "off", "g").agg(xs.alias("xs"))
    a, b = F.col("xs")[0], F.element_at("xs", -1) + K
    ys = F.transform("xs", lambda v: v + F.col("off"))
    alike = alike.select("doc_id", "other_id", a.alias("a"), b.alias("b"), (a + F.col("off")).alias("c"), (b + F.col("off")).alias("d"), "xs", ys.alias("ys"))
    return alike.unionByName(near)


def aligned(docs: DataFrame, chains: DataFrame) -> DataFrame:
    """The parts that chains are aligned to: a written table."""
    chains = materialise(chains, "chains")
    near = chains.select("doc_id").union(chains.select("other_id")).distinct()
    # of rows that share an id one is used; written, so that the joins on hot centres can be split
    one = materialise(docs.join(near, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text")), "texts")
    cropped = chains.join(one, "doc_id").select(*chains.columns, "text").mapInArrow(crop, CROPPED)
    centre = one.select(F.col("doc_id").alias("other_id"), "text")
    parts = materialise(cropped.join(centre, "other_id").select(*cropped.columns, "text").mapInArrow(align_chains, ALIGNED), "parts")
    discard(chains, one)
    return parts


def shared_passages(docs: DataFrame, least: int = LEAST) -> DataFrame:
    from pyspark.sql.window import Window as W

    docs = columns(docs, doc_id="long", text="string").where("doc_id is not null")
    seeds = materialise(docs.mapInArrow(find_seeds, SEEDS), "seeds")
    many = seeds.groupBy("seed").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("seed")
    shared = materialise(seeds.join(many, "seed", "left_semi"), "shared")
    discard(seeds)
    parts = aligned(docs, chained(centre_links(shared), LEAST_SCORE))
    parts = parts.union(aligned(docs, rest_chains(shared, parts))).distinct()
    # a centre holds the passage too: each of its ranges once, with the smallest document that shares it
    back = parts.groupBy("other_id", "other_start", "other_end").agg(F.min(F.struct("doc_id", "start", "end", "n_equal")).alias("p"))
    back = back.select(F.col("other_id").alias("doc_id"), F.col("other_start").alias("start"), F.col("other_end").alias("end"), F.col("p.doc_id").alias("other_id"), F.col("p.start").alias("other_start"), F.col("p.end").alias("other_end"), "p.n_equal")
    parts = parts.unionByName(back)
    # parts of one document that touch make a passage; a document's parts are no more than its words (a centre's: than its stretches)
    order = W.partitionBy("doc_id").orderBy("start", "end", "other_id", "other_start")
    reach = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
    parts = parts.withColumn("new", F.when(F.col("start") <= reach + 3, 0).otherwise(1)).withColumn("g", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    whole = W.partitionBy("doc_id", "g")
    parts = parts.withColumn("passage_start", F.min("start").over(whole)).withColumn("passage_end", F.max("end").over(whole))
    return parts.where(F.col("passage_end") - F.col("passage_start") >= least).drop("new", "g")


def query(spark, sf_dir: str) -> DataFrame:
    return shared_passages(table(spark, sf_dir, "documents"))
