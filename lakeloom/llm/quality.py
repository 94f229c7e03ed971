"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer network.

Words are runs of letters, of digits or of other signs; each also stands as its shape (kind, case, length), or, if it
repeats one of the two words before, as a repeat. Words
and shapes are hashed to BINS bins. A word's index vector has a few +1 and -1 at places given by its hash; its
context vector is the sum of the index vectors around it (WINDOW words to each side) over a bounded sample of
labelled documents, scaled to length one; bins that the sample lacks are zero. A document is the mean and the spread
of the vectors of all its words. A network of one hidden layer is fitted by numpy on four fifths of the sample, and
one temperature is fitted on the rest, so that scores are probabilities.

Only text and quality of training rows are learned from. Defined cases: null and empty texts get the score of a zero
vector; without labelled rows every score is 0.5; repeated rows give a row each; null ids are allowed; an empty
table gives an empty result; other columns go.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import Tokens, columns, crc_mod, mix, table
from lakeloom.llm.sampling import labelled_texts

BINS, DIM, WINDOW, HIDDEN = 1 << 15, 32, 2, 24
TRAIN_DOCUMENTS, TRAIN_BYTES = 4000, 32768
FOUND = "doc_id long, score double"


class Words(Tokens):
    """Runs of one kind of byte; case is kept."""

    def __init__(self):
        super().__init__(np.ones(256, bool))
        kind = np.full(256, 4, np.uint8)  # other signs
        kind[0x09:0x0E] = kind[0x20] = 0
        kind[0x30:0x3A] = 1
        kind[0x61:0x7B] = kind[0x80:] = 2
        kind[0x41:0x5B] = 3
        self.kind = kind
        self.low = np.arange(1, 257, dtype=np.uint64)

    def bins(self, data: np.ndarray, off: np.ndarray):
        """Bins of the words, and of their shapes, and each row's first word."""
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
        k = self.kind[data]
        run = np.where(k == 3, 2, k)
        new = np.ones(len(data), bool)
        new[1:] = run[1:] != run[:-1]
        new[off[(off > 0) & (off < len(data))]] = True
        cut = np.flatnonzero(new)
        stop = np.append(cut[1:], len(data))
        on = k[cut] > 0
        s, e = cut[on], stop[on]
        self._grow(len(data))
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.low[data] * self.powers[: len(data)], out=total[1:])
        h = mix((total[e] - total[s]) * self.inverse[s])
        upper = np.concatenate([[0], np.cumsum(k == 3)])
        caps = upper[e] - upper[s]
        case = np.where(caps == 0, 0, np.where(caps == e - s, 2, 1))
        shape = mix((run[s].astype(np.uint64) * np.uint64(3) + case.astype(np.uint64)) * np.uint64(64) + np.minimum(e - s, 40).astype(np.uint64))
        first = np.searchsorted(s, off)
        row, again = np.repeat(np.arange(len(off) - 1), np.diff(first)), np.zeros(len(h), np.uint64)
        for gap in (1, 2):
            again[gap:] |= ((h[gap:] == h[:-gap]) & (row[gap:] == row[:-gap]) & (run[s[gap:]] > 1)).astype(np.uint64)
        shape = np.where(again > 0, mix(again + np.uint64(999)), shape)
        return (h >> np.uint64(49)).astype(np.int64), (shape >> np.uint64(49)).astype(np.int64), first


def index_vectors() -> np.ndarray:
    """Sparse vectors of +1 and -1 by bin, from a hash."""
    h = mix(np.arange(BINS * 6, dtype=np.uint64) + np.uint64(77))
    v = np.zeros((BINS, DIM), np.float32)
    np.add.at(v, (np.repeat(np.arange(BINS), 6), (h % np.uint64(DIM)).astype(np.int64)), np.where(h >> np.uint64(63), 1.0, -1.0))
    return v


def sequences(words: Words, texts: list[str]):
    import pyarrow as pa

    for lo, hi, data, off in words.blocks(pa.array(texts, pa.string())):
        w, s, first = words.bins(data, off)
        yield lo, hi, w, s, first


def context_vectors(texts: list[str]) -> np.ndarray:
    index, out = index_vectors(), np.zeros((BINS, DIM), np.float64)
    words = Words()
    for lo, hi, w, s, first in sequences(words, texts):
        row = np.repeat(np.arange(hi - lo), np.diff(first))
        for gap in range(1, WINDOW + 1):
            same = np.flatnonzero(row[gap:] == row[:-gap])
            for at, near in ((same, same + gap), (same + gap, same)):
                for bins in (w, s):
                    order = np.argsort(bins[at], kind="stable")
                    group, start = np.unique(bins[at][order], return_index=True)
                    if len(group):
                        out[group] += np.add.reduceat(index[w[near[order]]] + index[s[near[order]]], start, axis=0)
    size = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.maximum(size, 1e-9)).astype(np.float32)


def pooled(vectors: np.ndarray, w: np.ndarray, s: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Mean and spread of the vectors of each row's words and shapes; zero for a row without words."""
    n = np.diff(first)
    out = np.zeros((len(n), 2 * DIM), np.float32)
    some = np.flatnonzero(n)
    if len(some):
        v = vectors[w] + vectors[s]
        mean = np.add.reduceat(v, first[some], axis=0) / n[some, None]
        square = np.add.reduceat(v * v, first[some], axis=0) / n[some, None]
        out[some] = np.hstack([mean, np.sqrt(np.maximum(square - mean**2, 0))])
    return out


class Network:
    def __init__(self, vectors, centre, scale, w1, b1, w2, b2, temperature):
        self.vectors, self.centre, self.scale = vectors, centre, scale
        self.w1, self.b1, self.w2, self.b2, self.temperature = w1, b1, w2, b2, temperature

    def scores(self, x: np.ndarray) -> np.ndarray:
        hidden = np.maximum((x - self.centre) / self.scale @ self.w1 + self.b1, 0)
        return 1 / (1 + np.exp(-np.clip((hidden @ self.w2 + self.b2) / self.temperature, -30, 30)))


def fit(samples: list[tuple[str, int]], rounds: int = 60, batch: int = 64) -> Network | None:
    if len(samples) < 2:
        return None
    texts, y = [t for t, _ in samples], np.array([float(v) for _, v in samples])
    vectors, words = context_vectors(texts), Words()
    x = np.vstack([pooled(vectors, w, s, first) for _, _, w, s, first in sequences(words, texts)]).astype(float)
    rng = np.random.default_rng(7)
    order = rng.permutation(len(y))
    train, rest = order[len(order) // 5 :], order[: len(order) // 5]
    centre, scale = x[train].mean(axis=0), x[train].std(axis=0) + 1e-3
    z = (x - centre) / scale
    p = [rng.normal(0, 1 / np.sqrt(2 * DIM), (2 * DIM, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.2, HIDDEN), np.zeros(1)]
    mean, square, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(rounds):
        rng.shuffle(train)
        for i in range(0, len(train), batch):
            own = train[i : i + batch]
            a = z[own]
            hidden = np.maximum(a @ p[0] + p[1], 0)
            d = (1 / (1 + np.exp(-np.clip(hidden @ p[2] + p[3], -30, 30))) - y[own]) / len(own)
            back = np.outer(d, p[2]) * (hidden > 0)
            grads = [a.T @ back + 1e-3 * p[0], back.sum(axis=0), hidden.T @ d + 1e-3 * p[2], np.array([d.sum()])]
            step += 1
            for k, g in enumerate(grads):
                mean[k] = 0.9 * mean[k] + 0.1 * g
                square[k] = 0.999 * square[k] + 0.001 * g * g
                p[k] = p[k] - 0.003 * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)
    net = Network(vectors, centre, scale, *p, 1.0)
    if len(rest):
        logit = np.maximum(z[rest] @ p[0] + p[1], 0) @ p[2] + p[3]
        net.temperature = min(np.geomspace(0.25, 8, 41), key=lambda t: float(np.logaddexp(0, np.where(y[rest] > 0, -logit, logit) / t).mean()))
    return net


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, score."""
    rows = columns(docs, doc_id="long", text="string")
    marks = columns(labels, doc_id="long", quality="int").where(crc_mod(F.col("doc_id"), 3) != 1)
    net = fit(labelled_texts(rows, marks.select("doc_id", F.col("quality").alias("label")), TRAIN_DOCUMENTS, TRAIN_BYTES))

    def score(batches):
        import pyarrow as pa

        words = Words()
        for b in batches:
            out = [np.zeros(0)]
            if net is None:
                out.append(np.full(b.num_rows, 0.5))
            else:
                for _, _, data, off in words.blocks(b.column(1)):
                    out.append(net.scores(pooled(net.vectors, *words.bins(data, off)).astype(float)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(out))], ["doc_id", "score"])

    return rows.mapInArrow(score, FOUND)


def query(spark, sf_dir: str) -> DataFrame:
    out = score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
