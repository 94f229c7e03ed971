"""Language ID: kernel ridge regression on a blended-spectrum string kernel, by Nystroem landmarks.

The kernel of two texts is the number of character n-grams (1 to 4 code points, lower case, whole text) that both
have, over the root of the product of their numbers; n-grams are present or not, and are hashed to BINS bins. A
bounded sample of labelled documents is mapped by the kernel to LANDMARKS of them, whitened by the inverse root of
the landmarks' own kernel, and one ridge regression per language is solved. Documents are scored by products of
their presence matrix with the landmarks' and the solved weights, a block of documents at a time.

Only text and lang of training rows are learned from. Defined cases: null texts and texts without a letter are
`und` with score 0, as all are without a single labelled row; repeated rows give a row each; null ids are allowed
(they count as training rows by the checksum of the empty text); an empty table gives an empty result; other columns go.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import carried, carried_schema, columns, crc_mod, lean, table, with_carried
from lakeloom.llm.sampling import labelled_texts

BINS, GRAMS, LANDMARKS = 1 << 15, 4, 64
TRAIN_DOCUMENTS, TRAIN_BYTES, RIDGE = 2000, 32768, 1e-3
BLOCK_CHARS, BLOCK_ROWS = 1 << 18, 64
FOUND = "lang_pred string, score double"


def presence(texts: list[str]) -> np.ndarray:
    """Rows of 0 and 1 by bin; a text is taken in pieces that overlap, so memory doesn't grow with it."""
    out = np.zeros((len(texts), BINS), np.float32)
    for r, text in enumerate(texts):
        text, row = text.lower(), out[r]
        for at in range(0, len(text), BLOCK_CHARS):
            c = np.frombuffer(text[at : at + BLOCK_CHARS + GRAMS - 1].encode("utf-32-le", "surrogatepass"), np.uint32)
            h = np.zeros(len(c), np.uint32)
            for n in range(1, GRAMS + 1):
                if len(c) < n:
                    break
                h = h[: len(c) - n + 1] * np.uint32(0x01000193) + (c[n - 1 :] + np.uint32(1)) * np.uint32(0x9E3779B1)
                row[(h * np.uint32(0x85EBCA6B)) >> np.uint32(32 - 15)] = 1.0
    return out


class Model:
    def __init__(self, classes: list[str], landmarks: np.ndarray, weights: np.ndarray, sharpness: float):
        self.classes, self.landmarks, self.weights, self.sharpness = classes, landmarks, weights, sharpness
        self.landmark_roots = np.sqrt(np.maximum(landmarks.sum(axis=1), 1.0))

    def kernel(self, x: np.ndarray) -> np.ndarray:
        return (x @ self.landmarks.T) / (np.sqrt(np.maximum(x.sum(axis=1), 1.0))[:, None] * self.landmark_roots)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        f = self.sharpness * np.hstack([self.kernel(x), np.ones((len(x), 1), np.float32)]) @ self.weights
        p = np.exp(f - f.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)


def fit(samples: list[tuple[str, str]]) -> Model | None:
    samples = [(t, y) for t, y in samples if any(c.isalpha() for c in t)]
    if not samples:
        return None
    classes = sorted({y for _, y in samples})
    y = np.array([classes.index(c) for _, c in samples])
    turn = np.zeros(len(y), int)  # landmarks by turns from each class, so that rare languages have some
    for k in range(len(classes)):
        turn[y == k] = np.arange((y == k).sum())
    chosen = np.lexsort((y, turn))[:LANDMARKS]
    x = np.vstack([presence([t for t, _ in samples[i : i + BLOCK_ROWS]]).astype(np.uint8) for i in range(0, len(samples), BLOCK_ROWS)])
    m = Model(classes, x[chosen].astype(np.float32), np.zeros((1, 1)), 1.0)
    own = m.kernel(m.landmarks).astype(float)
    value, vector = np.linalg.eigh((own + own.T) / 2)
    good = value > 1e-6 * value[-1]
    root = vector[:, good] / np.sqrt(value[good])
    k = np.vstack([m.kernel(x[i : i + BLOCK_ROWS].astype(np.float32)) for i in range(0, len(x), BLOCK_ROWS)]).astype(float)
    phi = np.hstack([k @ root, np.ones((len(k), 1))])
    goal = np.where(y[:, None] == np.arange(len(classes)), 1.0, -1.0)
    w = np.linalg.solve(phi.T @ phi + RIDGE * len(phi) * np.eye(phi.shape[1]), phi.T @ goal)
    f = phi @ w

    def loss(s: float) -> float:
        z = s * f
        return float((np.log(np.exp(z - z.max(axis=1, keepdims=True)).sum(axis=1)) + z.max(axis=1) - z[np.arange(len(y)), y]).mean())

    m.sharpness = min((1.0, 2.0, 3.0, 4.0, 6.0), key=loss)
    m.weights = np.vstack([root @ w[:-1], w[-1:]]).astype(np.float32)
    return m


def identify(docs: DataFrame, lang: str = "lang", carry: list[str] | None = None) -> DataFrame:
    """One row per document: the columns in carry (doc_id, if none are given), lang_pred, score."""
    rows = columns(docs, doc_id="long", text="string")
    labels = columns(docs, doc_id="long", **{lang: "string"}).where(crc_mod(F.col("doc_id"), 3) != 1)
    model = fit(labelled_texts(rows, labels.select("doc_id", F.col(lang).alias("label")), TRAIN_DOCUMENTS, TRAIN_BYTES))

    def predict(batches):
        import re

        import pyarrow as pa

        letter = re.compile(r"[^\W\d_]").search
        for b in batches:
            n = b.num_rows
            pred, score = np.full(n, "und", object), np.zeros(n)
            rows, texts, size = [], [], 0
            for i, x in enumerate(b.column(0)):
                text = x.as_py()
                if model and text and letter(text):
                    rows.append(i)
                    texts.append(text)
                    size += len(text)
                if texts and (len(texts) == BLOCK_ROWS or i == n - 1 or size > 4 * BLOCK_CHARS):
                    p = model.probabilities(presence(texts))
                    best = p.argmax(axis=1)
                    pred[rows] = [model.classes[k] for k in best]
                    score[rows] = p[np.arange(len(p)), best]
                    rows, texts, size = [], [], 0
            if texts:
                raise AssertionError("a block was left")
            yield carried(b, pa.array(pred.tolist(), pa.string()), pa.array(score), names=["lang_pred", "score"])

    return with_carried(docs, carry).mapInArrow(lean(predict), carried_schema(docs, carry, FOUND))


def query(spark, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents")).select("doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")
