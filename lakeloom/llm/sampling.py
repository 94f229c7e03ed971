"""Bounded samples of labelled documents, for fitting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def labelled_texts(docs: DataFrame, labels: DataFrame, n: int, most_bytes: int) -> list[tuple[str, object]]:
    """(text, label) of at most n documents of at most most_bytes bytes, those whose ids hash lowest.

    docs(doc_id, text), labels(doc_id, label). Ids are chosen first, so whole texts are read, but only those chosen
    are sent; what reaches the driver is at most n * most_bytes.
    """
    ids = labels.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    got = docs.where(F.octet_length("text") <= most_bytes).join(F.broadcast(ids), "doc_id").select("doc_id", "text", "label").limit(2 * n).collect()
    return [(r["text"], r["label"]) for r in sorted(got, key=lambda r: (r["doc_id"], r["text"]))][:n]
