"""Keyset pages, listings by prefix and delimiter, and walks over versions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def keyset(df: DataFrame, keys: list[str], after: list[Column] | None, size: int) -> DataFrame:
    """The `size` rows behind the marker in key order; a top-k, so nothing is sorted as a whole."""
    if after:
        ahead = [reduce(lambda x, y: x & y, [F.col(k) == a for k, a in list(zip(keys, after))[:i]] + [F.col(keys[i]) > after[i]]) for i in range(len(keys))]
        df = df.where(reduce(lambda x, y: x | y, ahead))
    return df.orderBy(*keys).limit(size)


def page_with_markers(df: DataFrame, keys: list[str], after: list[Column] | None, size: int) -> tuple[list, bool, tuple | None]:
    """(rows, whether more follow, marker for the next page). One row more than the page is asked for."""
    rows = keyset(df, keys, after, size + 1).collect()
    more, rows = len(rows) > size, rows[:size]
    return rows, more, tuple(rows[-1][k] for k in keys) if more else None


def list_keys(df: DataFrame, key: str, prefix: str, delimiter: str, most: int, after: str | None = None) -> DataFrame:
    """Distinct entries below a prefix: keys, or common prefixes up to the next delimiter."""
    rest = F.substring(F.col(key), F.lit(len(prefix) + 1), F.length(key))
    at = F.instr(rest, delimiter) if delimiter else F.lit(0)
    entry = F.when(at > 0, F.concat(F.lit(prefix), F.substring(rest, F.lit(1), at + len(delimiter) - 1))).otherwise(F.col(key))
    out = df.where(F.col(key).startswith(prefix)).select(entry.alias("entry"), (at > 0).alias("is_prefix")).distinct()
    return (out.where(F.col("entry") > after) if after is not None else out).orderBy("entry").limit(most)


def walk(df: DataFrame, key: str, version: str, marker=None, latest_only: bool = False, descending: bool = True, most: int | None = None) -> DataFrame:
    if marker is not None:
        df = df.where(F.col(key) > marker)
    order = F.desc(version) if descending else F.asc(version)
    if latest_only:
        df = df.withColumn("_rn", F.row_number().over(W.partitionBy(key).orderBy(F.desc(version)))).where("_rn = 1").drop("_rn")
    return df.orderBy(key, order).limit(most) if most is not None else df
