"""Functions that Spark lacks, or that differ in it, as column expressions; and the registration of user functions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def concat_skip_nulls(*cols: Column) -> Column:
    """Spark's concat is null if any part is; this one skips nulls."""
    return F.concat(*[F.coalesce(c.cast("string"), F.lit("")) for c in cols])


def epoch_seconds(ts: Column) -> Column:
    return F.unix_seconds(ts.cast("timestamp"))


def date_bin(ts: Column, width: int) -> Column:
    """Start of the bin of so many seconds, counted from the epoch, before it too."""
    return F.timestamp_seconds(F.floor(epoch_seconds(ts) / width) * width)


def gcd(a: Column, b: Column) -> Column:
    """Euclid's steps as a fold over a fixed number of turns: 64-bit numbers need 92 at most."""
    start = F.struct(F.abs(a.cast("bigint")).alias("a"), F.abs(b.cast("bigint")).alias("b"))
    turn = lambda acc, _: F.when(acc["b"] == 0, acc).otherwise(F.struct(acc["b"].alias("a"), (acc["a"] % F.greatest(acc["b"], F.lit(1))).alias("b")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(92)), start, turn, lambda acc: acc["a"])


def lcm(a: Column, b: Column) -> Column:
    g = gcd(a, b)
    return F.when(g == 0, F.lit(0)).otherwise((F.abs(a * b) / g).cast("bigint"))


def trunc_number(x: Column) -> Column:
    return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("double")


def parent_path(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def expand_ellipsis(pattern: str) -> Column:
    """`name{1...4}` as an array of names; without braces an array of the pattern itself."""
    m = re.fullmatch(r"(.*)\{(\d+)\.\.\.(\d+)\}(.*)", pattern)
    if not m:
        return F.array(F.lit(pattern))
    width = len(m[2]) if m[2].startswith("0") and len(m[2]) > 1 else 0
    number = lambda i: F.lpad(i.cast("string"), width, "0") if width else i.cast("string")
    return F.transform(F.sequence(F.lit(int(m[2])), F.lit(int(m[3]))), lambda i: F.concat(F.lit(m[1]), number(i), F.lit(m[4])))


def human_bytes(n: Column) -> Column:
    out = F.concat(n.cast("string"), F.lit(" B"))
    for unit, size in (("KiB", 1 << 10), ("MiB", 1 << 20), ("GiB", 1 << 30), ("TiB", 1 << 40)):
        out = F.when(n >= size, F.format_string(f"%.1f {unit}", n / F.lit(float(size)))).otherwise(out)
    return out


def human_duration(seconds: Column) -> Column:
    return F.when(seconds < 60, F.concat(seconds.cast("string"), F.lit("s"))).when(seconds < 3600, F.concat(F.floor(seconds / 60).cast("string"), F.lit("m"))).otherwise(
        F.concat(F.floor(seconds / 3600).cast("string"), F.lit("h"), F.floor(seconds % 3600 / 60).cast("string"), F.lit("m"))
    )


def spread_udaf():
    def spread(x: pd.Series) -> int:
        return int(x.max() - x.min()) if len(x) else 0

    return F.pandas_udf(spread, "int")


def register(spark: SparkSession) -> None:
    """User functions under names that SQL can call: scalar and table functions."""
    def twice(x: pd.Series) -> pd.Series:
        return x * 2

    class Words:
        def eval(self, text: str):
            for w in (text or "").split():
                yield (w,)

    spark.udf.register("twice", F.pandas_udf(twice, "int"))
    spark.udtf.register("words_of", F.udtf(Words, returnType="word string"))
