"""Rolling counts, exponentially weighted averages, order statistics. Averages run over an explicit order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def rolling(df: DataFrame, by: list[str], second: str, value: Column, width: int) -> DataFrame:
    """Count and total over the last `width` seconds, this one included."""
    w = W.partitionBy(*by).orderBy(second).rangeBetween(-(width - 1), 0)
    return df.withColumn("n", F.count("*").over(w)).withColumn("total", F.sum(value).over(w))


def moving_average(df: DataFrame, by: list[str], order: list[str], value: str, alpha: float, first: bool = True, spans: tuple[int, ...] = (60, 86400), once: bool = False) -> DataFrame:
    """y <- alpha * x + (1 - alpha) * y from zero over each key's values in order (order[0] is a time), as `result`.

    first: an average of zero takes its next sample whole; values are then not negative (rates, sizes, times), so that an
    average is not zero again once it is set. Nulls are passed over; a key with nulls alone has zero.
    once: only the first sample is taken whole, whatever it is; values may be negative; a key with nulls alone has null.

    Steps in a row make a map y -> a * y + b, beside s, what they make of the start (zero; once: null). Rows are folded in slices of spans[0]
    seconds, slices in those of the next span (a multiple), the last by key: no array holds more than one slice's rows or
    one span's slices, whatever share of the rows a key has.
    """
    take, leave = F.lit(float(alpha)), F.lit(1.0 - alpha)
    unset = (lambda s: s.isNull()) if once else (lambda s: s == 0)

    def step(acc, x):
        v = x["_v"]
        s = take * v + leave * acc["s"]
        s = F.when(unset(acc["s"]), v).otherwise(s) if first or once else s
        return F.when(v.isNull(), acc).otherwise(F.struct(s.alias("s"), (leave * acc["a"]).alias("a"), (take * v + leave * acc["b"]).alias("b")))

    def after(acc, x):
        m = x["_m"]
        s = F.when(unset(acc["s"]), m["s"]).otherwise(m["a"] * acc["s"] + m["b"])
        return F.struct(s.alias("s"), (m["a"] * acc["a"]).alias("a"), (m["a"] * acc["b"] + m["b"]).alias("b"))

    start = F.struct(F.lit(None if once else 0.0).cast("double").alias("s"), F.lit(1.0).alias("a"), F.lit(0.0).alias("b"))
    series = lambda *c: F.array_sort(F.collect_list(F.struct(*c))).alias("_x")
    slice_of = lambda at, span: (F.floor(at / span) * span).alias("_at")
    rows = series(*order, F.col(value).cast("double").alias("_v"))
    t = df.groupBy(*by, slice_of(F.unix_seconds(F.col(order[0]).cast("timestamp")), spans[0])).agg(rows).withColumn("_m", F.aggregate("_x", start, step))
    for span in spans[1:]:
        t = t.groupBy(*by, slice_of(F.col("_at"), span)).agg(series("_at", "_m")).withColumn("_m", F.aggregate("_x", start, after))
    return t.groupBy(*by).agg(series("_at", "_m")).select(*by, F.aggregate("_x", start, after, lambda acc: acc["s"]).alias("result"))


def tier(rate: Column, low: float, high: float) -> Column:
    return F.when(rate.isNull() | (rate <= 0), "Unknown").when(rate < low, "Low").when(rate < high, "Medium").otherwise("High")


def last_percentiles(df: DataFrame, by: list[str], order: list[Column], value: str, keep: int = 1000, points=(0.95, 0.99)) -> DataFrame:
    """Of the last `keep` samples the mean, and sorted[floor(n * p)] (the last, if that is beyond)."""
    w = W.partitionBy(*by).orderBy(*order)
    t = df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= keep)
    t = t.groupBy(*by).agg(F.array_sort(F.collect_list(value)).alias("s"), F.avg(value).alias("mean"))
    at = lambda p: F.element_at("s", F.least(F.floor(F.size("s") * p) + 1, F.size("s")).cast("int"))
    return t.select(*by, "mean", *[at(p).alias(f"p{round(p * 100)}") for p in points])


def prometheus(df: DataFrame, labels: list[str], metrics: list[str]) -> DataFrame:
    """(name, labels, value) rows."""
    tags = F.create_map(*[x for c in labels for x in (F.lit(c), F.col(c).cast("string"))])
    return df.select(F.explode(F.array(*[F.struct(F.lit(m).alias("name"), tags.alias("labels"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("m")).select("m.*")


def rolling_seconds(rows: DataFrame, sec: str, counted: Column, spans: dict[str, int]) -> DataFrame:
    """For each second that has rows, how many counted rows lie in the last `span` seconds and it, over all rows.

    Rows are summed by second first; a window holds a slice of time and the seconds before it that its spans reach, so
    slices are tasks of bounded size whatever the keys.
    """
    most = max(spans.values())
    by_second = rows.groupBy(sec).agg(F.count_if(counted).alias("_n"))
    sliced = by_second.withColumn("_own", F.floor(F.col(sec) / most)).withColumn("_slice", F.explode(F.array("_own", F.col("_own") + 1)))
    w = lambda n: W.partitionBy("_slice").orderBy(sec).rangeBetween(-n, 0)
    return sliced.select(sec, "_own", "_slice", *[F.sum("_n").over(w(n)).alias(k) for k, n in spans.items()]).where("_own = _slice").drop("_own", "_slice")
