"""Log lines to events: (timestamp, offset, level, target, message, fields, file, line, node, kind)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Levels in ascending order, and the names that stand for them. Fixed values.
LEVELS = {"TRACE": 0, "DEBUG": 1, "INFO": 2, "WARN": 3, "WARNING": 3, "ERROR": 4}

#: What collectors put before a line, first match wins. Fixed patterns.
PREFIXES = [
    r"^\d{4}-\d\d-\d\dT\S+ (?:stdout|stderr) [FP] ",
    r"^[A-Za-z0-9_.-]+\s*\| ",
    r"^[A-Z][a-z]{2} [ \d]\d \d\d:\d\d:\d\d \S+ [^\s\[]+(?:\[\d+\])?: ",
]


def level_rank(level: Column) -> Column:
    """Rank of a level name in any case, null if it is none."""
    names = F.create_map(*[F.lit(x) for kv in LEVELS.items() for x in kv])
    return F.element_at(names, F.upper(F.trim(level)))


def strip_prefix(line: Column) -> Column:
    out = line
    for p in reversed(PREFIXES):
        out = F.when(F.rlike(line, F.lit(p)), F.regexp_replace(line, p, "")).otherwise(out)
    return out


def offset_of(raw: Column) -> Column:
    """`Z` or the signed offset of an RFC 3339 time, as text, since an instant forgets it."""
    got = F.regexp_extract(raw, r"(Z|[+-]\d\d:\d\d)$", 1)
    return F.when(got != "", got)


KEPT = ("timestamp", "level", "target", "filename", "line_number", "threadName", "threadId", "message")


def field_display(value: Column) -> Column:
    """A JSON string as it is, anything else as compact JSON. get_json_object has unquoted strings already."""
    return value


def parse_lines(lines: DataFrame) -> DataFrame:
    """lines(node, file, line, text). A JSON object with a message or a level is an event of kind json; else text.

    Times and levels that can't be read stay in fields, as timestamp_raw and level_raw.
    """
    body = strip_prefix(F.col("text"))
    fields = F.from_json(body, "map<string,string>")
    t = lines.withColumn("body", body).withColumn("j", fields)
    is_json = F.col("j").isNotNull() & (F.map_contains_key("j", F.lit("message")) | F.map_contains_key("j", F.lit("level")))
    raw, level = F.element_at("j", "timestamp"), F.element_at("j", "level")
    t = t.where(F.trim("text") != "").withColumn("is_json", F.coalesce(is_json, F.lit(False)))
    when = F.when(F.col("is_json"), F.try_to_timestamp(raw))
    rank = F.when(F.col("is_json"), level_rank(level))
    extra = F.map_filter("j", lambda k, v: ~k.isin(*KEPT))
    bad_time = F.when(raw.isNotNull() & when.isNull(), F.create_map(F.lit("timestamp_raw"), raw)).otherwise(F.create_map().cast("map<string,string>"))
    bad_level = F.when(level.isNotNull() & rank.isNull(), F.create_map(F.lit("level_raw"), level)).otherwise(F.create_map().cast("map<string,string>"))
    return t.select(
        "node",
        "file",
        "line",
        when.alias("timestamp"),
        F.when(F.col("is_json"), offset_of(raw)).alias("offset"),
        rank.alias("level"),
        F.when(F.col("is_json"), F.element_at("j", "target")).alias("target"),
        F.when(F.col("is_json"), F.coalesce(F.element_at("j", "message"), F.lit(""))).otherwise(F.col("body")).alias("message"),
        F.when(F.col("is_json"), F.map_concat(extra, bad_time, bad_level)).otherwise(F.create_map().cast("map<string,string>")).alias("fields"),
        F.when(F.col("is_json"), "json").otherwise("text").alias("kind"),
    )


#: Headers with the payload on the next line, and with the payload quoted in the header. Fixed patterns.
PANIC_NEW = r"^thread '([^']*)' panicked at (.+:\d+(?::\d+)?):$"
PANIC_OLD = r"^thread '([^']*)' panicked at '(.*)', (.+:\d+(?::\d+)?)$"
#: Lines behind the payload that belong to the block. Fixed pattern.
TRACE_LINE = r"^(?:\s.*|stack backtrace:|note: .*)$"
TRUNCATED = "…[truncated]"


def fold_panics(lines: DataFrame, most: int = 8192) -> DataFrame:
    """Panic blocks become one row of kind panic each; other lines stay, with kind line and no fields.

    A header without payload takes the next line as it, unless that is a header or a JSON object; then indented lines,
    `stack backtrace:` and notes belong to the block, up to the first other line. fields has panic_thread,
    panic_location and panic_full: the lines, as long as they keep to `most` bytes, then a mark.
    A block is the lines from one header on, so it is small however long its file is.
    """
    w = W.partitionBy("node", "file").orderBy("line")
    fresh, old = F.rlike("text", F.lit(PANIC_NEW)), F.rlike("text", F.lit(PANIC_OLD))
    t = lines.withColumn("fresh", fresh).withColumn("head", fresh | old)
    t = t.withColumn("block", F.sum(F.col("head").cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    inside = W.partitionBy("node", "file", "block").orderBy("line")
    payload = F.coalesce(F.lag("fresh").over(inside), F.lit(False))
    belongs = F.col("head") | F.when(payload, ~F.ltrim("text").startswith("{")).otherwise(F.rlike("text", F.lit(TRACE_LINE)))
    t = t.withColumn("in_block", (F.col("block") > 0) & belongs)
    ended = F.max((~F.col("in_block")).cast("int")).over(inside.rowsBetween(W.unboundedPreceding, 0))
    t = t.withColumn("panic", ended == 0)
    rows = F.array_sort(F.collect_list(F.struct("line", "text", "fresh")))
    folded = t.where("panic").groupBy("node", "file", "block").agg(rows.alias("rows")).withColumn("first", F.element_at("rows", 1))
    text = F.col("first.text")
    start = F.struct(text.alias("full"), F.lit(False).alias("cut"))
    too_long = lambda acc, x: F.octet_length(acc["full"]) + 1 + F.octet_length(x["text"]) > most
    step = lambda acc, x: F.when(acc["cut"], acc).when(too_long(acc, x), F.struct(F.concat(acc["full"], F.lit("\n" + TRUNCATED)).alias("full"), F.lit(True).alias("cut"))).otherwise(F.struct(F.concat(acc["full"], F.lit("\n"), x["text"]).alias("full"), F.lit(False).alias("cut")))
    full = F.aggregate(F.slice("rows", F.lit(2), F.size("rows")), start, step)["full"]
    is_new = F.col("first.fresh")
    part = lambda new, old: F.when(is_new, F.regexp_extract(text, PANIC_NEW, new)).otherwise(F.regexp_extract(text, PANIC_OLD, old))
    said = F.trim(F.when(is_new, F.coalesce(F.get("rows", F.lit(1))["text"], F.lit(""))).otherwise(F.regexp_extract(text, PANIC_OLD, 2)))
    message = F.concat(F.lit("thread '"), part(1, 1), F.lit("' panicked at "), part(2, 3), F.lit(": "), said)
    fields = F.create_map(F.lit("panic_thread"), part(1, 1), F.lit("panic_location"), part(2, 3), F.lit("panic_full"), full)
    folded = folded.select("node", "file", F.col("first.line").alias("line"), message.alias("text"), F.lit("panic").alias("kind"), fields.alias("fields"))
    others = t.where("not panic").select("node", "file", "line", "text", F.lit("line").alias("kind"), F.create_map().cast("map<string,string>").alias("fields"))
    return folded.unionByName(others)


def parse_stats(events: DataFrame, total: int) -> DataFrame:
    n = lambda k: F.sum((F.col("kind") == k).cast("int")).alias(k)
    return events.agg(n("json"), n("text"), n("panic")).withColumn("total", F.lit(total)).withColumn("json_ratio", F.col("json") / F.greatest(F.lit(1), F.lit(total)))


def time_argument(text: str, now):
    """An RFC 3339 time, or `30m`, `24h`, `7d` back from now. Raises ValueError for others."""
    import datetime
    import re

    m = re.fullmatch(r"(\d+)([mhd])", text)
    if m:
        return now - datetime.timedelta(minutes=int(m[1]) * {"m": 1, "h": 60, "d": 1440}[m[2]])
    return datetime.datetime.fromisoformat(text)


def filter_events(events: DataFrame, since=None, until=None, least_level: int | None = None) -> DataFrame:
    """Bounds are inclusive; events without time or level pass."""
    ts, lv = F.col("timestamp"), F.col("level")
    if since is not None:
        events = events.where(ts.isNull() | (ts >= F.lit(since)))
    if until is not None:
        events = events.where(ts.isNull() | (ts <= F.lit(until)))
    return events if least_level is None else events.where(lv.isNull() | (lv >= least_level))
