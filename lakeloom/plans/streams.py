"""Streams over the events table, and sources and sinks over small files written for the purpose."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lakeloom.plans.build import Registry, read
from lakeloom.rules import objects as O
from lakeloom.session import shared_dir
from lakeloom.sources import readers, sinks
from lakeloom.streaming import streams

R = Registry()
_FMT = "yyyy-MM-dd HH:mm:ss"


@R.query("str_tumble", "SELECT strftime(time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def _(s, d):
    out = streams.run(streams.tumbling(streams.events(s, d), "1 day", "1 hour"), "complete", "tumble")
    return out.select(F.date_format("window.start", _FMT).alias("start"), "event_type", "n")


@R.query("str_slide", "SELECT strftime(time_bucket(INTERVAL 12 HOUR, ts, TIMESTAMP '1970-01-01') - k * INTERVAL 12 HOUR, '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM events, (VALUES (0), (1)) v(k) GROUP BY 1, 2")
def _(s, d):
    out = streams.run(streams.sliding(streams.events(s, d), "1 day", "12 hours", "1 hour"), "complete", "slide")
    return out.select(F.date_format("window.start", _FMT).alias("start"), "event_type", "n")


@R.query("str_session", "WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 1 DAY THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, sid")
def _(s, d):
    out = streams.run(streams.sessions(streams.events(s, d), "1 day", "1 hour"), "complete", "session")
    return out.select("user_id", F.date_format("session_window.start", _FMT).alias("start"), "n")


@R.query("str_watermark", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM events WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE GROUP BY 1, 2")
def _(s, d):
    """Only windows that the watermark has closed are given; the last stay open."""
    out = streams.run(streams.tumbling(streams.events(s, d), "1 hour", "10 minutes"), "append", "watermark")
    return out.select(F.date_format("window.start", _FMT).alias("start"), "event_type", "n")


@R.query("str_late", "SELECT event_id FROM events")
def _(s, d):
    t = streams.events(s, d)
    return streams.run(streams.once(t.union(t), ["event_id"], "1 hour").select("event_id"), "append", "late")


@R.query("str_route", "SELECT event_id, CASE event_type WHEN 'error' THEN 'hook' ELSE 'queue' END AS target FROM events WHERE event_type IN ('error', 'view')")
def _(s, d):
    subs = [{"events": ["error"], "pattern": "*", "target": "hook"}, {"events": ["view"], "pattern": "u*", "target": "queue"}]
    t = streams.events(s, d).withColumn("key", F.concat(F.lit("u"), F.col("user_id")))
    return streams.run(O.route(t, "event_type", "key", subs).select("event_id", "target"), "append", "route")


@R.query("str_ema_live", "SELECT user_id, round(list_reduce(list(value ORDER BY ts, event_id), lambda a, x: 0.1 * x + 0.9 * a), 8) AS ema, count(*) AS n FROM events GROUP BY 1")
def _(s, d):
    out = streams.run(streams.keyed_ema(streams.events(s, d), "user_id", "value", 0.1), "update", "ema", ["user_id"])
    return out.select("user_id", F.round("ema", 8).alias("ema"), "n")


def _home(s, what):
    return f"{shared_dir(s)}/sources/{what}-{uuid.uuid4().hex}"


@R.query("src_csv", "SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name FROM nation")
def _(s, d):
    at = _home(s, "csv")
    read(s, d, "nation").select("n_nationkey", "n_name").write.option("header", "true").option("sep", ";").csv(at)
    return readers.csv(s, at, "USE", field=";")


@R.query("src_csv_ignore", "SELECT CAST(n_nationkey AS VARCHAR) AS _1, n_name AS _2 FROM nation")
def _(s, d):
    at = _home(s, "csv")
    read(s, d, "nation").select("n_nationkey", "n_name").coalesce(1).write.option("header", "true").csv(at)
    return readers.csv(s, at, "IGNORE")


@R.query("src_json_lines", "SELECT r_regionkey::BIGINT AS r_regionkey, r_name FROM region")
def _(s, d):
    at = _home(s, "json")
    read(s, d, "region").write.json(at)
    return readers.json_lines(s, at, "r_regionkey long, r_name string")


@R.query("src_json_doc", "SELECT r_regionkey::BIGINT AS r_regionkey, r_name FROM region")
def _(s, d):
    at = _home(s, "doc")
    whole = read(s, d, "region").agg(F.to_json(F.struct(F.collect_list(F.struct("r_regionkey", "r_name")).alias("rows"))).alias("value"))
    whole.write.text(at)
    return readers.json_document(s, at, "rows").select("r_regionkey", "r_name")


@R.query("src_parquet", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > 45")
def _(s, d):
    return read(s, d, "lineitem").where("l_quantity > 45").select("l_orderkey", "l_quantity")


@R.query("src_compress", "SELECT r_name FROM region")
def _(s, d):
    at = _home(s, "gz")
    read(s, d, "region").select("r_name").write.option("compression", "gzip").text(at)
    return s.read.text(at).select(F.col("value").alias("r_name"))


@R.query("src_text_range", "SELECT lpad(CAST(i AS VARCHAR), 6, '0') AS text FROM range(1000) t(i) WHERE i * 7 BETWEEN 700 AND 1400")
def _(s, d):
    at = _home(s, "range")
    s.range(1000).select(F.lpad(F.col("id").cast("string"), 6, "0")).coalesce(1).write.text(at)
    return readers.text_range(s, at, 700, 1400).select("text")


@R.query("src_codec", "SELECT r_name, CASE r_regionkey WHEN 0 THEN 'gzip' WHEN 1 THEN 'zstd' ELSE 'unknown' END AS codec FROM region")
def _(s, d):
    name = F.concat("r_name", F.when(F.col("r_regionkey") == 0, ".GZ").when(F.col("r_regionkey") == 1, ".zst").otherwise(".log"))
    return read(s, d, "region").select("r_name", readers.codec_of(name).alias("codec"))


@R.query("src_binary_skip", "SELECT r_name, r_regionkey < 2 AS bin FROM region")
def _(s, d):
    content = F.when(F.col("r_regionkey") < 2, F.unhex(F.lit("0041420043"))).otherwise(F.encode("r_name", "UTF-8"))
    return read(s, d, "region").select("r_name", readers.looks_binary(content).alias("bin"))


_LINE = "event_id long, event_type string"


@R.query("src_log", "SELECT event_id, event_type FROM events")
def _(s, d):
    at = _home(s, "logs")
    read(s, d, "events").select(F.to_json(F.struct("event_id", "event_type"))).write.text(f"{at}/node1")
    return readers.logs(s, at).where("node = 'node1'").select(F.from_json("text", _LINE).alias("e")).select("e.*")


@R.query("src_archive", "SELECT event_id, event_type FROM events")
def _(s, d):
    at = _home(s, "arch")
    read(s, d, "events").select(F.to_json(F.struct("event_id", "event_type"))).write.option("compression", "gzip").text(f"{at}/node1")
    return readers.archives(s, at).where("line > 0").select(F.from_json("text", _LINE).alias("e")).select("e.*")


@R.query("src_ice_meta", "SELECT n_nationkey AS id, n_nationkey * 10 AS ms FROM nation")
def _(s, d):
    at = _home(s, "meta")
    snaps = F.collect_list(F.struct(F.col("n_nationkey").alias("snapshot-id"), (F.col("n_nationkey") * 10).alias("timestamp-ms")))
    read(s, d, "nation").agg(F.to_json(F.struct(F.lit(2).alias("format-version"), snaps.alias("snapshots"))).alias("value")).write.text(at)
    m = readers.table_metadata(s, at).select(F.explode("snapshots").alias("x"))
    return m.select(F.col("x.`snapshot-id`").cast("int").alias("id"), F.col("x.`timestamp-ms`").cast("int").alias("ms"))


@R.query("snk_csv", "SELECT r_regionkey || ',' || r_name AS record FROM region")
def _(s, d):
    return sinks.csv_records(read(s, d, "region").select("r_regionkey", "r_name"))


@R.query("snk_json", """SELECT '{"r_regionkey":' || r_regionkey || ',"r_name":"' || r_name || '"}' AS record FROM region""")
def _(s, d):
    return sinks.json_records(read(s, d, "region").select("r_regionkey", "r_name"))


@R.query("snk_parquet_compact", "SELECT n_nationkey, n_name FROM nation")
def _(s, d):
    from lakeloom.tables.maintenance import compact

    at = _home(s, "compact")
    compact(read(s, d, "nation").select("n_nationkey", "n_name").repartition(4), at)
    return s.read.parquet(at)
