"""The rest of the inventory: join strategies, scalar rules, parse counters, pages by token, deliveries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lakeloom.logs import diagnose, parse, report
from lakeloom.operators import pagination
from lakeloom.plans.build import Registry, read
from lakeloom.plans.logs import RULES, log_events
from lakeloom.rules import conditions as C
from lakeloom.rules import objects as O
from lakeloom.session import shared_dir
from lakeloom.sources import readers, sinks
from lakeloom.streaming import streams
from lakeloom.tables import maintenance as M

R = Registry()

for _name, _hint in (("jn_hash", "shuffle_hash"), ("jn_merge", "merge")):

    @R.query(_name, "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 5000")
    def _(s, d, hint=_hint):
        c = read(s, d, "customer").where("c_acctbal > 5000").select("c_custkey", "c_name").hint(hint)
        return read(s, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


@R.query("jn_bcast", "SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def _(s, d):
    return read(s, d, "supplier").join(F.broadcast(read(s, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")  # a fixed table of nations


@R.query("jn_nl", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey < r_regionkey")
def _(s, d):
    return read(s, d, "nation").join(F.broadcast(read(s, d, "region")), F.col("n_regionkey") < F.col("r_regionkey")).select("n_name", "r_name")  # a fixed table of regions


@R.query("jn_ext_rules", "SELECT coalesce(b.k, a.k) AS id, coalesce(b.v, a.v) AS severity FROM (VALUES ('a', 1), ('b', 2)) a(k, v) FULL JOIN (VALUES ('b', 9), ('c', 3)) b(k, v) ON a.k = b.k")
def _(s, d):
    rules = diagnose.override([{"id": "a", "severity": 1}, {"id": "b", "severity": 2}], [{"id": "b", "severity": 9}, {"id": "c", "severity": 3}])
    return s.createDataFrame([(r["id"], r["severity"]) for r in rules], "id string, severity int")


@R.query("fn_matcher", "SELECT event_id, event_type = 'error' OR (event_type LIKE 'v%' AND user_id < 10) AS hit FROM events")
def _(s, d):
    m = {"any": [{"min_level": 4}, {"all": [{"message_prefix": "v"}, {"message_regex": " [0-9]$"}]}]}
    return log_events(s, d).select("event_id", diagnose.matcher(m).alias("hit"))


@R.query("fn_ruleset_valid", "SELECT 'x: repeated id' AS problem UNION ALL SELECT 'x: empty group'")
def _(s, d):
    bad = [{"id": "x", "match": {"message_prefix": "a"}}, {"id": "x", "match": {"all": []}}]
    return s.createDataFrame([(p,) for p in diagnose.check_rules(bad)], "problem string")


@R.query("fn_offset", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'Z' ELSE '+05:30' END AS off FROM customer")
def _(s, d):
    raw = F.concat(F.lit("2024-01-01T00:00:00"), F.when(F.col("c_custkey") % 2 == 0, "Z").otherwise("+05:30"))
    return read(s, d, "customer").select("c_custkey", parse.offset_of(raw).alias("off"))


@R.query("fn_prefix_strip", "SELECT n_nationkey, n_name AS line FROM nation")
def _(s, d):
    k = F.col("n_nationkey") % 3
    before = F.when(k == 0, "2024-01-01T00:00:00.1Z stdout F ").when(k == 1, "svc-1 | ").otherwise("Jan  2 10:00:00 host svc[12]: ")
    return read(s, d, "nation").select("n_nationkey", parse.strip_prefix(F.concat(before, F.col("n_name"))).alias("line"))


@R.query("fn_text_fallback", "SELECT r_regionkey::BIGINT AS line, 'text' AS kind FROM region")
def _(s, d):
    lines = read(s, d, "region").select(F.lit("n").alias("node"), F.lit("f").alias("file"), F.col("r_regionkey").cast("bigint").alias("line"), F.col("r_name").alias("text"))
    return parse.parse_lines(lines).select("line", "kind")


@R.query("fn_field_display", """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'plain' ELSE '{"a":[1,2]}' END AS shown FROM events""")
def _(s, d):
    doc = F.when(F.col("event_id") % 2 == 0, '{"v":"plain"}').otherwise('{"v":{"a":[1,2]}}')
    return read(s, d, "events").select("event_id", parse.field_display(F.get_json_object(doc, "$.v")).alias("shown"))


@R.query("fn_time_arg", "SELECT '2024-01-01 00:00:00' AS since")
def _(s, d):
    import datetime

    return s.createDataFrame([(str(parse.time_argument("7d", datetime.datetime(2024, 1, 8))),)], "since string")


@R.query("agg_parsestats", "SELECT count(*) AS json, 0::BIGINT AS text, 0::BIGINT AS panic, count(*) AS total, 1.0::DOUBLE AS json_ratio FROM events")
def _(s, d):
    t = log_events(s, d)
    return parse.parse_stats(t, t.count()).withColumn("total", F.col("total").cast("bigint"))


@R.query("agg_topn", "SELECT event_type || ' by user <n>' AS template, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, template LIMIT 3")
def _(s, d):
    return diagnose.clusters(log_events(s, d)).orderBy(F.desc("n"), "template").limit(3).select("template", "n")


@R.query("fn_pattern", "SELECT 'uploads/*.csv' AS p UNION ALL SELECT 'images/*' UNION ALL SELECT '*.jpg'")
def _(s, d):
    return s.createDataFrame([(C.key_pattern(*x),) for x in (("uploads/", ".csv"), ("images/",), ("", ".jpg"))], "p string")


@R.query("fn_tag_filter", "SELECT doc_id, lang = 'en' AND source = 'src0' AS ok FROM documents")
def _(s, d):
    return read(s, d, "documents").select("doc_id", O.tag_filter(F.create_map(F.lit("l"), F.col("lang"), F.lit("s"), F.col("source")), {"l": "en", "s": "src0"}).alias("ok"))


@R.query("fn_life_valid", "SELECT 'exactly one of days and date' AS problem UNION ALL SELECT 'negative days'")
def _(s, d):
    return s.createDataFrame([(O.check_transition(t),) for t in ({}, {"days": -1})], "problem string")


@R.query("fn_repl_prefix", "SELECT DISTINCT source, source LIKE 'src1%' OR 'src1' LIKE source || '%' AS active FROM documents")
def _(s, d):
    return read(s, d, "documents").select("source").distinct().select("source", O.active_prefix(F.col("source"), "src1", True).alias("active"))


@R.query("win_priority", "SELECT doc_id, CASE WHEN source LIKE 'src1%' THEN 'b' ELSE 'a' END AS rule FROM documents")
def _(s, d):
    rules = [{"id": "a", "to": "x", "priority": 1, "prefix": "src"}, {"id": "b", "to": "x", "priority": 2, "prefix": "src1"}]
    return read(s, d, "documents").select("doc_id", O.replication_target(F.col("source"), F.create_map(F.lit("k"), F.lit("v")), rules).alias("rule"))


@R.query("fn_ice_kind", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'data' ELSE 'delete' END AS kind FROM pages")
def _(s, d):
    key = F.concat(F.lit("t/data/p=1/"), F.col("page_id"), F.when(F.col("page_id") % 2 == 0, ".parquet").otherwise("-deletes.parquet"))
    return read(s, d, "pages").select("page_id", M.object_kind(key).alias("kind"))


@R.query("fn_ice_safety", "SELECT event_id AS key FROM events WHERE ts <= (SELECT max(ts) FROM events) - INTERVAL 15 MINUTE")
def _(s, d):
    t = read(s, d, "events").select(F.col("event_id").alias("key"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("modified_s"))
    none = s.createDataFrame([], "key long, review boolean")
    return M.unreferenced(t, none, t.agg(F.max("modified_s")).first()[0]).select("key")


@R.query("pag_ice", "SELECT n_name FROM nation WHERE n_name > 'FRANCE' ORDER BY n_name LIMIT 5")
def _(s, d):
    return pagination.keyset(read(s, d, "nation"), ["n_name"], [F.lit("FRANCE")], 5).select("n_name")


@R.query("src_parquet_range", "SELECT n_nationkey FROM nation")
def _(s, d):
    import glob

    at = f"{shared_dir(s)}/sources/groups-{uuid.uuid4().hex}"
    read(s, d, "nation").coalesce(1).write.parquet(at)
    local = at.removeprefix("file://")
    return readers.parquet_row_groups(s, glob.glob(f"{local}/part-*.parquet")[0], 0, 1 << 40).select("n_nationkey")


@R.query("src_snapshot", "SELECT r_name FROM region")
def _(s, d):
    at = f"{shared_dir(s)}/sources/pinned-{uuid.uuid4().hex}"
    read(s, d, "region").select("r_name").write.parquet(at)
    files = readers.pinned(s, at, ".parquet")
    read(s, d, "region").select("r_name").write.mode("append").parquet(at)
    return s.read.parquet(*files)


@R.query("src_inmem", "SELECT * FROM (VALUES ('Alice', 30), ('Bob', 25)) t(name, age)")
def _(s, d):
    return s.createDataFrame([("Alice", 30), ("Bob", 25)], "name string, age int")


@R.query("snk_stream", "SELECT r_name FROM region")
def _(s, d):
    import json

    rows = [json.loads(r) for kind, part in sinks.events(read(s, d, "region")) for r in part if kind == "Records"]
    return s.createDataFrame([(r["r_name"],) for r in rows], "r_name string")


@R.query("snk_report")
def _(s, d):
    found = diagnose.order_findings(diagnose.findings(log_events(s, d), RULES))
    return s.createDataFrame([(f, report.render(found, f)) for f in ("text", "markdown", "json")], "form string, report string")


@R.query("snk_event", "SELECT event_id FROM events WHERE event_type = 'error'")
def _(s, d):
    home = f"{shared_dir(s)}/sources/events-{uuid.uuid4().hex}"
    t = streams.events(s, d).where("event_type = 'error'").select("event_id")
    sinks.deliver(t, lambda df, i: df.write.mode("overwrite").parquet(f"{home}/batch={i}"), f"{home}-check").awaitTermination()
    return s.read.schema("event_id long, batch int").parquet(home).select("event_id")
