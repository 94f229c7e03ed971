"""Log diagnosis over the events table (as log events) and the documents table (as messages)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeloom.logs import diagnose, parse, redact
from lakeloom.plans.build import Registry, read

R = Registry()

RULES = [
    {"id": "purchase-large", "severity": 1, "match": {"all": [{"message_prefix": "purchase"}, {"field_equals": ["k", "7"]}]}, "implies": ["error-any"], "evidence": ["k"]},
    {"id": "error-any", "severity": 0, "match": {"any": [{"min_level": 4}, {"is_panic": None}]}, "min_count": 5, "evidence": ["k"]},
    {"id": "view-user", "severity": 3, "match": {"message_regex": "^view by user [0-9]$"}, "implies": ["purchase-large"], "min_count": 10**6},
]
_EV = "SELECT event_id, ts, 'n' || (user_id % 4) AS node, CASE event_type WHEN 'error' THEN 4 WHEN 'purchase' THEN 3 WHEN 'view' THEN NULL ELSE 2 END AS level, event_type || ' by user ' || user_id AS message, json_extract_string(props, '$.k') AS k FROM events"
_HIT = f"SELECT *, unnest(list_filter([CASE WHEN message LIKE 'purchase%' AND k = '7' THEN 'purchase-large' END, CASE WHEN level >= 4 THEN 'error-any' END, CASE WHEN regexp_matches(message, '^view by user [0-9]$') THEN 'view-user' END], lambda x: x IS NOT NULL)) AS rule FROM ({_EV})"


def log_events(s, d):
    kind = F.col("event_type")
    level = F.when(kind == "error", 4).when(kind == "purchase", 3).when(kind == "view", F.lit(None)).otherwise(2)
    return read(s, d, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("timestamp"), F.lit("Z").alias("offset"), F.concat(F.lit("n"), F.col("user_id") % 4).alias("node"), level.alias("level"), F.lit("app").alias("target"),
        F.concat(kind, F.lit(" by user "), F.col("user_id")).alias("message"), F.create_map(F.lit("k"), F.get_json_object("props", "$.k")).alias("fields"), F.lit("f").alias("file"), F.col("event_id").alias("line"), F.lit("json").alias("kind"),
    )


@R.query("fn_template", r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}', '<uuid>', 'g'), '\b[0-9a-fA-F]{16,}\b', '<hex>', 'g'), '\d{4}-\d{2}-\d{2}T[0-9:.]+(?:Z|[+-]\d{2}:\d{2})?', '<ts>', 'g'), '\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?::\d+)?\b', '<addr>', 'g'), '(^|\s)/\S+', '\1<path>', 'g'), '\d+', '<n>', 'g'), '`[^`]*`', '`<q>`', 'g'), '''[^'']*''', '''<q>''', 'g'), '"[^"]*"', '"<q>"', 'g') AS template FROM documents""")
def _(s, d):
    return read(s, d, "documents").select("doc_id", diagnose.template(F.col("text")).alias("template"))


@R.query("agg_cluster", f"WITH t AS (SELECT regexp_replace(message, '\\d+', '<n>', 'g') AS template, level, message FROM ({_EV})) SELECT template, count(*)::BIGINT AS n, max(level) AS level, min(message) AS sample FROM t GROUP BY 1")
def _(s, d):
    return diagnose.clusters(log_events(s, d)).select("template", "n", "level", "sample")


@R.query("agg_cluster_cap", f"WITH t AS (SELECT message AS template, count(*) AS n FROM ({_EV}) GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, template) AS rn FROM t) SELECT CASE WHEN rn <= 20 THEN template ELSE '<overflow>' END AS template, sum(n)::BIGINT AS n FROM r GROUP BY 1")
def _(s, d):
    words = log_events(s, d).withColumn("message", F.translate("message", "0123456789", "abcdefghij"))
    out = diagnose.clusters(words, most=20)
    back = F.translate(F.regexp_extract("template", "([a-j]+)$", 1), "abcdefghij", "0123456789")
    return out.select(F.when(F.col("template") == "<overflow>", F.col("template")).otherwise(F.concat(F.regexp_extract("template", "^(.* )", 1), back)).alias("template"), "n")


@R.query("agg_level", f"SELECT coalesce(CAST(level AS VARCHAR), 'no_level') AS level, count(*) AS n FROM ({_EV}) GROUP BY 1")
def _(s, d):
    return log_events(s, d).groupBy(F.coalesce(F.col("level").cast("string"), F.lit("no_level")).alias("level")).agg(F.count("*").alias("n"))


@R.query("agg_range", f"SELECT node, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS lo, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS hi, count(*) AS n FROM ({_EV}) GROUP BY 1")
def _(s, d):
    f = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return log_events(s, d).groupBy("node").agg(f(F.min("timestamp")).alias("lo"), f(F.max("timestamp")).alias("hi"), F.count("*").alias("n"))


@R.query("agg_set", f"SELECT list_sort(list(DISTINCT node)) AS nodes FROM ({_EV})")
def _(s, d):
    return log_events(s, d).agg(F.array_sort(F.collect_set("node")).alias("nodes"))


@R.query("jn_rule_event", f"SELECT event_id, rule FROM ({_HIT})")
def _(s, d):
    return diagnose.hits(log_events(s, d), RULES).select("event_id", "rule")


@R.query("jn_anti_unmatched", f"SELECT event_id FROM ({_EV}) WHERE level IN (3, 4) AND event_id NOT IN (SELECT event_id FROM ({_HIT}))")
def _(s, d):
    return diagnose.unmatched(log_events(s, d), RULES).select("event_id")


@R.query("agg_finding", f"SELECT rule, count(*) AS n, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_seen, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_seen, list_sort(list(DISTINCT node)) AS nodes, count(*) < CASE rule WHEN 'error-any' THEN 5 WHEN 'view-user' THEN 1000000 ELSE 1 END AS below_min FROM ({_HIT}) GROUP BY 1")
def _(s, d):
    f = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return diagnose.findings(log_events(s, d), RULES).select("rule", "n", f("first_seen"), f("last_seen"), "nodes", "below_min")


@R.query("agg_samples", f"SELECT rule, rn::INTEGER AS rn, message FROM (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY ts, event_id) AS rn FROM ({_HIT})) WHERE rn <= 3")
def _(s, d):
    return diagnose.samples(log_events(s, d), RULES).select("rule", "rn", "message")


@R.query("agg_evidence", f"WITH v AS (SELECT DISTINCT rule, k FROM ({_HIT}) WHERE rule <> 'view-user' AND k IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY k) AS rn FROM v) SELECT rule, 'k' AS field, list(k ORDER BY k) FILTER (rn <= 10) AS values, greatest(count(*) - 10, 0)::BIGINT AS overflow FROM r GROUP BY 1")
def _(s, d):
    return diagnose.evidence(log_events(s, d), RULES)


_CAUSAL = f"WITH f AS (SELECT rule, count(*) AS n, min(ts) AS a, max(ts) AS b FROM ({_HIT}) GROUP BY 1), e(root, symptom) AS (VALUES ('purchase-large', 'error-any'), ('view-user', 'purchase-large')) SELECT symptom, root FROM e JOIN f x ON x.rule = root JOIN f y ON y.rule = symptom WHERE x.a <= y.a + INTERVAL 5 MINUTE AND x.b >= y.a - INTERVAL 30 MINUTE"
_CHAIN = f"WITH RECURSIVE c AS ({_CAUSAL}), up AS (SELECT symptom, root, 1 AS k FROM c UNION ALL SELECT up.symptom, c.root, k + 1 FROM up JOIN c ON c.symptom = up.root WHERE k < 9) SELECT symptom, arg_max(root, k) AS root FROM up GROUP BY 1"


@R.query("jn_causal", _CAUSAL)
def _(s, d):
    return diagnose.causes(diagnose.findings(log_events(s, d), RULES), RULES)


@R.query("jn_causal_chain", _CHAIN)
def _(s, d):
    return diagnose.final_roots(diagnose.causes(diagnose.findings(log_events(s, d), RULES), RULES))


@R.query("srt_findings", f"SELECT rule, count(*) AS n FROM ({_HIT}) GROUP BY 1 ORDER BY n DESC")
def _(s, d):
    return diagnose.order_findings(diagnose.findings(log_events(s, d), RULES)).select("rule", "n")


@R.query("srt_block", f"WITH f AS (SELECT rule, count(*) AS n, CASE rule WHEN 'error-any' THEN 0 WHEN 'purchase-large' THEN 1 ELSE 3 END AS severity FROM ({_HIT}) GROUP BY 1), t AS (SELECT coalesce(root, rule) AS root, f.* FROM f LEFT JOIN ({_CHAIN}) r ON r.symptom = f.rule) SELECT root, rule, min(severity) OVER w AS block_severity, (sum(n) OVER w)::BIGINT AS block_n FROM t WINDOW w AS (PARTITION BY root)")
def _(s, d):
    found = diagnose.findings(log_events(s, d), RULES)
    return diagnose.blocks(found, diagnose.final_roots(diagnose.causes(found, RULES))).select("root", "rule", "block_severity", "block_n")


@R.query("str_timeline", f"WITH m AS (SELECT floor(epoch(ts) / 60)::BIGINT AS m FROM ({_EV})), w AS (SELECT min(width) AS w FROM (VALUES (1), (5), (15), (60), (360), (1440)) v(width), (SELECT max(m) - min(m) + 1 AS need FROM m) WHERE ceil(need / width::DOUBLE) <= 60), w2 AS (SELECT coalesce(w, 1440) AS w FROM w), c AS (SELECT (m // w) * w * 60 AS start, count(*) AS n FROM m, w2 GROUP BY 1) SELECT g.start, coalesce(c.n, 0) AS n FROM (SELECT unnest(range((SELECT min(m) // (SELECT w FROM w2) FROM m), (SELECT max(m) // (SELECT w FROM w2) FROM m) + 1)) * (SELECT w FROM w2) * 60 AS start) g LEFT JOIN c ON c.start = g.start")
def _(s, d):
    return diagnose.timeline(log_events(s, d))


@R.query("win_gap", "WITH m AS (SELECT DISTINCT user_id, floor(epoch(ts) / 60)::BIGINT AS m FROM events), l AS (SELECT *, lead(m) OVER (PARTITION BY user_id ORDER BY m) AS nx FROM m) SELECT user_id, m + 1 AS gap_start, nx AS gap_end FROM l WHERE nx - m > 600")
def _(s, d):
    t = read(s, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("timestamp"))
    return diagnose.gaps(t, ["user_id"], least_run=1, least_gap=600)


@R.query("jn_gap_restart", "WITH m AS (SELECT DISTINCT user_id, floor(epoch(ts) / 60)::BIGINT AS m FROM events), l AS (SELECT *, lead(m) OVER (PARTITION BY user_id ORDER BY m) AS nx FROM m), g AS (SELECT user_id, m + 1 AS gap_start, nx AS gap_end FROM l WHERE nx - m > 600) SELECT * FROM g WHERE EXISTS (SELECT 1 FROM (SELECT floor(epoch(ts) / 60)::BIGINT AS t0 FROM events WHERE event_type = 'signup') u WHERE t0 >= gap_end AND t0 <= gap_end + 5)")
def _(s, d):
    t = read(s, d, "events")
    ups = t.where("event_type = 'signup'").select(F.col("ts").cast("timestamp").alias("first_seen"))
    return diagnose.restarts(diagnose.gaps(t.select("user_id", F.col("ts").cast("timestamp").alias("timestamp")), ["user_id"], 1, 600), ups)


@R.query("jn_node_disjoint", "WITH t AS (SELECT 'w' || (epoch(ts)::BIGINT // 604800) AS node, min(ts) AS lo, max(ts) AS hi, count(*) AS n FROM events GROUP BY 1 HAVING count(*) > 100) SELECT a.node AS a, b.node AS b FROM t a JOIN t b ON a.node < b.node AND (a.hi < b.lo OR b.hi < a.lo)")
def _(s, d):
    ts = F.col("ts").cast("timestamp")
    return diagnose.disjoint_nodes(read(s, d, "events").select(ts.alias("timestamp"), F.concat(F.lit("w"), F.floor(F.unix_seconds(ts) / 604800)).alias("node")))


@R.query("str_offsets", "SELECT list_sort(list(DISTINCT o)) AS offsets, count(DISTINCT o) > 1 AS mixed FROM (SELECT CASE WHEN event_type = 'view' THEN NULL WHEN user_id % 2 = 0 THEN 'Z' ELSE '+08:00' END AS o FROM events) WHERE o IS NOT NULL")
def _(s, d):
    return diagnose.offsets(log_events(s, d).withColumn("offset", F.when(F.col("node").isin("n0", "n2"), "Z").otherwise("+08:00")).withColumn("offset", F.when(~F.col("message").startswith("view"), F.col("offset"))))


@R.query("fn_filter_time", f"SELECT event_id FROM ({_EV}) WHERE ts >= (SELECT min(ts) + INTERVAL 1 DAY FROM events) AND ts <= (SELECT min(ts) + INTERVAL 3 DAY FROM events) AND (level IS NULL OR level >= 3)")
def _(s, d):
    import datetime

    t = log_events(s, d)
    lo = t.agg(F.min("timestamp")).first()[0]
    return parse.filter_events(t, lo + datetime.timedelta(days=1), lo + datetime.timedelta(days=3), 3).select("event_id")


@R.query("fn_level", "SELECT event_id, CASE upper(event_type) WHEN 'ERROR' THEN 4 END AS rank FROM events")
def _(s, d):
    return read(s, d, "events").select("event_id", parse.level_rank(F.col("event_type")).alias("rank"))


@R.query("fn_json_log", "SELECT event_id, json_extract_string(props, '$.k') AS k, 'json' AS kind, CASE event_type WHEN 'error' THEN 4 END AS level, event_type AS message FROM events")
def _(s, d):
    t = read(s, d, "events")
    line = F.to_json(F.struct(F.col("event_type").alias("message"), F.col("event_type").alias("level"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), F.get_json_object("props", "$.k").alias("k")))
    got = parse.parse_lines(t.select(F.lit("n").alias("node"), F.lit("f").alias("file"), F.col("event_id").alias("line"), F.concat(F.lit("svc | "), line).alias("text")))
    return got.select(F.col("line").alias("event_id"), F.element_at("fields", "k").alias("k"), "kind", "level", "message")


_PANIC_LINES = """SELECT 'f' || (event_id // 10) AS file, event_id AS line, CASE
WHEN event_id % 10 = 1 THEN 'thread ''t' || (user_id % 8) || ''' panicked at src/' || event_type || '.rs:' || (user_id % 90) || ':5:'
WHEN event_id % 10 = 2 AND user_id % 5 = 0 THEN '{"level":"ERROR"}' WHEN event_id % 10 = 2 THEN ' payload ' || user_id
WHEN event_id % 10 = 3 AND user_id % 7 = 0 THEN 'frame not indented' WHEN event_id % 10 = 3 THEN 'stack backtrace:'
WHEN event_id % 10 = 4 THEN '   0: ' || event_type WHEN event_id % 10 = 5 THEN 'note: run again'
WHEN event_id % 10 = 7 THEN 'thread ''main'' panicked at ''' || event_type || ''', src/m.rs:3' WHEN event_id % 10 = 8 AND user_id % 2 = 0 THEN '  at src/m.rs' ELSE 'line ' || event_id END AS text FROM events"""


@R.query("fn_panic", f"""WITH RECURSIVE l AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY line) AS rn FROM ({_PANIC_LINES})),
h AS (SELECT *, regexp_matches(text, '^thread ''[^'']*'' panicked at .+:[0-9]+(:[0-9]+)?:$') AS fresh, regexp_matches(text, '^thread ''[^'']*'' panicked at ''.*'', .+:[0-9]+(:[0-9]+)?$') AS old FROM l),
s AS (SELECT file, rn, line, text, CASE WHEN fresh THEN 2 WHEN old THEN 1 ELSE 0 END AS state, CASE WHEN fresh OR old THEN line END AS head FROM h WHERE rn = 1
UNION ALL SELECT h.file, h.rn, h.line, h.text, CASE WHEN fresh THEN 2 WHEN old THEN 1 WHEN s.state = 2 AND NOT ltrim(h.text) LIKE '{{%' THEN 1 WHEN s.state = 1 AND (h.text LIKE ' %' OR h.text = 'stack backtrace:' OR h.text LIKE 'note: %') THEN 1 ELSE 0 END AS st,
CASE WHEN fresh OR old THEN h.line WHEN (s.state = 2 AND NOT ltrim(h.text) LIKE '{{%') OR (s.state = 1 AND (h.text LIKE ' %' OR h.text = 'stack backtrace:' OR h.text LIKE 'note: %')) THEN s.head END FROM s JOIN h ON h.file = s.file AND h.rn = s.rn + 1)
SELECT file, line, 'line' AS kind, text AS message, NULL AS "full" FROM s WHERE head IS NULL UNION ALL
SELECT file, head, 'panic', 'thread ''' || regexp_extract(min(text ORDER BY line) FILTER (line = head), '^thread ''([^'']*)''', 1) || ''' panicked at ' || coalesce(nullif(regexp_extract(max(text) FILTER (line = head), 'panicked at ([^'']+):$', 1), ''), regexp_extract(max(text) FILTER (line = head), ''', ([^'']+)$', 1)) || ': ' || coalesce(nullif(regexp_extract(max(text) FILTER (line = head), 'panicked at ''(.*)'', ', 1), ''), trim(coalesce(max(text) FILTER (line = head + 1 AND text LIKE ' payload%'), ''))), string_agg(text, chr(10) ORDER BY line) FROM s WHERE head IS NOT NULL GROUP BY file, head""")
def _(s, d):
    k, u, kind = F.col("event_id") % 10, F.col("user_id"), F.col("event_type")
    text = (
        F.when(k == 1, F.concat(F.lit("thread 't"), u % 8, F.lit("' panicked at src/"), kind, F.lit(".rs:"), u % 90, F.lit(":5:")))
        .when((k == 2) & (u % 5 == 0), '{"level":"ERROR"}').when(k == 2, F.concat(F.lit(" payload "), u))
        .when((k == 3) & (u % 7 == 0), "frame not indented").when(k == 3, "stack backtrace:")
        .when(k == 4, F.concat(F.lit("   0: "), kind)).when(k == 5, "note: run again")
        .when(k == 7, F.concat(F.lit("thread 'main' panicked at '"), kind, F.lit("', src/m.rs:3")))
        .when((k == 8) & (u % 2 == 0), "  at src/m.rs").otherwise(F.concat(F.lit("line "), "event_id"))
    )
    lines = read(s, d, "events").select(F.lit("n").alias("node"), F.concat(F.lit("f"), F.floor(F.col("event_id") / 10)).alias("file"), F.col("event_id").alias("line"), text.alias("text"))
    return parse.fold_panics(lines).select("file", "line", "kind", F.col("text").alias("message"), F.element_at("fields", "panic_full").alias("full"))


@R.query("fn_redact_hash", "SELECT c_custkey, 'h:' || substr(sha256(c_name), 1, 16) AS h FROM customer")
def _(s, d):
    return read(s, d, "customer").select("c_custkey", redact.hashed(F.col("c_name")).alias("h"))


@R.query("fn_redact_text", "SELECT c_custkey, 'user: h:' || substr(sha256(c_name), 1, 16) || ', accessKey=h:' || substr(sha256('AK' || c_custkey), 1, 16) || ' from h:' || substr(sha256('10.0.0.' || (c_custkey % 200) || ':9000'), 1, 16) || ' by h:' || substr(sha256('2001:db8::' || (c_custkey % 10)), 1, 16) || ' at 10:11:12 secret=kept' AS t FROM customer")
def _(s, d):
    k = F.col("c_custkey")
    text = F.concat(F.lit("user: "), "c_name", F.lit(", accessKey='AK"), k, F.lit("' from 10.0.0."), k % 200, F.lit(":9000 by 2001:db8::"), k % 10, F.lit(" at 10:11:12 secret=kept"))
    return read(s, d, "customer").select("c_custkey", redact.redact_text()(text).alias("t"))


@R.query("fn_redact_field", "SELECT c_custkey, 'h:' || substr(sha256(c_name), 1, 16) AS hidden, c_mktsegment AS plain FROM customer")
def _(s, d):
    return read(s, d, "customer").select("c_custkey", redact.redact_field(F.lit("accesskey"), F.col("c_name")).alias("hidden"), redact.redact_field(F.lit("token"), F.col("c_mktsegment")).alias("plain"))


@R.query("fn_redact_prov", "SELECT page_id, CASE WHEN contains(url, '/') OR contains(url, '!') THEN 'h:' || substr(sha256(regexp_extract(url, '^(.*)[/!][^/!]*$', 1)), 1, 16) || regexp_extract(url, '([/!][^/!]*)$', 1) ELSE url END AS p FROM pages")
def _(s, d):
    return read(s, d, "pages").select("page_id", redact.redact_provenance(F.col("url")).alias("p"))
