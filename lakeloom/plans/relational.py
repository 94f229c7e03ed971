"""Projection, filter, aggregation, joins, set operations, windows and pagination over the star schema.

What a strict single-table SELECT allows comes first (sel_*, agg_*), then what only the extended mode has (joins, set
operations, grouping sets, windows). Sort orders spell out where nulls go.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lakeloom.operators import asof, pagination, select
from lakeloom.plans.build import Registry, read, spread

R = Registry()


@R.query("sel_flagship", "SELECT l_returnflag, count(*) AS n, sum(l_quantity) AS q FROM lineitem WHERE l_quantity > 25 GROUP BY l_returnflag ORDER BY l_returnflag LIMIT 10")
def _(s, d):
    return select.run(read(s, d, "lineitem"), "SELECT l_returnflag, COUNT(*) AS n, SUM(l_quantity) AS q FROM S3Object WHERE l_quantity > 25 GROUP BY l_returnflag ORDER BY l_returnflag LIMIT 10")


@R.query("sel_proj", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem")
def _(s, d):
    return select.run(read(s, d, "lineitem"), "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net FROM S3Object")


@R.query("sel_where", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24 AND l_returnflag IN ('A', 'R')")
def _(s, d):
    return select.run(read(s, d, "lineitem"), "SELECT l_orderkey, l_linenumber FROM S3Object WHERE l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24 AND l_returnflag IN ('A', 'R')")


@R.query("sel_alias", "SELECT s.c_name AS name, s.c_acctbal AS balance FROM customer AS s WHERE s.c_acctbal < 0")
def _(s, d):
    return select.run(read(s, d, "customer"), "SELECT s.c_name AS name, s.c_acctbal AS balance FROM S3Object AS s WHERE s.c_acctbal < 0")


@R.query("sel_order_topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 25")
def _(s, d):
    return select.run(read(s, d, "orders"), "SELECT o_orderkey, o_totalprice FROM S3Object ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 25")


@R.query("sel_distinct", "SELECT DISTINCT c_mktsegment, c_nationkey FROM customer")
def _(s, d):
    return read(s, d, "customer").select("c_mktsegment", "c_nationkey").distinct()


@R.query("sel_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 15")
def _(s, d):
    return read(s, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).where("n > 15")


@R.query("sel_cte", "WITH big AS (SELECT o_custkey, sum(o_totalprice) AS spent FROM orders GROUP BY o_custkey) SELECT c_name, round(spent, 2) AS spent FROM big JOIN customer ON c_custkey = o_custkey WHERE spent > 2000000")
def _(s, d):
    big = read(s, d, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("spent")).where("spent > 2000000")
    return big.join(read(s, d, "customer"), F.col("c_custkey") == F.col("o_custkey")).select("c_name", F.round("spent", 2).alias("spent"))


@R.query("sel_subquery", "SELECT p_partkey FROM part WHERE p_retailprice > (SELECT avg(p_retailprice) * 1.01 FROM part)")
def _(s, d):
    part = read(s, d, "part")
    limit = part.agg((F.avg("p_retailprice") * 1.01).alias("least"))
    return part.join(F.broadcast(limit), F.col("p_retailprice") > F.col("least")).select("p_partkey")  # one row


@R.query("sel_coerce", "SELECT doc_id, source FROM documents WHERE try_cast(substr(source, 4) AS BIGINT) > 9")
def _(s, d):
    t = read(s, d, "documents").withColumn("number", F.expr("substr(source, 4)"))
    return select.run(t, "SELECT doc_id, source FROM S3Object WHERE number > 9")


@R.query("sel_intdiv", "SELECT o_orderkey, o_orderkey // 7 AS q, o_orderkey % 7 AS r FROM orders")
def _(s, d):
    return select.run(read(s, d, "orders"), "SELECT o_orderkey, o_orderkey / 7 AS q, o_orderkey % 7 AS r FROM S3Object")


@R.query("agg_group", "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus")
def _(s, d):
    t = read(s, d, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return t.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


@R.query("agg_global", "SELECT count(*) AS n, min(o_totalprice) AS lo, max(o_totalprice) AS hi, round(avg(o_totalprice), 4) AS mean FROM orders")
def _(s, d):
    return select.run(read(s, d, "orders"), "SELECT count(*) AS n, min(o_totalprice) AS lo, max(o_totalprice) AS hi, round(avg(o_totalprice), 4) AS mean FROM S3Object")


@R.query("agg_distinct", "SELECT l_shipdate IS NULL AS none, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY 1")
def _(s, d):
    return read(s, d, "lineitem").groupBy(F.col("l_shipdate").isNull().alias("none")).agg(F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_suppkey").alias("suppliers"))


@R.query("agg_stats", "SELECT count(*) AS n, min(l_orderkey) AS lo, max(l_orderkey) AS hi FROM lineitem")
def _(s, d):
    return read(s, d, "lineitem").agg(F.count("*").alias("n"), F.min("l_orderkey").alias("lo"), F.max("l_orderkey").alias("hi"))


_GROUPED = "SELECT l_returnflag, l_linestatus, grouping(l_returnflag) AS gf, grouping(l_linestatus) AS gs, sum(l_quantity) AS q FROM lineitem GROUP BY {}"


def _grouping(t, how):
    return getattr(t, how)("l_returnflag", "l_linestatus").agg(F.grouping("l_returnflag").cast("bigint").alias("gf"), F.grouping("l_linestatus").cast("bigint").alias("gs"), F.sum("l_quantity").alias("q"))


@R.query("agg_rollup", _GROUPED.format("ROLLUP (l_returnflag, l_linestatus)"))
def _(s, d):
    return _grouping(read(s, d, "lineitem"), "rollup")


@R.query("agg_cube", _GROUPED.format("CUBE (l_returnflag, l_linestatus)"))
def _(s, d):
    return _grouping(read(s, d, "lineitem"), "cube")


@R.query("agg_gsets", _GROUPED.format("GROUPING SETS ((l_returnflag), (l_linestatus), ())"))
def _(s, d):
    t = read(s, d, "lineitem")
    return t.groupingSets([[t.l_returnflag], [t.l_linestatus], []], "l_returnflag", "l_linestatus").agg(F.grouping("l_returnflag").cast("bigint").alias("gf"), F.grouping("l_linestatus").cast("bigint").alias("gs"), F.sum("l_quantity").alias("q"))


def _sides(s, d):
    return read(s, d, "customer").select("c_custkey", "c_nationkey"), read(s, d, "orders").where("o_totalprice > 200000").select("o_orderkey", "o_custkey")


for _how, _sql in (("inner", "JOIN"), ("left", "LEFT JOIN"), ("right", "RIGHT JOIN"), ("full", "FULL JOIN")):

    @R.query(f"jn_{_how}", f"SELECT c_custkey, o_orderkey FROM (SELECT * FROM customer WHERE c_nationkey < 12) c {_sql} (SELECT * FROM orders WHERE o_totalprice > 200000) o ON c_custkey = o_custkey")
    def _(s, d, how=_how):
        c, o = _sides(s, d)
        return c.where("c_nationkey < 12").join(o, F.col("c_custkey") == F.col("o_custkey"), how).select("c_custkey", "o_orderkey")


@R.query("jn_cross", "SELECT r_name, n_name FROM region, nation")
def _(s, d):
    return read(s, d, "region").crossJoin(F.broadcast(read(s, d, "nation"))).select("r_name", "n_name")  # a fixed table of nations


@R.query("jn_semi", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def _(s, d):
    c, o = _sides(s, d)
    return c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@R.query("jn_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def _(s, d):
    c, o = _sides(s, d)
    return c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@R.query("jn_star", "SELECT n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY n_name")
def _(s, d):
    place = read(s, d, "nation").join(read(s, d, "region").where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name")
    t = read(s, d, "orders").join(read(s, d, "customer").join(place, F.col("c_nationkey") == F.col("n_nationkey")), F.col("o_custkey") == F.col("c_custkey"))
    return t.groupBy("n_name").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@R.query("jn_self", "SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey")
def _(s, d):
    t = read(s, d, "supplier").select("s_suppkey", "s_nationkey")
    a, b = t.alias("a"), t.alias("b")
    return a.join(b, (F.col("a.s_nationkey") == F.col("b.s_nationkey")) & (F.col("a.s_suppkey") < F.col("b.s_suppkey"))).select(F.col("a.s_suppkey").alias("a"), F.col("b.s_suppkey").alias("b"))


@R.query("jn_range", "SELECT a.event_id AS a, b.event_id AS b FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'purchase' AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 2 HOUR")
def _(s, d):
    t = read(s, d, "events")
    a = t.where("event_type = 'click'").select("user_id", "ts", F.col("event_id").alias("a"))
    b = t.where("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("b"))
    return asof.interval_join(a, b, ["user_id"], "ts", 0, 7200).select("a", "b")


@R.query("jn_asof", "SELECT p.event_id, v.event_id AS seen FROM (SELECT * FROM events WHERE event_type = 'purchase') p LEFT JOIN LATERAL (SELECT event_id FROM events v WHERE v.event_type = 'view' AND v.user_id = p.user_id AND v.ts <= p.ts ORDER BY v.ts DESC, v.event_id DESC LIMIT 1) v ON true")
def _(s, d):
    t = read(s, d, "events")
    left = t.where("event_type = 'purchase'").select("user_id", "ts", "event_id")
    right = t.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("seen"))
    return asof.asof_join(left, right, ["user_id"], "ts", "seen").select("event_id", "seen")


@R.query("set_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def _(s, d):
    return read(s, d, "customer").select(F.col("c_nationkey").alias("k")).union(read(s, d, "supplier").select("s_nationkey")).distinct()


@R.query("set_union_all", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def _(s, d):
    return read(s, d, "customer").select(F.col("c_nationkey").alias("k")).union(read(s, d, "supplier").select("s_nationkey"))


@R.query("set_intersect", "SELECT c_nationkey AS k FROM customer WHERE c_acctbal < 1000 INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def _(s, d):
    return read(s, d, "customer").where("c_acctbal < 1000").select(F.col("c_nationkey").alias("k")).intersect(read(s, d, "supplier").where("s_acctbal > 5000").select("s_nationkey"))


@R.query("set_diff", "SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def _(s, d):
    return read(s, d, "customer").select(F.col("c_nationkey").alias("k")).subtract(read(s, d, "supplier").where("s_acctbal > 5000").select("s_nationkey"))


@R.query("set_diff_all", "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
def _(s, d):
    return read(s, d, "customer").select(F.col("c_nationkey").alias("k")).exceptAll(read(s, d, "supplier").select("s_nationkey"))


_W = "(PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber)"


@R.query("win_rank", f"SELECT l_orderkey, l_linenumber, row_number() OVER {_W} AS rn, rank() OVER (PARTITION BY l_suppkey ORDER BY l_quantity) AS rk, dense_rank() OVER (PARTITION BY l_suppkey ORDER BY l_quantity) AS dr, round(percent_rank() OVER (PARTITION BY l_suppkey ORDER BY l_quantity), 9) AS pr, round(cume_dist() OVER (PARTITION BY l_suppkey ORDER BY l_quantity), 9) AS cd, ntile(4) OVER {_W} AS nt FROM lineitem")
def _(s, d):
    w = W.partitionBy("l_suppkey").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber")
    q = W.partitionBy("l_suppkey").orderBy("l_quantity")
    big = lambda c: c.cast("bigint")
    t = spread(read(s, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"), "l_suppkey")
    return t.select("l_orderkey", "l_linenumber", big(F.row_number().over(w)).alias("rn"), big(F.rank().over(q)).alias("rk"), big(F.dense_rank().over(q)).alias("dr"), F.round(F.percent_rank().over(q), 9).alias("pr"), F.round(F.cume_dist().over(q), 9).alias("cd"), big(F.ntile(4).over(w)).alias("nt"))


@R.query("win_offset", "SELECT event_id, lag(event_id) OVER w AS before, lead(event_id, 2) OVER w AS after2, first_value(event_id) OVER w AS first, last_value(event_id) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last, nth_value(event_id, 2) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def _(s, d):
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return read(s, d, "events").select("event_id", F.lag("event_id").over(w).alias("before"), F.lead("event_id", 2).over(w).alias("after2"), F.first("event_id").over(w).alias("first"), F.last("event_id").over(whole).alias("last"), F.nth_value("event_id", 2).over(whole).alias("second"))


@R.query("win_frame", "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS rows3, count(*) OVER (PARTITION BY user_id ORDER BY epoch(date_trunc('second', ts)) RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS hour, count(*) OVER (PARTITION BY event_type ORDER BY floor(value) GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) AS groups2 FROM events")
def _(s, d):
    rows3 = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-2, 0)
    hour = W.partitionBy("user_id").orderBy("sec").rangeBetween(-3600, 0)
    groups2 = W.partitionBy("event_type").orderBy("peer").rangeBetween(-1, 0)  # a frame of groups, by their dense rank
    t = read(s, d, "events").withColumn("sec", F.unix_timestamp(F.col("ts").cast("timestamp")))
    t = t.withColumn("peer", F.dense_rank().over(W.partitionBy("event_type").orderBy(F.floor("value"))))
    return t.select("event_id", F.round(F.sum("value").over(rows3), 6).alias("rows3"), F.count("*").over(hour).alias("hour"), F.count("*").over(groups2).alias("groups2"))


@R.query("win_recent", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 3")
def _(s, d):
    w = W.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), "o_orderkey")
    return read(s, d, "orders").withColumn("rn", F.row_number().over(w)).where("rn <= 3").select("o_custkey", "o_orderkey")


@R.query("pag_keyset", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders WHERE (o_orderdate, o_orderkey) > (TIMESTAMP '1995-06-01', 100) ORDER BY o_orderdate, o_orderkey LIMIT 50")
def _(s, d):
    page = pagination.keyset(read(s, d, "orders"), ["o_orderdate", "o_orderkey"], [F.lit("1995-06-01").cast("timestamp_ntz"), F.lit(100)], 50)
    return page.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


@R.query("pag_list", r"WITH k AS (SELECT regexp_replace(url, '^https?://', '') AS key FROM pages), e AS (SELECT CASE WHEN strpos(key, '/') > 0 THEN substr(key, 1, strpos(key, '/')) ELSE key END AS entry, strpos(key, '/') > 0 AS is_prefix FROM k) SELECT DISTINCT entry, is_prefix FROM e ORDER BY entry LIMIT 40")
def _(s, d):
    keys = read(s, d, "pages").select(F.regexp_replace("url", "^https?://", "").alias("key"))
    return pagination.list_keys(keys, "key", prefix="", delimiter="/", most=40)


@R.query("pag_walk", "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations WHERE conv_id > 10) WHERE rn = 1 ORDER BY conv_id LIMIT 60")
def _(s, d):
    return pagination.walk(read(s, d, "conversations"), "conv_id", "turn", marker=10, latest_only=True, most=60).select("conv_id", "turn", "role")


@R.query("top_keys", "SELECT user_id, count(*) AS n FROM events GROUP BY user_id ORDER BY n DESC, user_id LIMIT 10")
def _(s, d):
    return read(s, d, "events").groupBy("user_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "user_id").limit(10)
