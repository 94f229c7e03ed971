"""One query for each family of built-in functions, with DuckDB's equivalent."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lakeloom.functions import extra
from lakeloom.plans.build import Registry, read

R = Registry()


@R.query("fn_agg_basic", "SELECT l_shipdate < TIMESTAMP '1995-01-01' AS early, count(*) AS n, sum(l_linenumber)::BIGINT AS s, round(avg(l_tax), 8) AS a, min(l_tax) AS lo, max(l_tax) AS hi FROM lineitem GROUP BY 1")
def _(s, d):
    t = read(s, d, "lineitem").withColumn("early", F.col("l_shipdate") < F.lit("1995-01-01").cast("timestamp_ntz"))
    return t.groupBy("early").agg(F.count("*").alias("n"), F.sum("l_linenumber").alias("s"), F.round(F.avg("l_tax"), 8).alias("a"), F.min("l_tax").alias("lo"), F.max("l_tax").alias("hi"))


@R.query("fn_agg_stat", "SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS sd, round(stddev_pop(l_quantity), 6) AS sdp, round(var_samp(l_quantity), 5) AS v, round(covar_pop(l_quantity, l_extendedprice), 2) AS cp, round(corr(l_quantity, l_extendedprice), 8) AS c, round(regr_slope(l_extendedprice, l_quantity), 4) AS rs, round(regr_intercept(l_extendedprice, l_quantity), 3) AS ri, round(regr_r2(l_extendedprice, l_quantity), 8) AS r2 FROM lineitem GROUP BY 1")
def _(s, d):
    q, p = "l_quantity", "l_extendedprice"
    r = lambda c, n, a: F.round(c, n).alias(a)
    return read(s, d, "lineitem").groupBy("l_returnflag").agg(r(F.stddev_samp(q), 6, "sd"), r(F.stddev_pop(q), 6, "sdp"), r(F.var_samp(q), 5, "v"), r(F.covar_pop(q, p), 2, "cp"), r(F.corr(q, p), 8, "c"), r(F.regr_slope(p, q), 4, "rs"), r(F.regr_intercept(p, q), 3, "ri"), r(F.regr_r2(p, q), 8, "r2"))


@R.query("fn_agg_bit", "SELECT l_returnflag, bit_and(l_partkey) AS ba, bit_or(l_partkey) AS bo, bit_xor(l_partkey) AS bx, bool_and(l_quantity > 0) AS every_one, bool_or(l_quantity > 49) AS any_one FROM lineitem GROUP BY 1")
def _(s, d):
    return read(s, d, "lineitem").groupBy("l_returnflag").agg(F.bit_and("l_partkey").alias("ba"), F.bit_or("l_partkey").alias("bo"), F.bit_xor("l_partkey").alias("bx"), F.bool_and(F.col("l_quantity") > 0).alias("every_one"), F.bool_or(F.col("l_quantity") > 49).alias("any_one"))


@R.query("fn_agg_ord", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names, list(n_nationkey ORDER BY n_nationkey DESC) AS keys, arg_min(n_name, n_nationkey) AS first_name, arg_max(n_name, n_nationkey) AS last_name FROM nation GROUP BY 1")
def _(s, d):
    return read(s, d, "nation").groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list("n_name")), ",").alias("names"), F.sort_array(F.collect_list("n_nationkey"), asc=False).alias("keys"), F.min_by("n_name", "n_nationkey").alias("first_name"), F.max_by("n_name", "n_nationkey").alias("last_name"))


@R.query("fn_agg_pct", "SELECT event_type, round(median(value), 8) AS med, round(quantile_cont(value, 0.9), 8) AS p90 FROM events GROUP BY 1")
def _(s, d):
    return read(s, d, "events").groupBy("event_type").agg(F.round(F.median("value"), 8).alias("med"), F.round(F.percentile("value", 0.9), 8).alias("p90"))


@R.query("fn_agg_approx")
def _(s, d):
    return read(s, d, "lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey").alias("parts"), F.percentile_approx("l_quantity", [0.5, 0.95]).alias("quantiles"))


@R.query("fn_str", "SELECT c_custkey, lower(c_name) AS lo, upper(c_name) AS up, length(c_name) AS n, concat(c_name, '-', c_mktsegment) AS cc, concat_ws('/', c_name, c_mktsegment) AS cw, split_part(c_name, '#', 2) AS sp, starts_with(c_name, 'Cust') AS st, ends_with(c_name, '7') AS en, contains(c_name, '00') AS co, repeat('ab', 2) AS rp, replace(c_name, '0', 'o') AS re, ltrim('  x ') AS lt, rtrim(' x  ') AS rt, trim('  x ') AS tr, ascii(c_name) AS ac, chr(65) AS ch, levenshtein(c_name, c_mktsegment) AS lv, lower(to_hex(c_custkey)) AS hx, octet_length(encode(c_name)) AS ol FROM customer")
def _(s, d):
    n, m, big = F.col("c_name"), F.col("c_mktsegment"), "bigint"
    return read(s, d, "customer").select(
        "c_custkey", F.lower(n).alias("lo"), F.upper(n).alias("up"), F.length(n).cast(big).alias("n"), extra.concat_skip_nulls(n, F.lit("-"), m).alias("cc"), F.concat_ws("/", n, m).alias("cw"), F.split_part(n, F.lit("#"), F.lit(2)).alias("sp"),
        n.startswith("Cust").alias("st"), n.endswith("7").alias("en"), n.contains("00").alias("co"), F.repeat(F.lit("ab"), 2).alias("rp"), F.replace(n, F.lit("0"), F.lit("o")).alias("re"), F.ltrim(F.lit("  x ")).alias("lt"), F.rtrim(F.lit(" x  ")).alias("rt"), F.trim(F.lit("  x ")).alias("tr"),
        F.ascii(n).cast(big).alias("ac"), F.char(F.lit(65)).alias("ch"), F.levenshtein(n, m).cast(big).alias("lv"), F.lower(F.hex("c_custkey")).alias("hx"), F.octet_length(n).cast(big).alias("ol"),
    )


@R.query("fn_uni", "SELECT doc_id, left(text, 5) AS l, right(text, 5) AS r, lpad(lang, 5, '*') AS lp, rpad(lang, 5, '*') AS rp, reverse(substr(text, 1, 9)) AS rv, strpos(text, 'e') AS sp, substr(text, 3, 7) AS ss, translate(substr(text, 1, 20), 'aeiou', 'AEIOU') AS tl FROM documents")
def _(s, d):
    t = F.col("text")
    return read(s, d, "documents").select("doc_id", F.left(t, F.lit(5)).alias("l"), F.right(t, F.lit(5)).alias("r"), F.lpad("lang", 5, "*").alias("lp"), F.rpad("lang", 5, "*").alias("rp"), F.reverse(F.substring(t, 1, 9)).alias("rv"), F.instr(t, "e").cast("bigint").alias("sp"), F.substring(t, 3, 7).alias("ss"), F.translate(F.substring(t, 1, 20), "aeiou", "AEIOU").alias("tl"))


@R.query("fn_re", "SELECT doc_id, regexp_matches(text, '[0-9]{4}') AS m, regexp_replace(substr(text, 1, 60), '[aeiou]+', '_', 'g') AS rr, len(regexp_extract_all(text, '[A-Z]')) AS n, regexp_extract(text, '([a-z]+)\\.', 1) AS first_end FROM documents")
def _(s, d):
    return read(s, d, "documents").select("doc_id", F.rlike("text", F.lit("[0-9]{4}")).alias("m"), F.regexp_replace(F.substring("text", 1, 60), "[aeiou]+", "_").alias("rr"), F.regexp_count("text", F.lit("[A-Z]")).cast("bigint").alias("n"), F.regexp_extract("text", r"([a-z]+)\.", 1).alias("first_end"))


@R.query("fn_date", "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS dd, quarter(o_orderdate) AS q, dayofyear(o_orderdate) AS doy, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS mon, strftime(o_orderdate, '%d.%m.%Y') AS tc, epoch(o_orderdate)::BIGINT AS ux, date_diff('day', DATE '1992-01-01', o_orderdate::DATE) AS days, strftime(time_bucket(INTERVAL 7 DAY, o_orderdate, TIMESTAMP '1970-01-01'), '%Y-%m-%d') AS bin, strftime(make_date(year(o_orderdate), 1, 1), '%Y-%m-%d') AS md FROM orders")
def _(s, d):
    o, big = F.col("o_orderdate"), "bigint"
    return read(s, d, "orders").select(
        "o_orderkey", F.year(o).cast(big).alias("y"), F.month(o).cast(big).alias("m"), F.day(o).cast(big).alias("dd"), F.quarter(o).cast(big).alias("q"), F.dayofyear(o).cast(big).alias("doy"), F.date_format(F.date_trunc("month", o), "yyyy-MM-dd").alias("mon"), F.date_format(o, "dd.MM.yyyy").alias("tc"),
        extra.epoch_seconds(o).alias("ux"), F.date_diff(o.cast("date"), F.lit("1992-01-01").cast("date")).cast(big).alias("days"), F.date_format(extra.date_bin(o, 7 * 86400), "yyyy-MM-dd").alias("bin"), F.date_format(F.make_date(F.year(o), F.lit(1), F.lit(1)), "yyyy-MM-dd").alias("md"),
    )


@R.query("fn_math", "SELECT l_orderkey, l_linenumber, abs(l_discount - 0.05) AS ab, ceil(l_tax * 100) AS ce, floor(l_tax * 100) AS fl, round(sqrt(l_quantity), 9) AS sq, round(cbrt(l_quantity), 9) AS cb, round(ln(l_quantity), 9) AS l, round(log10(l_quantity), 9) AS l10, round(exp(l_tax), 9) AS ex, round(power(l_quantity, 1.5), 5) AS pw, sign(l_discount - 0.05) AS sg, round(sin(l_quantity), 9) AS si, round(atan2(l_quantity, 3), 9) AS at, round(degrees(l_tax), 9) AS de, round(radians(l_quantity), 9) AS ra, gcd(l_orderkey, l_partkey) AS g, lcm(l_linenumber, 12) AS lc, trunc(l_extendedprice) AS tr, l_discount = 0 AS iz FROM lineitem")
def _(s, d):
    q, t, r9 = F.col("l_quantity"), F.col("l_tax"), lambda c: F.round(c, 9)
    return read(s, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.abs(F.col("l_discount") - 0.05).alias("ab"), F.ceil(t * 100).cast("double").alias("ce"), F.floor(t * 100).cast("double").alias("fl"), r9(F.sqrt(q)).alias("sq"), r9(F.cbrt(q)).alias("cb"), r9(F.ln(q)).alias("l"), r9(F.log10(q)).alias("l10"), r9(F.exp(t)).alias("ex"),
        F.round(F.pow(q, F.lit(1.5)), 5).alias("pw"), F.signum(F.col("l_discount") - 0.05).cast("int").alias("sg"), r9(F.sin(q)).alias("si"), r9(F.atan2(q, F.lit(3.0))).alias("at"), r9(F.degrees(t)).alias("de"), r9(F.radians(q)).alias("ra"),
        extra.gcd(F.col("l_orderkey"), F.col("l_partkey")).alias("g"), extra.lcm(F.col("l_linenumber").cast("bigint"), F.lit(12).cast("bigint")).alias("lc"), extra.trunc_number(F.col("l_extendedprice")).alias("tr"), (F.col("l_discount") == 0).alias("iz"),
    )


@R.query("fn_cond", "SELECT s_suppkey, coalesce(nullif(s_nationkey, 3), -1) AS c, greatest(s_acctbal, 0) AS g, least(s_acctbal, 0) AS l, CASE WHEN s_acctbal < 0 THEN 'debt' WHEN s_acctbal < 1000 THEN 'low' ELSE 'ok' END AS k, ifnull(nullif(s_name, 'x'), 'y') AS i FROM supplier")
def _(s, d):
    a = F.col("s_acctbal")
    return read(s, d, "supplier").select("s_suppkey", F.coalesce(F.nullif("s_nationkey", F.lit(3)), F.lit(-1)).alias("c"), F.greatest(a, F.lit(0.0)).alias("g"), F.least(a, F.lit(0.0)).alias("l"), F.when(a < 0, "debt").when(a < 1000, "low").otherwise("ok").alias("k"), F.ifnull(F.nullif("s_name", F.lit("x")), F.lit("y")).alias("i"))


@R.query("fn_crypto", "SELECT doc_id, md5(text) AS m, sha256(text) AS s2 FROM documents")
def _(s, d):
    return read(s, d, "documents").select("doc_id", F.md5("text").alias("m"), F.sha2("text", 256).alias("s2"))


@R.query("fn_enc", "SELECT p_partkey, to_base64(encode(p_name)) AS b, lower(hex(encode(p_brand))) AS h, decode(from_base64(to_base64(encode(p_name)))) AS back FROM part")
def _(s, d):
    return read(s, d, "part").select("p_partkey", F.base64(F.encode("p_name", "UTF-8")).alias("b"), F.lower(F.hex(F.encode("p_brand", "UTF-8"))).alias("h"), F.decode(F.unbase64(F.base64(F.encode("p_name", "UTF-8"))), "UTF-8").alias("back"))


@R.query("fn_arr", "WITH a AS (SELECT o_custkey, list_sort(list(o_orderkey)) AS k FROM orders GROUP BY 1) SELECT o_custkey, len(k) AS n, k[1] AS first, list_contains(k, o_custkey) AS has, list_slice(k, 2, 3) AS part, array_to_string(list_slice(k, 1, 3), ',') AS joined, list_distinct(list_transform(k, lambda x: x % 2)) IS NOT NULL AS some, list_reverse(k)[1] AS last, list_position(k, k[2]) AS pos, len(list_concat(k, [1, 2])) AS more FROM a WHERE len(k) > 1")
def _(s, d):
    a = read(s, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("k")).where(F.size("k") > 1)
    big = "bigint"
    return a.select("o_custkey", F.size("k").cast(big).alias("n"), F.col("k")[0].alias("first"), F.array_contains("k", F.col("o_custkey")).alias("has"), F.slice("k", 2, 2).alias("part"), F.array_join(F.slice("k", 1, 3).cast("array<string>"), ",").alias("joined"), F.array_distinct(F.transform("k", lambda x: x % 2)).isNotNull().alias("some"), F.reverse("k")[0].alias("last"), F.array_position("k", F.col("k")[1]).alias("pos"), F.size(F.concat("k", F.array(F.lit(1).cast(big), F.lit(2).cast(big)))).cast(big).alias("more"))


@R.query("fn_map", "SELECT n_nationkey, n_name AS v, 2 AS n, n_regionkey AS f FROM nation")
def _(s, d):
    m = F.create_map(F.lit("name"), F.col("n_name"), F.lit("other"), F.lit("x"))
    return read(s, d, "nation").select("n_nationkey", F.element_at(m, "name").alias("v"), F.size(F.map_keys(m)).alias("n"), F.struct(F.col("n_regionkey").alias("key"))["key"].alias("f"))


@R.query("fn_json", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def _(s, d):
    return read(s, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@R.query("fn_cast", "SELECT doc_id, try_cast(substr(source, 4) AS INTEGER) AS n, try_cast(lang AS INTEGER) AS none, CAST(n_chars AS VARCHAR) AS s, CAST(n_chars AS DOUBLE) / 2 AS h FROM documents")
def _(s, d):
    return read(s, d, "documents").select("doc_id", F.substring("source", 4, 10).try_cast("int").alias("n"), F.col("lang").try_cast("int").alias("none"), F.col("n_chars").cast("string").alias("s"), (F.col("n_chars").cast("double") / 2).alias("h"))


@R.query("fn_pred", "SELECT p_partkey FROM part WHERE (p_brand LIKE '%3' OR p_type ILIKE 'p%') AND p_size NOT IN (1, 2, 3) AND p_retailprice IS NOT NULL AND p_size IS DISTINCT FROM 10 AND NOT p_name LIKE 'x%'")
def _(s, d):
    return read(s, d, "part").where((F.col("p_brand").like("%3") | F.col("p_type").ilike("p%")) & ~F.col("p_size").isin(1, 2, 3) & F.col("p_retailprice").isNotNull() & ~F.col("p_size").eqNullSafe(10) & ~F.col("p_name").like("x%")).select("p_partkey")


@R.query("fn_hashes", "SELECT r_name, md5(r_name) AS m, sha256(r_name) AS s FROM region")
def _(s, d):
    return read(s, d, "region").select("r_name", F.md5("r_name").alias("m"), F.sha2("r_name", 256).alias("s"))


@R.query("fn_path", "SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, regexp_replace(url, '/[^/]*$', '') AS parent, regexp_extract(url, '([^/]*)$', 1) AS leaf FROM pages")
def _(s, d):
    return read(s, d, "pages").select("page_id", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), extra.parent_path(F.col("url")).alias("parent"), F.regexp_extract("url", "([^/]*)$", 1).alias("leaf"))


@R.query("fn_string_ellipsis", "SELECT r_regionkey, 'disk' || i AS name FROM region, range(1, 5) t(i)")
def _(s, d):
    return read(s, d, "region").select("r_regionkey", F.explode(extra.expand_ellipsis("disk{1...4}")).alias("name"))


@R.query("fn_human", "SELECT doc_id, CASE WHEN n_chars >= 1048576 THEN printf('%.1f MiB', round(n_chars / 1048576.0, 1)) WHEN n_chars >= 1024 THEN printf('%.1f KiB', round(n_chars / 1024.0, 1)) ELSE n_chars || ' B' END AS size FROM documents")
def _(s, d):
    return read(s, d, "documents").select("doc_id", extra.human_bytes(F.col("n_chars")).alias("size"))


@R.query("udf_scalar", "SELECT r_name, length(r_name) * 2 AS n FROM region")
def _(s, d):
    extra.register(s)
    return read(s, d, "region").selectExpr("r_name", "twice(length(r_name)) AS n")


@R.query("udf_agg", "SELECT n_regionkey, max(n_nationkey) - min(n_nationkey) AS spread FROM nation GROUP BY 1")
def _(s, d):
    return read(s, d, "nation").groupBy("n_regionkey").agg(extra.spread_udaf()("n_nationkey").alias("spread"))


@R.query("udf_window", "SELECT n_nationkey, max(n_nationkey) OVER w - min(n_nationkey) OVER w AS spread FROM nation WINDOW w AS (PARTITION BY n_regionkey)")
def _(s, d):
    return read(s, d, "nation").select("n_nationkey", extra.spread_udaf()("n_nationkey").over(W.partitionBy("n_regionkey")).alias("spread"))


@R.query("udtf_words", "SELECT r_regionkey, unnest(string_split(r_name, ' ')) AS word FROM region")
def _(s, d):
    extra.register(s)
    read(s, d, "region").createOrReplaceTempView("lakeloom_region")
    return s.sql("SELECT r_regionkey, word FROM lakeloom_region, LATERAL words_of(r_name)")
