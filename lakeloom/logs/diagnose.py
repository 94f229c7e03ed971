"""Rules over events, findings, causes, message templates, timelines, gaps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Replacements in order, for message templates. Fixed patterns.
TEMPLATE = [
    (r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}", "<uuid>"),
    (r"\b[0-9a-fA-F]{16,}\b", "<hex>"),
    (r"\d{4}-\d{2}-\d{2}T[0-9:.]+(?:Z|[+-]\d{2}:\d{2})?", "<ts>"),
    (r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?::\d+)?\b", "<addr>"),
    (r"(^|\s)/\S+", "$1<path>"),
    (r"\d+", "<n>"),
    (r"`[^`]*`", "`<q>`"),
    (r"'[^']*'", "'<q>'"),
    (r'"[^"]*"', '"<q>"'),
]


def template(message: Column) -> Column:
    return reduce(lambda m, r: F.regexp_replace(m, r[0], r[1]), TEMPLATE, message)


def clusters(events: DataFrame, most: int = 5000) -> DataFrame:
    """Messages by template: count, highest level, a sample; templates beyond the `most` commonest are one, <overflow>."""
    t = events.groupBy(template(F.col("message")).alias("template")).agg(F.count("*").alias("n"), F.max("level").alias("level"), F.min(F.struct(F.col("message"), F.col("target"))).alias("s"))
    top = t.orderBy(F.desc("n"), "template").limit(most).select("template")
    kept = t.join(top.withColumn("kept", F.lit(True)), "template", "left").withColumn("template", F.when(F.col("kept"), F.col("template")).otherwise("<overflow>"))
    return kept.groupBy("template").agg(F.sum("n").alias("n"), F.max("level").alias("level"), F.min("s").alias("s")).select("template", "n", "level", F.col("s.message").alias("sample"), F.col("s.target").alias("target"))


# ---------------------------------------------------------------- rules


def matcher(m: dict) -> Column:
    """A matcher tree as a predicate; a null level or target never matches."""
    (kind, arg), msg = next(iter(m.items())), F.col("message")
    kinds = {
        "message_prefix": lambda: msg.startswith(arg),
        "message_contains": lambda: msg.contains(arg),
        "message_regex": lambda: F.rlike(msg, F.lit(arg)),
        "field_equals": lambda: F.element_at("fields", F.lit(arg[0])) == arg[1],
        "target_prefix": lambda: F.col("target").startswith(arg),
        "is_panic": lambda: F.col("kind") == "panic",
        "min_level": lambda: F.col("level") >= arg,
        "all": lambda: reduce(lambda a, b: a & b, map(matcher, arg)),
        "any": lambda: reduce(lambda a, b: a | b, map(matcher, arg)),
    }
    return F.coalesce(kinds[kind](), F.lit(False))


def check_rules(rules: list[dict]) -> list[str]:
    """All that is wrong with a rule set."""
    import re

    out, seen = [], set()

    def walk(m, at):
        (kind, arg), = m.items()
        if kind in ("all", "any"):
            if not arg:
                out.append(f"{at}: empty group")
            for x in arg:
                walk(x, at)
        if kind == "message_regex":
            try:
                re.compile(arg)
            except re.error as e:
                out.append(f"{at}: {e}")

    for r in rules:
        if not r["id"]:
            out.append("empty id")
        if r["id"] in seen:
            out.append(f"{r['id']}: repeated id")
        seen.add(r["id"])
        walk(r["match"], r["id"])
        out += [f"{r['id']}: anchor {a!r}" for a in r.get("anchors", []) if len(a.encode()) < 8 or "\t" in a or "\n" in a]
    return out


def override(built_in: list[dict], external: list[dict]) -> list[dict]:
    """External rules replace built-in ones of the same id."""
    return list(({r["id"]: r for r in built_in} | {r["id"]: r for r in external}).values())


def hits(events: DataFrame, rules: list[dict]) -> DataFrame:
    """One row for each event and rule that holds; rules are columns, so no join is made."""
    ids = F.filter(F.array(*[F.when(matcher(r["match"]), F.lit(r["id"])) for r in rules]), lambda x: x.isNotNull())
    return events.withColumn("rule", F.explode(ids))


def unmatched(events: DataFrame, rules: list[dict]) -> DataFrame:
    none = reduce(lambda a, b: a & b, [~matcher(r["match"]) for r in rules])
    return events.where(none & F.col("level").isin(3, 4) & (F.col("kind") != "panic"))


def findings(events: DataFrame, rules: list[dict]) -> DataFrame:
    """By rule: count, first and last seen (of equal instants the smaller and larger offset), nodes, below_min."""
    h = hits(events, rules)
    table = h.sparkSession.createDataFrame([(r["id"], r["severity"], r.get("min_count", 1)) for r in rules], "rule string, severity int, min_count int")
    at = F.when(F.col("timestamp").isNotNull(), F.struct("timestamp", "offset"))
    out = h.groupBy("rule").agg(F.count("*").alias("n"), F.min(at).alias("a"), F.max(at).alias("b"), F.array_sort(F.collect_set(F.coalesce("node", F.lit("-")))).alias("nodes"))
    out = out.join(F.broadcast(table), "rule")  # a row for each rule
    return out.select("rule", "severity", "n", F.col("a.timestamp").alias("first_seen"), F.col("b.timestamp").alias("last_seen"), "nodes", (F.col("n") < F.col("min_count")).alias("below_min"))


def samples(events: DataFrame, rules: list[dict], k: int = 3) -> DataFrame:
    w = W.partitionBy("rule").orderBy(F.col("timestamp").isNull(), "timestamp", "file", "line")
    return hits(events, rules).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k).select("rule", "rn", "timestamp", "file", "line", "message")


def evidence(events: DataFrame, rules: list[dict], keep: int = 10) -> DataFrame:
    """By rule and field: the smallest distinct values, and how many more there are."""
    wanted = events.sparkSession.createDataFrame([(r["id"], f) for r in rules for f in r.get("evidence", [])], "rule string, field string")
    t = hits(events, rules).select("rule", F.explode("fields").alias("field", "value")).join(F.broadcast(wanted), ["rule", "field"], "left_semi")
    ranked = t.distinct().withColumn("rn", F.row_number().over(W.partitionBy("rule", "field").orderBy("value")))
    return ranked.groupBy("rule", "field").agg(F.array_sort(F.collect_list(F.when(F.col("rn") <= keep, F.col("value")))).alias("values"), F.greatest(F.count("*") - keep, F.lit(0)).alias("overflow"))


def causes(found: DataFrame, rules: list[dict], lead: int = 300, lag: int = 1800) -> DataFrame:
    """Symptom to root: a finding that another implies, if the other was first by `lead` seconds and not over `lag` before.

    Findings are as many as rules. Each symptom takes its most severe, then commonest, then first-named root.
    """
    edges = found.sparkSession.createDataFrame([(s, r["id"]) for r in rules for s in r.get("implies", [])] or [("", "")], "symptom string, root string")
    a = found.select(F.col("rule").alias("root"), F.col("first_seen").alias("rf"), F.col("last_seen").alias("rl"), F.col("severity").alias("rs"), F.col("n").alias("rn"))
    b = found.select(F.col("rule").alias("symptom"), F.col("first_seen").alias("sf"))
    pairs = edges.join(a, "root").join(b, "symptom")
    near = F.coalesce((F.unix_seconds("rf") <= F.unix_seconds("sf") + lead) & (F.unix_seconds("rl") >= F.unix_seconds("sf") - lag), F.lit(True))
    best = W.partitionBy("symptom").orderBy("rs", F.desc("rn"), "root")
    return pairs.where(near).withColumn("k", F.row_number().over(best)).where("k = 1").select("symptom", "root")


def final_roots(chosen: DataFrame) -> DataFrame:
    """Each symptom with the end of its chain of roots; a cycle ends at its smallest member. Rows are as many as rules, so they are followed here."""
    up = {r["symptom"]: r["root"] for r in chosen.collect()}
    out = []
    for symptom in up:
        seen, at = [symptom], up[symptom]
        while at in up and at not in seen:
            seen.append(at)
            at = up[at]
        out.append((symptom, min(seen[seen.index(at) :]) if at in seen else at))
    return chosen.sparkSession.createDataFrame(out, "symptom string, root string")


def order_findings(found: DataFrame) -> DataFrame:
    return found.orderBy("severity", F.desc("n"), "rule")


def blocks(found: DataFrame, roots: DataFrame) -> DataFrame:
    """Findings by block (a root and its symptoms), blocks by their least severity number and total count."""
    t = found.join(roots.select(F.col("symptom").alias("rule"), "root"), "rule", "left").withColumn("root", F.coalesce("root", "rule"))
    sums = t.groupBy("root").agg(F.min("severity").alias("block_severity"), F.sum("n").alias("block_n"))
    return t.join(sums, "root").orderBy("block_severity", F.desc("block_n"), "root", (F.col("rule") != F.col("root")), "severity", F.desc("n"), "rule")


# ---------------------------------------------------------------- time

#: Bucket widths in minutes. Fixed values.
WIDTHS = (1, 5, 15, 60, 360, 1440)


def timeline(events: DataFrame, most: int = 60) -> DataFrame:
    """Counts in buckets of the least width that needs no more than `most`, with empty buckets as zeros."""
    t = events.where("timestamp is not null").select(F.floor(F.unix_seconds("timestamp") / 60).alias("m"))
    span = t.agg(F.min("m").alias("lo"), F.max("m").alias("hi")).first()
    if span["lo"] is None:
        return t.selectExpr("m * 60 AS start", "0L AS n").limit(0)
    need = span["hi"] - span["lo"] + 1
    width = next((w for w in WIDTHS if -(-need // w) <= most), WIDTHS[-1])
    counted = t.groupBy((F.floor(F.col("m") / width) * width * 60).alias("start")).agg(F.count("*").alias("n"))
    every = t.sparkSession.range(span["lo"] // width, span["hi"] // width + 1).select((F.col("id") * width * 60).alias("start"))
    return every.join(counted, "start", "left").select("start", F.coalesce("n", F.lit(0)).alias("n"))


def gaps(events: DataFrame, by: list[str], least_run: int = 3, least_gap: int = 15, width: int = 1) -> DataFrame:
    """Jumps of more than max(least_gap, 3 * width) minutes behind a run of `least_run` busy minutes."""
    m = events.where("timestamp is not null").select(*by, F.floor(F.unix_seconds("timestamp") / 60).alias("m")).distinct()
    w = W.partitionBy(*by).orderBy("m")
    m = m.withColumn("island", F.sum((F.col("m") - F.lag("m", 1, -(10**12)).over(w) > 1).cast("int")).over(w)).withColumn("next", F.lead("m").over(w))
    m = m.withColumn("run", F.count("*").over(W.partitionBy(*by, "island").orderBy("m").rowsBetween(W.unboundedPreceding, 0)))
    return m.where((F.col("run") >= least_run) & (F.col("next") - F.col("m") > max(least_gap, 3 * width))).select(*by, (F.col("m") + 1).alias("gap_start"), F.col("next").alias("gap_end"))


def restarts(gap: DataFrame, startups: DataFrame) -> DataFrame:
    """Gaps (in minutes) with a startup finding within five minutes of their end: each of the six minutes is looked up."""
    minutes = startups.select(F.floor(F.unix_seconds("first_seen") / 60).alias("at")).distinct()
    return gap.withColumn("at", F.explode(F.sequence("gap_end", F.col("gap_end") + 5))).join(minutes, "at", "left_semi").drop("at").distinct()


def disjoint_nodes(events: DataFrame, least: int = 100) -> DataFrame:
    """Pairs of nodes whose busy times don't overlap. One row a node by then."""
    t = events.where("timestamp is not null").groupBy("node").agg(F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi"), F.count("*").alias("n")).where(F.col("n") > least)
    a, b = t.alias("a"), t.alias("b")
    apart = (F.col("a.hi") < F.col("b.lo")) | (F.col("b.hi") < F.col("a.lo"))
    return a.join(b, (F.col("a.node") < F.col("b.node")) & apart).select(F.col("a.node").alias("a"), F.col("b.node").alias("b"))


def offsets(events: DataFrame) -> DataFrame:
    return events.where("offset is not null").agg(F.array_sort(F.collect_set("offset")).alias("offsets"), (F.count_distinct("offset") > 1).alias("mixed"))
