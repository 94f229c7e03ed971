"""Fixed cases: the restricted SELECT, sources, rules, logs, and that the engine stands without its optional parts."""

import collections
import datetime
import gzip
import hashlib
import io
import json
import random
import subprocess
import sys
import tarfile
import zipfile
from pathlib import Path

import pytest
import zstandard
from pyspark.sql import functions as F

from lakeloom.logs import diagnose, parse, redact, report
from lakeloom.operators import pagination, select
from lakeloom.rules import conditions as C
from lakeloom.rules import objects as O
from lakeloom.sources import readers, sinks
from lakeloom.stats import rolling
from lakeloom.streaming import streams
from lakeloom.tables import maintenance
from lakeloom.usage import rollup

PEOPLE = "id,name,age,department,salary\n1,Ann,25,HR,05000\n2,Ben,30,IT,6000\n3,Cid,35,Sales,7000\n4,Dot,9,HR,5200\n"


@pytest.fixture()
def people(spark, tmp_path):
    (tmp_path / "p.csv").write_text(PEOPLE)
    return str(tmp_path / "p.csv")


def test_csv_headers(spark, people):
    assert readers.csv(spark, people).first()["salary"] == "05000"
    assert [r["_5"] for r in readers.csv(spark, people, "IGNORE").take(2)] == ["05000", "6000"]
    assert [r["_5"] for r in readers.csv(spark, people, "NONE").take(2)] == ["salary", "05000"]


def test_select(spark, people):
    t = readers.csv(spark, people)
    rows = select.run(t, "SELECT name FROM S3Object s WHERE CAST(s.age AS INT) > 28").collect()
    assert sorted(r["name"] for r in rows) == ["Ben", "Cid"]
    got = {r["department"]: r["n"] for r in select.run(t, "SELECT department, COUNT(*) AS n FROM S3Object GROUP BY department").collect()}
    assert got == {"HR": 2, "IT": 1, "Sales": 1}
    assert select.run(t, "SELECT count(DISTINCT department) AS n FROM s3object LIMIT 5").first()["n"] == 3


@pytest.mark.parametrize(
    "sql, kind",
    [
        ("SELECT 1; SELECT 2", "MultiStatement"),
        ("", "ParseSelectFailure"),
        ("DELETE FROM S3Object", "UnsupportedSqlStructure"),
        ("SELECT DISTINCT name FROM S3Object", "UnsupportedSqlStructure"),
        ("SELECT * FROM S3Object a JOIN S3Object b ON true", "UnsupportedSqlStructure"),
        ("SELECT * FROM S3Object, S3Object", "UnsupportedSqlStructure"),
        ("SELECT * FROM S3Object WHERE age IN (SELECT 1)", "UnsupportedSqlStructure"),
        ("SELECT * FROM S3Object LIMIT x", "UnsupportedSqlStructure"),
        ("SELECT * FROM other", "DataSourcePathUnsupported"),
        ("SELECT nothing FROM S3Object", "EvaluatorBindingDoesNotExist"),
        ("SELECT nope(name) FROM S3Object", "InvalidQuery"),
        ("SELECT name FROM S3Object WHERE", "ParseSelectFailure"),
    ],
)
def test_select_errors(spark, people, sql, kind):
    t = readers.csv(spark, people)
    with pytest.raises(select.SelectError) as e:
        select.run(t, sql)
    assert e.value.kind == kind


@pytest.mark.parametrize(
    "sql",
    [
        "SELECT 1",
        "SELECT DISTINCT department, COUNT(DISTINCT name) FROM S3Object GROUP BY department",
        "SELECT department, count(*) FROM S3Object GROUP BY ROLLUP(department)",
        "SELECT department, count(*) FROM S3Object GROUP BY department WITH CUBE",
        "SELECT b FROM S3Object s(b)",
        "SELECT name FROM S3Object LIMIT 5 BY age",
        "SELECT name FROM S3Object LIMIT 1 + 1",
        "SELECT name FROM S3Object LIMIT 2, 3",
        "SELECT name FROM S3Object LIMIT 5 OFFSET 3",
        "SELECT * EXCLUDE (age) FROM S3Object",
        "SELECT TOP 5 name FROM S3Object",
        "SELECT name FROM S3Object FETCH FIRST 5 ROWS ONLY",
        "SELECT name FROM S3Object QUALIFY row_number() OVER () = 1",
        "SELECT name INTO t FROM S3Object",
        "SELECT name FROM S3Object FORMAT JSON",
        "SELECT name FROM S3Object SETTINGS x = 1",
        "SELECT name FROM S3Object SORT BY name",
        "SELECT name FROM S3Object DISTRIBUTE BY name",
        "SELECT name FROM S3Object CLUSTER BY name",
        "SELECT name FROM S3Object ORDER BY ALL",
        "SELECT name FROM S3Object GROUP BY ALL",
        "SELECT name FROM S3Object GROUP BY name HAVING count(*) > 1",
        "SELECT sum(age) OVER w FROM S3Object WINDOW w AS (ORDER BY age)",
        "SELECT name FROM S3Object TABLESAMPLE (2 ROWS)",
        "SELECT name FROM S3Object TABLESAMPLE (50 PERCENT)",
        "SELECT name FROM S3Object VERSION AS OF 1",
        "SELECT id FROM range(3)",
        "SELECT a FROM VALUES (1) t(a)",
        "SELECT name FROM S3Object LATERAL VIEW explode(array(1)) t AS c",
        "SELECT name FROM S3Object UNION SELECT name FROM S3Object",
        "SELECT name FROM S3Object |> WHERE age > 3",
        "SELECT /*+ REPARTITION(3) */ name FROM S3Object",
        "SELECT name FROM S3Object ORDER BY (SELECT 1)",
        "FROM S3Object SELECT name",
        "WITH t AS (SELECT 1) SELECT * FROM t",
    ],
)
def test_select_refuses(spark, sql):
    with pytest.raises(select.SelectError) as e:
        select.check(sql)
    assert e.value.kind == "UnsupportedSqlStructure"


@pytest.mark.parametrize("name", ["format", "top", "settings", "offset", "window", "values", "qualify", "fetch", "into"])
def test_select_takes_columns_named_like_clauses(spark, name):
    t = spark.createDataFrame([(1, "x"), (2, "y")], f"`{name}` int, b string")
    got = select.run(t, f"SELECT {name}, b FROM S3Object s WHERE s.{name} > 1 ORDER BY {name} LIMIT 3").collect()
    assert [tuple(r) for r in got] == [(2, "y")]


def test_select_sources(spark):
    for sql in ("SELECT * FROM a.b.c", "SELECT * FROM S3Object.a.b", "SELECT * FROM `s3object`", "SELECT * FROM other"):
        with pytest.raises(select.SelectError) as e:
            select.check(sql)
        assert e.value.kind == "DataSourcePathUnsupported"
    t = spark.createDataFrame([(1, "x")], "`a b` int, s string")
    assert select.run(t, 'SELECT "a b" FROM "S3Object" WHERE s = \'x\';').first()[0] == 1


def test_select_coerces_and_divides(spark):
    t = spark.createDataFrame([("9", 7, 2.0), ("10", 8, 4.0), ("abc", 9, 8.0), (None, 1, 1.0)], "s string, i int, d double")
    ids = lambda where: [r["i"] for r in select.run(t, f"SELECT i FROM S3Object o WHERE {where} ORDER BY i").collect()]
    assert ids("s > 9") == [8] and ids("9.5 < o.s") == [8] and ids("s BETWEEN 9 AND 11") == [7, 8] and ids("s IN (9, 12)") == [7]
    assert ids("s = '9'") == [7] and ids("s = 'abc' OR s = 10") == [8, 9]
    row = select.run(t, "SELECT i / 2 AS a, i / 2 / 2 AS b, d / 2 AS c, d * i / 4 AS e, i / 2.0 AS f, 'i / 2' AS g FROM S3Object WHERE i = 7").first()
    assert tuple(row)[:4] == (3, 1, 1.0, 3.5) and float(row["f"]) == 3.5 and row["g"] == "i / 2"


def test_select_names_errors_of_actions(spark, people, tmp_path):
    t = readers.csv(spark, people)
    with pytest.raises(select.SelectError) as e, select.errors():
        select.run(t, "SELECT CAST(name AS INT) FROM S3Object").collect()
    assert e.value.kind == "InvalidDataType"
    with pytest.raises(select.SelectError) as e, select.errors():
        spark.read.parquet(str(tmp_path / "none"))
    assert e.value.kind == "ObjectNotFound"
    (tmp_path / "bad.parquet").write_bytes(b"no parquet at all")
    with pytest.raises(select.SelectError) as e, select.errors():
        select.run(spark.read.schema("a int").parquet(str(tmp_path / "bad.parquet")), "SELECT a FROM S3Object").collect()
    assert e.value.kind == "ParquetParsingError"


def test_strings_hide_keywords(spark):
    select.check("SELECT name FROM S3Object WHERE name = 'a JOIN b; UNION'")


def test_parquet_row_groups(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    p = str(tmp_path / "g.parquet")
    pq.write_table(pa.table({"id": pa.array(range(5), pa.int32())}), p, row_group_size=2)
    second = pq.ParquetFile(p).metadata.row_group(1).column(0).data_page_offset
    assert readers.parquet_row_groups(spark, p, 0, 10**6).count() == 5
    assert readers.parquet_row_groups(spark, p, 0, 1).count() == 0
    assert 0 < readers.parquet_row_groups(spark, p, 0, second - 50).count() < 5


def test_archives(spark, tmp_path):
    inner = io.BytesIO()
    with tarfile.open(fileobj=inner, mode="w") as t:
        info = tarfile.TarInfo("a/x.log")
        info.size = 8
        t.addfile(info, io.BytesIO(b"one\ntwo\n"))
    (tmp_path / "n1").mkdir()
    with zipfile.ZipFile(tmp_path / "n1" / "all.zip", "w") as z:
        z.writestr("in.tar.gz", gzip.compress(inner.getvalue()))
        z.writestr("raw.bin", bytes(100))
    rows = {(r["node"], r["file"], r["line"], r["text"]) for r in readers.archives(spark, str(tmp_path)).collect()}
    assert rows == {("n1", "all.zip!in.tar.gz!a/x.log", 1, "one"), ("n1", "all.zip!in.tar.gz!a/x.log", 2, "two"), ("n1", "all.zip!raw.bin", 0, "binary")}
    assert any(r["text"] == "limit reached" for r in readers.archives(spark, str(tmp_path), most_entries=0).collect())


def test_archives_name_what_they_leave_out(spark, tmp_path):
    zstd = zstandard.ZstdCompressor()
    (tmp_path / "n1").mkdir()
    (tmp_path / "n1" / "a.zst").write_bytes(zstd.compress(b"one\n") + zstd.compress(b"two\n"))
    (tmp_path / "n1" / "b.gz").write_bytes(gzip.compress(b"x" * 50 + b"\nend\n") + gzip.compress(b"more"))
    (tmp_path / "n1" / "c.gz").write_bytes(gzip.compress(b"cut short\n" * 1000)[:40])
    rows = {(r["file"], r["line"], r["text"]) for r in readers.archives(spark, str(tmp_path), most_line=20).collect()}
    assert {r for r in rows if r[0] == "a.zst"} == {("a.zst", 1, "one"), ("a.zst", 2, "two")}
    assert {r for r in rows if r[0] == "b.gz"} == {("b.gz", 1, "x" * 20), ("b.gz", 0, "line 1 cut"), ("b.gz", 2, "end"), ("b.gz", 3, "more")}
    assert any(r[0] == "c.gz" and r[2].startswith("unreadable") for r in rows)
    (tmp_path / "n1" / "c.gz").write_bytes(b"plain\n" * 100)
    short = readers.archives(spark, str(tmp_path), most_bytes=300).where("file = 'c.gz'").orderBy("line").collect()
    assert [(r["line"], r["text"]) for r in short] == [(0, "limit reached"), *[(n, "plain") for n in range(1, 51)]]


@pytest.mark.parametrize("alpha, first", [(0.1, True), (0.5, False)])
def test_moving_average(spark, alpha, first):
    """Against one step after another: keys of one sample and of many, leading zeros, nulls, ties of time, slices and spans crossed."""
    draw = random.Random(5)
    rows = [(k, datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=draw.randrange(200 if k < 3 else 400_000)), i, draw.choice([0.0, None, *[draw.uniform(0, 9) for _ in range(4)]])) for i in range(2000) for k in [draw.choice([0, 1, 2, 2, 2, 2, 3, 4])]]
    rows += [(7, rows[0][1], 0, 0.0), (7, rows[0][1], 1, 5.0), (8, rows[0][1], 0, None)]
    want = {}
    for k, _, _, x in sorted(rows, key=lambda r: r[:3]):
        y = want.setdefault(k, 0.0)
        if x is not None:
            want[k] = x if first and y == 0 else alpha * x + (1 - alpha) * y
    t = spark.createDataFrame(rows, "k int, at timestamp, id int, x double")
    got = {r["k"]: r["result"] for r in rolling.moving_average(t, ["k"], ["at", "id"], "x", alpha, first).collect()}
    assert got == pytest.approx(want)
    assert rolling.moving_average(t.limit(0), ["k"], ["at", "id"], "x", alpha, first).count() == 0


def test_next_fit(spark):
    draw = random.Random(6)
    rows = [(draw.choice("aaab") if i % 9 else None, i, draw.choice([0, None, 1, 5, 30, 99, 250])) for i in range(3000)]
    want, state = set(), {}
    for p, i, n in rows:
        pack, total = state.get(p, (0, 0))
        pack, total = (pack + 1, 0) if total and total + (n or 0) > 100 else (pack, total)
        state[p] = (pack, total + (n or 0))
        want.add((p, i, pack))
    t = spark.createDataFrame(rows, "p string, i int, n int").repartition(7)
    assert {(r["p"], r["i"], r["pack"]) for r in maintenance.pack_small_files(t, ["p"], ["i"], "n", 100, 1).collect()} == want
    sizes = collections.Counter((p, pack) for p, _, pack in want)
    assert maintenance.pack_small_files(t, ["p"], ["i"], "n", 100, 3).count() == sum(n for n in sizes.values() if n >= 3)


def test_results_of_several_batches(spark, tmp_path):
    """Complete results are those of the last batch; update results the last of each key."""
    for k in range(3):
        spark.range(4).selectExpr("id event_id", f"timestamp'2024-01-0{k + 1}' ts", "'view' event_type", "id % 2 user_id", "id + 1.0D value", "'{}' props").coalesce(1).write.parquet(str(tmp_path / "in" / f"events{k}.parquet"))
    files = sorted((tmp_path / "in").glob("events*/part-*.parquet"))
    (tmp_path / "flat").mkdir()
    for k, f in enumerate(files):
        f.rename(tmp_path / "flat" / f"events{k or ''}.parquet")
    t = streams.events(spark, str(tmp_path / "flat"), most_bytes=1)
    assert {r["n"] for r in streams.run(streams.tumbling(t, "1 day", "1 hour"), "complete").collect()} == {4}
    assert streams.run(streams.tumbling(t, "1 day", "1 hour"), "complete").count() == 3
    got = streams.run(streams.keyed_ema(t, "user_id", "value", 0.1), "update", by=["user_id"]).collect()
    assert sorted((r["user_id"], r["n"]) for r in got) == [(0, 6), (1, 6)]


def test_event_names(spark):
    assert len(O.EVENT_BITS) == len(set(O.EVENT_BITS)) == 37
    assert O.event_mask(["s3:ObjectAccessed:*"]) == 0b11111 and O.event_mask(["s3:ObjectAccessed:Get", "s3:ObjectAccessed:*"]) == 0b11111
    assert O.event_mask(["s3:ObjectRemoved:*"]) & O.event_mask(["s3:ObjectRemoved:DeleteAllVersions"]) == 0
    assert O.event_mask(["s3:ObjectTransition:*"]) == (1 << 26) | (1 << 27) | (1 << 35)
    assert all(e in O.EVENT_BITS for n in O.EVENTS for e in O.expand([n]))
    with pytest.raises(ValueError):
        O.event_mask(["s3:Nothing:*"])
    bits = spark.createDataFrame([("s3:IntelligentTiering",), ("no",)], "n string").select(O.event_bit(F.col("n")).alias("b")).collect()
    assert [r["b"] for r in bits] == [1 << 36, None]


def test_event_stream(spark):
    got = list(sinks.events(spark.range(5).coalesce(1), size=2))
    assert [k for k, _ in got] == ["Records", "Records", "Records", "End"] and json.loads(got[0][1][0]) == {"id": 0}


def truth(spark, col, **context):
    rows = spark.createDataFrame([(context,)], "ctx map<string,array<string>>")
    return rows.select(col.alias("x")).first()["x"]


def test_conditions(spark):
    c, both = F.col("ctx"), {"groups": ["art", "hr"]}
    assert truth(spark, C.string_condition(c, "StringNotEquals", "groups", ["prod", "art"], "ForAllValues"), **both) is False
    assert truth(spark, C.string_condition(c, "StringNotEquals", "groups", ["prod", "art"], "ForAnyValue"), **both) is True
    assert truth(spark, C.string_condition(c, "StringNotEquals", "none", ["prod"], "ForAllValues"), **both) is True
    assert truth(spark, C.string_condition(c, "StringEquals", "none", ["prod"], "ForAnyValue"), **both) is False
    assert truth(spark, C.numeric_condition(c, "GreaterThanIfExists", "n", 5), n=["5"]) is True
    assert truth(spark, C.numeric_condition(c, "GreaterThan", "n", 5), n=["x"]) is False
    assert truth(spark, C.ip_condition(c, "ip", ["10.1.2.3"]), ip=["10.1.2.3"]) is True
    assert truth(spark, C.ip_condition(c, "ip", ["10.0.0.0/8"]), ip=["bad", "10.1.2.3"]) is False
    assert truth(spark, C.ip_condition(c, "ip", ["10.0.0.0/8"], negate=True), x=["1"]) is True
    assert truth(spark, C.binary_condition(c, {"b": ["aGk="]}), b=["!!", "aGk="]) is True


def test_globs(spark):
    t = spark.createDataFrame([("uploads/test.csv",), ("uploads/subdir/file.csv",), ("uploads/test.txt",), ("",)], "k string")
    assert C.key_pattern("uploads/", ".csv") == "uploads/*.csv" and C.key_pattern("images/") == "images/*" and C.key_pattern("", ".jpg") == "*.jpg"
    assert [r[0] for r in t.select(C.key_glob(F.col("k"), "uploads/*.csv")).collect()] == [True, True, False, False]
    assert [r[0] for r in t.select(C.glob(F.col("k"), "")).collect()] == [False, False, False, True]


def test_policy_deny_wins_and_default_denies(spark):
    t = spark.createDataFrame([("get", "b/x"), ("put", "b/x"), ("get", "c/x")], "a string, r string")
    rules = [{"effect": "Allow", "action": ["*"], "resource": ["b/*"]}, {"effect": "Deny", "action": ["put"], "resource": ["*"]}]
    assert [r[0] for r in t.select(C.allowed(F.col("a"), F.col("r"), rules)).collect()] == [True, False, False]


def test_transitions():
    assert O.check_transition({"days": 3}) is None and O.check_transition({"days": -1}) and O.check_transition({}) and O.check_transition({"date": datetime.datetime(2024, 1, 1, 5)})


def events(spark, rows):
    return spark.createDataFrame([(datetime.datetime(2024, 1, 1, *t) if t else None, "Z", n, lv, "app", m, {}, "f", i, "json") for i, (t, n, lv, m) in enumerate(rows)],
                                 "timestamp timestamp, offset string, node string, level int, target string, message string, fields map<string,string>, file string, line long, kind string")


RULES = [
    {"id": "disk", "severity": 0, "match": {"message_prefix": "disk"}, "implies": ["quorum"]},
    {"id": "quorum", "severity": 1, "match": {"message_contains": "quorum"}},
]


def test_findings_and_causes(spark):
    t = events(spark, [((1, 0), "a", 4, "disk fault"), ((1, 2), "b", 4, "no quorum"), ((1, 3), "b", 3, "failed to sync /x/y after 3 retries"), (None, None, 3, "failed to sync /z after 9 retries"), ((1, 4), "a", 2, "fine")])
    found = diagnose.findings(t, RULES)
    assert {r["rule"]: (r["n"], r["nodes"]) for r in found.collect()} == {"disk": (1, ["a"]), "quorum": (1, ["b"])}
    assert diagnose.final_roots(diagnose.causes(found, RULES)).collect()[0].asDict() == {"symptom": "quorum", "root": "disk"}
    left = diagnose.clusters(diagnose.unmatched(t, RULES)).collect()
    assert [(r["template"], r["n"]) for r in left] == [("failed to sync <path> after <n> retries", 2)]
    assert [r["rule"] for r in diagnose.blocks(found, diagnose.final_roots(diagnose.causes(found, RULES))).collect()] == ["disk", "quorum"]
    assert "disk" in report.render(found) and report.render(found, "markdown").startswith("|") and json.loads(report.render(found, "json"))


def test_gap_and_timeline(spark):
    t = events(spark, [((3, m), "a", 2, "x") for m in range(4)] + [((3, 44, 30), "a", 2, "x")])
    assert [(r["gap_start"] % 60, r["gap_end"] % 60) for r in diagnose.gaps(t, ["node"]).collect()] == [(4, 44)]
    wide = events(spark, [((0, 0, 30), "a", 2, "x"), ((10, 0, 30), "a", 2, "x")])
    rows = diagnose.timeline(wide).collect()
    assert len(rows) == 41 and sum(r["n"] == 0 for r in rows) == 39


def test_rules_are_checked():
    bad = [{"id": "", "match": {"all": []}}, {"id": "x", "match": {"message_regex": "("}}, {"id": "x", "match": {"message_prefix": "a"}, "anchors": ["short"]}]
    assert len(diagnose.check_rules(bad)) == 5 and diagnose.check_rules(RULES) == []
    assert diagnose.override(RULES, [{"id": "disk", "severity": 3, "match": {"is_panic": None}}])[0]["severity"] == 3


def test_parse(spark):
    lines = ['{"timestamp":"2024-05-01T10:00:00+08:00","level":"warn","message":"m","reason":"r"}', 'svc | {"level":"LOUD","timestamp":"no","message":"m2"}', "plain", '{"a":1}', ""]
    t = spark.createDataFrame([("n", "f", i, x) for i, x in enumerate(lines)], "node string, file string, line long, text string")
    rows = {r["line"]: r for r in parse.parse_lines(t).collect()}
    assert sorted(rows) == [0, 1, 2, 3]
    assert (rows[0]["level"], rows[0]["offset"], rows[0]["fields"], rows[0]["kind"]) == (3, "+08:00", {"reason": "r"}, "json")
    assert rows[1]["fields"] == {"timestamp_raw": "no", "level_raw": "LOUD"} and rows[2]["kind"] == rows[3]["kind"] == "text"
    now = datetime.datetime(2024, 1, 2)
    assert parse.time_argument("24h", now) == datetime.datetime(2024, 1, 1)
    with pytest.raises(ValueError):
        parse.time_argument("-5m", now)


def test_redaction(spark):
    t = spark.createDataFrame([("key=abc from 1.2.3.4 and fe80:0:0:0:1:2:3:4",)], "s string")
    out = t.select(redact.redact_text()(F.col("s"))).first()[0]
    assert out.count("h:") == 3 and "abc" not in out and "1.2.3.4" not in out


def test_redacted_names(spark):
    """Every listed name in any case, quoted values, ports, compressed IPv6; clocks, module paths and other names stay."""
    says = {
        "accessKey: 'AK1', path=/a/b) user=x": 3, "endpoint=1.2.3.4:9000": 1, "to 1.2.3.4:9000 ok": 1, "fe80::1 and ::1": 1,
        "at 10:11:12 in app::server::http secret=s token=t": 0,
    }
    t = spark.createDataFrame([(k,) for k in says], "s string")
    for r in t.select("s", redact.redact_text()(F.col("s")).alias("o")).collect():
        assert r["o"].count("h:") >= says[r["s"]] and (says[r["s"]] or r["o"] == r["s"]), r
    assert ":9000" not in t.where("s like 'to %'").select(redact.redact_text()(F.col("s"))).first()[0]
    got = spark.createDataFrame([("a/b!c.log",), ("c.log",)], "p string").select(redact.redact_provenance(F.col("p"))).collect()
    assert got[0][0] == "h:" + hashlib.sha256(b"a/b").hexdigest()[:16] + "!c.log" and got[1][0] == "c.log"


def test_templates(spark):
    says = {
        "a=/x/y /p/q,r end": "a=/x/y <path> end", "2024-01-02T03:04:05.6Z 2024-01-02 03:04:05": "<ts> <n>-<n>-<n> <n>:<n>:<n>",
        "1.2.3.4:9000 'n' `m` \"o\" 12": "<addr> '<q>' `<q>` \"<q>\" <n>",
    }
    t = spark.createDataFrame([(k,) for k in says], "s string")
    assert {r[0]: r[1] for r in t.select("s", diagnose.template(F.col("s"))).collect()} == says


def test_spared_versions_count(spark):
    """Young and blocked versions are spared too: with two young ones before them, old versions go at once."""
    rows = [("a", i, i >= 2, True) for i in range(4)] + [("b", 0, True, False), ("b", 1, True, False), ("b", 2, True, True), ("b", 3, False, True)]
    t = spark.createDataFrame(rows, "k string, i int, old boolean, can boolean")
    got = O.expire_noncurrent(t, "k", [F.col("i")], 2, F.col("old"), F.col("can")).where("action <> 'None'").collect()
    assert sorted((r["k"], r["i"]) for r in got) == [("a", 2), ("a", 3), ("b", 2)]


def test_addresses_of_version_6(spark):
    c = F.col("ctx")
    for value, net, want in [
        ("2001:db8::1", "2001:db8::/32", True), ("2001:DB9::1", "2001:db8::/32", False), ("::ffff:10.0.0.1", "::ffff:0:0/96", True), ("::", "::/128", True),
        ("10.0.0.1", "::/0", False), ("1:2:3:4:5:6:7:8", "1:2:3:4::/64", True), ("1::2::3", "::/0", False), ("1:2:3:4:5:6:7", "::/0", False), ("010.0.0.1", "0.0.0.0/0", False),
    ]:
        assert truth(spark, C.ip_condition(c, "ip", [net]), ip=[value]) is want, value
    assert truth(spark, C.ip_condition(c, "ip", ["10.0.0.0/8"]), ip=["fe80::1", "10.1.2.3"]) is True


def test_panic_blocks(spark):
    lines = [
        "thread 'a' panicked at x.rs:1:2:", "  boom ", "stack backtrace:", "   0: f", "note: n", "out",
        "thread 'b' panicked at 'old style', y.rs:3", "not part", "thread 'c' panicked at z.rs:9:", '{"level":"ERROR"}', "  stray",
        "thread 'd' panicked at w.rs:1:", "thread 'e' panicked at v.rs:2:", "", "after", "thread 'f' panicked at nowhere",
    ]
    t = spark.createDataFrame([("n", "f", i, x) for i, x in enumerate(lines)], "node string, file string, line long, text string")
    rows = {r["line"]: r for r in parse.fold_panics(t, most=60).collect()}
    panics = {k: r["text"] for k, r in rows.items() if r["kind"] == "panic"}
    assert panics == {
        0: "thread 'a' panicked at x.rs:1:2: boom", 6: "thread 'b' panicked at y.rs:3: old style", 8: "thread 'c' panicked at z.rs:9: ",
        11: "thread 'd' panicked at w.rs:1: ", 12: "thread 'e' panicked at v.rs:2: ",
    }
    assert sorted(k for k, r in rows.items() if r["kind"] == "line") == [5, 7, 9, 10, 14, 15]
    assert rows[0]["fields"]["panic_full"] == "\n".join(lines[:3]) + "\n" + parse.TRUNCATED and rows[6]["fields"] == {"panic_thread": "b", "panic_location": "y.rs:3", "panic_full": lines[6]}


def test_compaction_takes_whole_subtrees(spark):
    paths = ["all/a/b/1", "all/a/b/2", "all/a/c/3", "all/d/4", "all/d/5", "all/d/6", "all/e/7"]
    nodes = rollup.tree(spark.createDataFrame([(p, 1) for p in paths], "path string, size int"), "path", "size")
    got = {r["node"]: r["collapsed"] for r in rollup.compact(nodes, "all", 9).collect()}
    # 12 descendants: c and e (one object each) give up two, then b gives up two
    assert {k for k, v in got.items() if v} == {"all/a/c", "all/e", "all/a/b"} and len(got) - 1 == 8
    assert not any(r["collapsed"] for r in rollup.compact(nodes, "all", 12).collect())


def test_pages(spark):
    t = spark.createDataFrame([(k,) for k in ("a/1", "a/2", "b", "c/d/3", "c/e")], "key string")
    assert [(r["entry"], r["is_prefix"]) for r in pagination.list_keys(t, "key", "", "/", 10).collect()] == [("a/", True), ("b", False), ("c/", True)]
    assert [r["entry"] for r in pagination.list_keys(t, "key", "c/", "/", 10).collect()] == ["c/d/", "c/e"]
    rows, more, marker = pagination.page_with_markers(t, ["key"], None, 2)
    assert [r["key"] for r in rows] == ["a/1", "a/2"] and more and marker == ("a/2",)


def test_the_engine_stands_alone(tmp_path):
    """Without the llm folders the registry still loads, with the pipeline's file there or gone."""
    import shutil

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "lakeloom", tmp_path / "lakeloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    if (root / "corpus_pipeline.py").exists():
        shutil.copy(root / "corpus_pipeline.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
