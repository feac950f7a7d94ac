"""Vectors by hand and brute force for values, timestamps, sources, sinks, rules, reports and delivery."""

import json
import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from millrace.functions import aggregates, timestamps as t, values as v
from millrace.operators import analytics, grep, lifecycle, listing, policy, security
from millrace.sinks import records
from millrace.sources import delimited, table_log
from millrace.streaming import delivery


def test_timestamps_keep_offset_and_precision(spark):
    texts = ["1999T", "1999-08T", "1999-08-07", "1999-08-07T05:06Z", "1999-08-07T05:06:07.25+05:45", "19990807T050607-0130", None]
    df = spark.createDataFrame([(x,) for x in texts], "s string").withColumn("t", t.parse(F.col("s")))
    got = [tuple(r) for r in df.select("t.prec", "t.off", "t.ts").collect()]
    assert got == [(0, 0, datetime(1999, 1, 1)), (1, 0, datetime(1999, 8, 1)), (2, 0, datetime(1999, 8, 7)), (3, 0, datetime(1999, 8, 7, 5, 6)), (6, 345, datetime(1999, 8, 6, 23, 21, 7, 250000)), (4, -90, datetime(1999, 8, 7, 6, 36, 7)), (None, None, None)]
    shown = [r[0] for r in df.select(t.to_string(F.col("t"), "yy MMM d 'o''clock' hh:mm:ss.SS a X xxx")).collect()]
    assert shown[4] == "99 Aug 7 oclock 05:06:07.25 AM +0545 +05:45" and shown[3].endswith("AM Z +00:00") and shown[6] is None
    with pytest.raises(ValueError):
        t.to_string(F.col("t"), "Q")
    with pytest.raises(Exception, match="CastFailed"):
        spark.createDataFrame([("1999-13-01",)], "s string").select(t.parse(F.col("s"))).collect()
    pairs = spark.createDataFrame([("2020-01-31", "2020-02-29"), ("2020-03-30", "2020-02-29")], "a string, b string").select(t.parse(F.col("a")).alias("a"), t.parse(F.col("b")).alias("b"))
    assert [tuple(r) for r in pairs.select(t.date_diff("month", F.col("a"), F.col("b")), t.date_diff("day", F.col("a"), F.col("b")), t.date_add("month", F.lit(1), F.col("a"))["ts"]).collect()] == [(0, 29, datetime(2020, 2, 29)), (-1, -30, datetime(2020, 4, 30))]


def test_values_and_aggregates_of_text(spark):
    numbers = {2.0: "2.0", 0.25: "0.25", 3e200: "3e200", 2e7: "20000000.0", 98765432.1: "98765432.1", 2.5e-8: "2.5e-8", 0.0007: "0.0007"}
    df = spark.createDataFrame([(x,) for x in numbers], "d double")
    assert [r[0] for r in df.select(v.float_text(F.col("d"))).collect()] == list(numbers.values())
    df = spark.createDataFrame([("30",), ("4",), (" 2.5",), (None,)], "s string")
    row = df.agg(aggregates.total(F.col("s")).alias("t"), aggregates.extreme(F.col("s")).alias("a"), aggregates.extreme(F.col("s"), True).alias("b")).first()
    assert (row["t"]["i"], row["t"]["d"], row["a"], row["b"]) == (None, 36.5, " 2.5", "30")
    big = spark.createDataFrame([("9223372036854775807",), ("1",)], "s string").agg(aggregates.total(F.col("s")).alias("t")).first()["t"]
    assert big["i"] is None and big["d"] == float(2**63)
    assert df.limit(0).agg(aggregates.total(F.col("s")).alias("t")).first()["t"] == (None, None)
    for bad in (v.cast(F.lit("x"), "int"), v.truth(F.lit("maybe"))):
        with pytest.raises(Exception, match="CastFailed|InvalidDataType"):
            spark.range(1).select(bad).collect()
    # the side that would fail is not evaluated
    assert tuple(spark.range(1).select(v.both(F.lit(False), v.truth(F.lit("x"))), v.either(F.lit(True), v.truth(F.lit("x")))).first()) == (False, True)


def test_delimited_records(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿Id,Word\n# note\n\n7,"he ""said"", so"\n,a"b,more\n"x"y\r\n')
    rows, names = delimited.read_delimited(spark, str(tmp_path / "a.csv"), header="USE")
    assert names == ["Id", "Word"] and [r[0] for r in rows.collect()] == [["7", 'he "said", so'], ["", 'a"b', "more"], ["xy"]]
    got = delimited.select(rows, [("n", v.integer(delimited.column("id", names))), ("m", F.col("n") + 1), ("w", delimited.column("_2", names))], F.col("m").isNull()).collect()
    assert [tuple(r) for r in got] == [(None, None, 'a"b'), (None, None, None)]
    with pytest.raises(ValueError, match="MissingHeaders"):
        delimited.column("zz", names)
    (tmp_path / "b.csv").write_text("1|'one\ntwo'|'it\\'s'\n3|4\n")
    split = dict(delimiter="|", quote="'", escape="\\")
    assert [r[0] for r in delimited.read_delimited(spark, str(tmp_path / "b.csv"), **split)[0].collect()] == [["1", "'one"], ["two'", "it's"], ["3", "4"]]
    assert [r[0] for r in delimited.read_delimited(spark, str(tmp_path / "b.csv"), quoted_records=True, width=4, **split)[0].collect()] == [["1", "one\ntwo", "it's"], ["3", "4"]]
    import gzip

    (tmp_path / "c.csv.gz").write_bytes(gzip.compress(b"p~q;;r;;"))
    assert [r[0] for r in delimited.read_delimited(spark, str(tmp_path / "c.csv.gz"), delimiter="~", record_delimiter=";;")[0].collect()] == [["p", "q"], ["r"]]


def test_json_records_and_lines(spark, tmp_path):
    (tmp_path / "j.json").write_text('{"a":{"B":[{"x":1},{"x":null},{}]},"k":"v"}\n{"a":5}\n')
    rows = delimited.read_json(spark, str(tmp_path / "j.json"))
    found = delimited.walk(rows, ["a", "b", "[*]"])
    x = delimited.member(F.col("record"), "x")
    assert [tuple(r) for r in found.select(delimited.scalar(x).alias("s"), delimited.is_missing(x).alias("m"), delimited.is_null(x).alias("n")).collect()] == [("1", False, False), (None, False, True), (None, True, True)]
    assert delimited.walk(rows, [".*"]).count() == 3 and delimited.walk(rows, ["a", "b", 1]).count() == 1
    df = spark.createDataFrame([('a"b,c', 1.5, None, [1, 2]), ("x\ny", float("nan"), 7, None)], "s string, d double, n long, l array<int>")
    lines = df.select(records.delimited([records.text_of(df, c) for c in df.columns]).alias("c"), records.json_object(df, missing={"n": F.col("n").isNull()}).alias("j")).collect()
    assert [r["c"] for r in lines] == ['"a""b,c",1.5,,"[1,2]"', '"x\ny",NaN,7,']
    assert [json.loads(r["j"]) for r in lines] == [{"s": 'a"b,c', "d": 1.5, "l": [1, 2]}, {"s": "x\ny", "d": "NaN", "n": 7, "l": None}]
    assert records.output_names([(None, None), ("z", "k"), (None, "k")]) == ["_1", "z", "k"]


def test_grep_grows_with_the_text(spark):
    def seconds(n):
        df = spark.createDataFrame([(1, "plain line\n" * n)], "k int, t string")
        start = time.perf_counter()
        assert grep.grep(df, "k", "t", "absent").count() == 0
        return time.perf_counter() - start

    seconds(1000)
    assert seconds(40000) < 8 * seconds(10000) + 1


def test_pages_follow_their_tokens(spark):
    keys = [f"{a}/{b}" for a in "pqr" for b in "12"] + ["a", "z"]
    df = spark.createDataFrame([(k,) for k in keys], "key string")
    seen, token = [], None
    while True:
        page = listing.list_page(df, "key", delimiter="/", token=token, max_keys=2).collect()
        seen += [r["entry"] for r in page]
        if not page[0]["is_truncated"]:
            break
        token = page[0]["next_token"]
    assert seen == ["a", "p/", "q/", "r/", "z"]
    rows = spark.createDataFrame([("a", 1, 10, False), ("a", 2, 5, False), ("b", 3, 1, True), ("a", 1, 10, False)], "key string, version int, at int, is_marker boolean")
    found = listing.list_versions(rows, "key", "version", "at", max_keys=9).collect()
    assert [(r["key"], r["version"], r["is_latest"]) for r in found] == [("a", 1, True), ("a", 2, False), ("b", 3, True)]
    assert [r["version"] for r in listing.list_versions(rows, "key", "version", "at", key_marker="a", version_marker=1, max_keys=9).collect()] == [2, 3]
    ups = spark.createDataFrame([("k", "u1"), ("k", "u2"), ("m", "u0")], "key string, upload string")
    assert [r["upload"] for r in listing.list_uploads(ups, "key", "upload", key_marker="k", upload_marker="u1").collect()] == ["u2", "u0"]
    assert spark.range(1).select(listing.url_encoded(F.lit("a b/ü~"))).first()[0] == "a%20b%2F%C3%BC~"


def test_lifecycle_of_markers_dates_and_rules(spark):
    day = lambda d: datetime(2024, 1, d)
    versions = [("a", 3, day(9), 5, {}, False), ("a", 2, day(5), 5, {}, True), ("a", 1, day(1), 5, {}, False), ("lone", 9, day(1), 0, {}, True), ("t", 4, day(8), 50, {"x": "y"}, False)]
    df = spark.createDataFrame(versions, "key string, version int, modified timestamp, size long, tags map<string,string>, is_marker boolean")
    rules = [{"id": "d", "date": "2024-01-10 00:00:00", "tags": {"x": "y"}}, {"id": "n", "noncurrent_days": 2, "keep_newest": 1}, {"id": "m", "lone_marker": True, "prefix": "l"}, {"id": "s", "days": 1, "size_over": 60}]
    got = {(r["version"], r["action"], r["rule"]) for r in lifecycle.due(df, rules, "2024-01-12 00:00:00").collect()}
    assert got == {(4, "expire", "d"), (1, "delete_noncurrent", "n"), (9, "remove_marker", "m")}
    assert [r["version"] for r in lifecycle.due(df, rules, "2024-01-01 00:00:00").collect()] == [9] and lifecycle.scan_prefix([{"prefix": "log/a"}, {"prefix": "log/b"}]) == "log/"
    assert lifecycle.stale_uploads(spark.createDataFrame([("k", day(1)), ("k", day(9))], "key string, begun timestamp"), "begun", "2024-01-10 00:00:00", 7).count() == 1


def test_policy_sets_networks_and_folds(spark):
    df = spark.createDataFrame([("10.1.2.3", ["a", "b"]), ("::ffff:10.1.2.3", ["a", "c"]), ("2001:db8::5", []), ("junk", None)], "ip string, tags array<string>")
    context = F.when(F.col("tags").isNull(), F.create_map().cast("map<string,array<string>>")).otherwise(F.create_map(F.lit("ip"), F.array("ip"), F.lit("tags"), F.col("tags")))
    cases = {
        ("IpAddress", "ip", ("10.1.0.0/16",)): [True, True, False, False], ("NotIpAddress", "ip", ("10.1.0.0/16",)): [False, False, True, True],
        ("IpAddress", "ip", ("2001:db8::/32",)): [False, False, True, False], ("ForAllValues:StringEquals", "tags", ("a", "b")): [True, False, True, True],
        ("ForAnyValue:StringEquals", "tags", ("c",)): [False, True, False, False], ("StringNotEquals", "tags", ("c",)): [True, False, True, True],
        ("StringEqualsIfExists", "tags", ("A",)): [False, False, True, True], ("StringEqualsIgnoreCase", "tags", ("A",)): [True, True, False, False],
        ("Null", "tags", ("true",)): [False, False, True, True], ("Sorted", "tags", ("a",)): [False] * 4,
    }
    for (op, key, want), expected in cases.items():
        assert [r[0] for r in df.select(policy.condition(op, key, want, context)).collect()] == expected, op
    dates = spark.range(1).select(policy.condition("DateLessThan", "d", ["2024-01-02T00:00:00Z"], F.create_map(F.lit("d"), F.array(F.lit("2024-01-01T23:00:00-02:00")))), policy.condition("NumericGreaterThanEquals", "d", ["7"], F.create_map(F.lit("d"), F.array(F.lit("7.0")))))
    assert tuple(dates.first()) == (False, True)
    none = spark.createDataFrame([(None, "get", "x")], "p string, a string, r string")
    rule = {"effect": "Deny", "actions": ["*"], "resources": ["*"]}
    assert none.select(policy.decide([rule], F.col("p"), F.col("a"), F.col("r"))).first()[0] == "Deny"
    assert none.select(policy.decide([rule | {"principals": ["u*"]}], F.col("p"), F.col("a"), F.col("r"))).first()[0] == "ImplicitDeny"
    fold = spark.range(1).select(policy.folded([F.lit("Allow"), F.lit("Deny")]), policy.folded([F.lit("ImplicitDeny"), F.lit("Allow")]), policy.post_allowed([("starts-with", "$key", "up/"), ("content-length-range", 1, 9)], F.create_map(F.lit("key"), F.lit("up/a")), F.lit(4)))
    assert tuple(fold.first()) == ("Deny", "Allow", True)


def test_quota_replay_against_a_loop(spark):
    writes = [(g, i, (i * 7 + g) % 5 + 1, 3, 12 if g else None) for g in (0, 1, 2) for i in range(9)]
    got = analytics.admitted(spark.createDataFrame(writes, "g int, i int, n long, used long, quota long").repartition(4), "g", "i", "n", "used", "quota").collect()
    since, want = {}, {}
    for g, i, n, used, quota in writes:
        want[g, i] = not quota or used + since.get(g, 0) + n <= quota
        since[g] = since.get(g, 0) + n * want[g, i]
    assert {(r["g"], r["i"]): r["admitted"] for r in got} == want and len(set(want.values())) == 2


def test_reports_of_versions_and_stripes(spark):
    rows = spark.createDataFrame([("b", 5, True, False), ("b", 7, False, False), ("b", 0, True, True)], "bucket string, size long, is_latest boolean, is_marker boolean")
    assert tuple(analytics.version_counters(rows).first()) == ("b", 1, 5, 1, 7)
    stripes = spark.createDataFrame([([(10, 4, 2), (3, 2, 1)],)], "s array<struct<size:long,k:int,m:int>>")
    assert stripes.select(analytics.stored_bytes(F.col("s"))).first()[0] == 3 * 6 + 2 * 3
    share = analytics.duplicate_share(spark.createDataFrame([("\0" * 8 + "abcdabcd",)], "t string"), "t", 4).first()
    assert (share["chunks"], share["unique_chunks"], share["duplicate_bytes"], share["zero_bytes"]) == (4, 1, 4, 8)
    p = analytics.percentiles(spark.createDataFrame([("g", float(x)) for x in (1, 2, 3, 4)], "g string, x double"), "g", "x", [0.5], nearest_rank=False).first()
    assert p["x"] == 3.0  # place round(3 * 0.5) from 0


def test_logs_that_are_not_whole_are_refused(spark, tmp_path):
    log = tmp_path / "_delta_log"
    log.mkdir()
    line = lambda *a: "\n".join(map(json.dumps, a))
    (log / f"{0:020}.json").write_text(line({"metaData": {"id": "m", "schemaString": "{}", "partitionColumns": ["p"]}}, {"add": {"path": "a", "size": 3, "partitionValues": {"p": "1", "q": None}}}))
    (log / f"{1:020}.json").write_text(line({"add": {"path": "b", "size": 4}}, {"remove": {"path": "b"}}, {"protocol": {"minReaderVersion": 1}}))
    (log / "notes.json").write_text("{}")
    assert [r["path"] for r in table_log.snapshot(spark, str(tmp_path)).collect()] == ["a"]  # a remove after an add in one commit counts
    head = table_log.metadata(spark, str(tmp_path)).first()
    assert (head["version"], head["metaData"]["id"], head["protocol"]["minReaderVersion"], head["num_files"], head["bytes"]) == (1, "m", 1, 1, 3)
    body = json.loads(table_log.sharing_lines(table_log.snapshot(spark, str(tmp_path)), F.col("path")).first()[0])["file"]
    assert body["partitionValues"] == {"p": "1"} and len(body["id"]) == 64
    (log / f"{3:020}.json").write_text("{}")
    with pytest.raises(ValueError, match="lacks"):
        table_log.snapshot(spark, str(tmp_path))
    (log / f"{3:020}.checkpoint.parquet").write_bytes(b"x")
    with pytest.raises(ValueError, match="checkpoint"):
        table_log.snapshot(spark, str(tmp_path))


def test_security_and_delivery(spark):
    df = spark.createDataFrame([("ann", 1, "x"), ("bob", 2, "y")], "owner string, n int, s string")
    assert [r["n"] for r in security.rows_for(df, ["owner = current_user()"], "ann").collect()] == [1]
    assert security.visible(df, [{"allowed": ["owner", "n"]}, {"excluded": ["n"]}]).columns == ["owner"]
    security.register(spark, "hide", "x STRING", "concat('#', left(x, 1))", "STRING")
    assert [r["owner"] for r in security.masked(df, {"owner": "hide(owner)"}).collect()] == ["#a", "#b"]
    assert df.limit(1).select(delivery.access_line(F.col("owner"), F.lit(None), F.lit('a "b"\n'), F.lit(""), quoted=(2,))).first()[0] == 'ann - "a %22b%22 " -'
    lines = spark.createDataFrame([("d", i, "x" * 9) for i in range(10)], "d string, i int, line string")
    assert [r["object"] for r in delivery.rolled(lines, "d", F.col("i"), F.col("line"), most_bytes=30).orderBy("i").collect()] == [0, 0, 0, 1, 1, 1, 2, 2, 2, 3]
