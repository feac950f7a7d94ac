"""Every query of the engine's own operators against its SQL, and small vectors by hand."""

import json
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from millrace.functions import values as v
from millrace.operators import analytics, grep, lifecycle, listing, policy, security
from millrace.plans import queries
from millrace.sources import table_log
from millrace.streaming import delivery

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for table in ("part", "orders", "documents", "pages", "customer", "events", "lineitem", "nation", "supplier"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    df = queries.QUERIES[name](spark, FOLDER)
    want = con.execute(queries.ORACLE_SQL[name])
    names = [x[0] for x in want.description]
    assert sorted(names) == sorted(df.columns)
    got = Counter(tuple(r[n] for n in names) for r in df.collect())
    assert got == Counter(want.fetchall()) and (got or name in ("grep_documents", "grep_invert"))


def test_grep_offsets_caps_and_invert(spark):
    df = spark.createDataFrame([(1, "é ab\r\nxx\nab ab\n"), (2, None), (3, "")], "k int, t string")
    got = [tuple(r) for r in grep.grep(df, "k", "t", "ab").orderBy("line_number").collect()]
    assert got == [(1, 1, 0, 7, 3, 2, "é ab", False, False), (1, 3, 10, 6, 10, 2, "ab ab", False, False)]
    assert [(r["line_number"], r["match_length"]) for r in grep.grep(df, "k", "t", "ab", invert=True).collect()] == [(2, 0)]
    one = grep.grep(df, "k", "t", "A", case_insensitive=True, max_matches=1, content_max_bytes=1).collect()
    assert [(r["line_number"], r["content"], r["truncated"], r["capped"]) for r in one] == [(1, "", True, True)]
    assert grep.grep(df, "k", "t", ".", literal=True).count() == 0


def _sql_and_rows(spark, folder, name, table):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    want = con.execute(queries.ORACLE_SQL[name])
    names = [x[0] for x in want.description]
    return Counter(tuple(r[n] for n in names) for r in queries.QUERIES[name](spark, str(folder)).collect()), Counter(want.fetchall())


def test_grep_documents_of_long_and_many_lines(spark, tmp_path):
    texts = ["x " * 5000 + "a@b.c\r\nshort a@b.c", "a@b.c\n" * 1300, "q@r.s\r\u2028"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got, want = _sql_and_rows(spark, tmp_path, "grep_documents", "documents")
    assert got == want and len(got) == 1303


def test_grep_literal_of_long_and_many_lines(spark, tmp_path):
    texts = ["x " * 4094 + "ing.", "x " * 4094 + "Ing.\r\r", "x " * 4095 + "ing.\nshort ing.", "RING.\n" * 1300]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got, want = _sql_and_rows(spark, tmp_path, "grep_literal", "documents")
    assert got == want and len(got) == 1303


def test_select_strings_of_small_negative_balances(spark, tmp_path):
    balances = [-0.01, -0.5, -0.49, 0.0, -0.0, 0.49, 0.5, 2.5, -2.5, -999.99, 9999.5, None]
    rows = [(i, f"Customer#{i:09}", i, "AUTOMOBILE", x) for i, x in enumerate(balances)]
    spark.createDataFrame(rows, "c_custkey long, c_name string, c_nationkey int, c_mktsegment string, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    got, want = _sql_and_rows(spark, tmp_path, "select_strings", "customer")
    assert got == want and sum(r[-1] == "-0.0" for r in got) == 3


def test_listing_rolls_up_and_pages(spark):
    df = spark.createDataFrame([(k,) for k in ("1", "k0", "k1/x", "k1/y", "k2", "q", None)], "key string")
    seen, after = [], ""
    while page := [r["entry"] for r in listing.list_objects(df, "key", delimiter="/", start_after=after, max_keys=2).collect()]:
        seen, after = seen + page, page[-1]
    assert seen == ["1", "k0", "k1/", "k2", "q"]


def test_values(spark):
    df = spark.createDataFrame([("7.9", "3"), ("inf", "x"), (" 12 ", "3.0"), (None, None)], "a string, b string")
    rows = df.select(v.integer(F.col("a")), v.number(F.col("a")), v.equals(F.col("b"), F.lit(3))).collect()
    assert [tuple(r) for r in rows] == [(7, 7.9, True), (None, None, False), (12, 12.0, True), (None, None, None)]
    one = spark.range(1).select(v.substring(F.lit("abcdef"), -2, 5), v.substring(F.lit("abcdef"), 0, 3), v.like(F.lit("a%b"), "a\\%b", "\\"), v.like(F.lit("a\\b"), "a\\_"), v.divide(F.lit(-7), F.lit(2)))
    assert tuple(one.first()) == ("ab", "ab", True, True, -3)
    months = spark.sql("SELECT timestamp'2014-01-30 15:14:29' a, timestamp'2014-03-01 15:14:28' b, timestamp'2008-03-30 13:36:55' c, timestamp'2008-02-29 14:36:55' d")
    assert tuple(months.select(v.month_diff(F.col("a"), F.col("b")), v.month_diff(F.col("c"), F.col("d"))).first()) == (1, -1)


def test_decisions_and_null_requests(spark):
    df = spark.createDataFrame([("u1", "GET", "b/x"), ("u2", "get", "b/x"), (None, "put", "c")], "p string, a string, r string")
    rules = [{"effect": "Allow", "actions": ["g?t"], "resources": ["b/*"]}, {"effect": "Deny", "principals": ["u2"], "actions": ["*"], "resources": ["*"]}]
    assert [r[0] for r in df.select(policy.decide(rules, F.col("p"), F.col("a"), F.col("r"))).collect()] == ["Allow", "Deny", "ImplicitDeny"]


def test_table_log(spark, tmp_path):
    log = tmp_path / "_delta_log"
    log.mkdir()
    commits = [[{"protocol": {"minReaderVersion": 1}}, {"add": {"path": "a", "size": 1}}, {"add": {"path": "b", "size": 2}}], [{"remove": {"path": "a"}}, {"add": {"path": "c", "size": 3}}, {"txn": {}}], [{"add": {"path": "a", "size": 9}}]]
    for i, actions in enumerate(commits):
        (log / f"{i:020}.json").write_text("\n".join(map(json.dumps, actions)))
    assert sorted((r["path"], r["size"]) for r in table_log.snapshot(spark, str(tmp_path)).collect()) == [("a", 9), ("b", 2), ("c", 3)]
    assert sorted(r["path"] for r in table_log.snapshot(spark, str(tmp_path), 1).collect()) == ["b", "c"]


def test_delivery(spark, tmp_path):
    (tmp_path / "in").mkdir()
    spark.createDataFrame([("x", "2024-01-01 10:00:00", None), ("y", "2024-01-02 00:00:00", "q")], "owner string, ts string, f string").write.mode("overwrite").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("owner string, ts string, f string").parquet(str(tmp_path / "in"))
    lines = stream.select("owner", "ts", delivery.access_line(F.col("owner"), F.col("f")).alias("line"))
    for _ in range(2):
        delivery.deliver(lines, "owner", F.substring("ts", 1, 10), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    got = spark.read.option("basePath", str(tmp_path / "out")).parquet(str(tmp_path / "out"))
    assert sorted((r["owner"], str(r["log_date"]), r["line"]) for r in got.collect()) == [("x", "2024-01-01", "x -"), ("y", "2024-01-02", "y q")]
