"""Queries of numbers and cases, version pages, uploads, counters, folded policies, stored functions, log lines and merges, and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values as v
from ..operators import analytics, chunking, lifecycle, listing, ordered, policy, security
from ..sources import delimited
from ..streaming import delivery
from .more import NOW, _table, _versions, usage_buckets

FORM = [("eq", "$kind", "error"), ("starts-with", "$Key", "1"), ("content-length-range", 5, 50)]


def select_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checked arithmetic, truncating division and remainder of either sign, both forms of CASE, defaults."""
    rows = _table(spark, sf_dir, "orders")
    n = F.col("o_custkey") - 500
    size = F.when(n < -100, "low").when(n > 100, "high").otherwise("near")
    urgent = F.when(F.col("o_orderpriority") == "1-URGENT", 1).when(F.col("o_orderpriority") == "2-HIGH", 2)
    return rows.select("o_orderkey", v.divide(n, F.lit(7)).alias("part"), v.modulo(n, F.lit(7)).alias("rest"), (n * 3 - F.col("o_orderkey")).alias("made"), (-n).alias("other"), size.alias("size"), F.coalesce(urgent, F.lit(0)).alias("urgent"))


def select_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LIMIT over a stated order."""
    return delimited.first_records(_table(spark, sf_dir, "orders").filter("o_orderstatus = 'O'"), 25, "o_orderkey")


def list_versions_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page behind a version of a key: the rest of that key, newest first, then the keys after it."""
    rows = _versions(spark, sf_dir).select("key", "version", "modified", "is_marker")
    return listing.list_versions(rows, "key", "version", "modified", prefix="1", key_marker="11", version_marker=str(rows.filter("key = '11'").agg(F.max("version")).first()[0]), max_keys=120)


def list_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _versions(spark, sf_dir).select("key", F.lpad(F.col("version").cast("string"), 8, "0").alias("upload"), "modified")
    return listing.list_uploads(rows, "key", "upload", prefix="1", key_marker="1", upload_marker="00000500", max_uploads=90)


def list_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem").filter("l_orderkey = 7").select("l_linenumber", "l_quantity").distinct()
    return listing.list_parts(rows, "l_linenumber", marker=1, max_parts=3).select("l_linenumber")


def list_encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", listing.url_encoded(F.concat(F.col("url"), F.lit(" ~é+*"))).alias("key"))


def list_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two overlapping parts of the orders as one ordered page."""
    rows = _table(spark, sf_dir, "orders")
    return ordered.union_page([rows.filter("o_orderkey % 3 <> 0"), rows.filter("o_orderkey % 2 = 0")], "o_orderkey", 150, 40)


def first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.first_seen(_table(spark, sf_dir, "events"), ["user_id", "event_type"], F.col("event_id"))


def ranked_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of one type, a fifth of all rows under one key, ranked by slices of time, with a running count."""
    rows = _table(spark, sf_dir, "events").select("event_type", "ts", "event_id", "value")
    out = ordered.ranked(rows, "event_type", "ts", "event_id", {"large": F.col("value") > 20})
    return out.select("event_id", F.col("_rank").alias("place"), F.unix_micros(F.col("_superseded").cast("timestamp")).alias("superseded"), F.col("_n").alias("n"), "large")


def usage_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.usage_of_cluster(usage_buckets(spark, sf_dir))


def version_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = listing.list_versions(_versions(spark, sf_dir), "key", "version", "modified")
    return analytics.version_counters(rows.select(F.col("key").alias("bucket"), "size", "is_latest", "is_marker"))


def stored_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order as an object of two stripes, 4+2 and 1+2."""
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    stripe = lambda size, k, m: F.struct(size.alias("size"), F.lit(k).alias("k"), F.lit(m).alias("m"))
    return _table(spark, sf_dir, "orders").select("o_orderkey", analytics.stored_bytes(F.array(stripe(cents, 4, 2), stripe(F.col("o_custkey"), 1, 2))).cast("long").alias("stored"))


def stale_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.stale_uploads(_versions(spark, sf_dir).select("key", "version", "modified"), "modified", NOW, 20, "3").select("key", "version")


def policy_folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog, namespace and table each decide; a deny at any level refuses."""
    levels = [
        [{"effect": "Allow", "actions": ["Read"], "resources": ["*"], "principals": ["1*"]}],
        [{"effect": "Allow", "actions": ["*"], "resources": ["p*"], "principals": ["*"]}, {"effect": "Deny", "actions": ["*"], "resources": ["*"], "principals": ["*3"]}],
        [{"effect": "Deny", "actions": ["Read"], "resources": ["error"], "principals": ["*"]}],
    ]
    user = F.col("user_id").cast("string")
    found = [policy.decide(x, user, F.lit("Read"), F.col("event_type")) for x in levels]
    return _table(spark, sf_dir, "events").select("event_id", policy.folded(found).alias("decision"))


def post_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = F.create_map(F.lit("kind"), F.col("event_type"), F.lit("key"), F.col("user_id").cast("string"))
    return _table(spark, sf_dir, "events").select("event_id", policy.post_allowed(FORM, fields, F.floor("value").cast("long")).alias("allowed"))


def networks(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    ip = F.concat_ws(".", F.lit("10"), (n % 7).cast("string"), (n % 256).cast("string"), (n % 199).cast("string"))
    return _table(spark, sf_dir, "events").select("event_id", policy.in_network(ip, "10.4.0.0/14").alias("wide"), policy.in_network(ip, "10.2.64.0/18").alias("narrow"), policy.in_network(ip, "10.1.1.1").alias("one"))


def stored_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored row filter and a stored mask, called by their names."""
    security.register(spark, "millrace_seen", "segment STRING, balance DOUBLE", "segment <> 'BUILDING' AND balance > 0", "BOOLEAN")
    security.register(spark, "millrace_short", "name STRING", "concat(left(name, 3), '...')", "STRING")
    rows = security.rows_for(_table(spark, sf_dir, "customer"), ["millrace_seen(c_mktsegment, c_acctbal) OR is_member('audit')"], "amy", ["sales"])
    return security.masked(rows, {"c_name": "millrace_short(c_name)"}).select("c_custkey", "c_name", "c_mktsegment")


def access_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as log lines, rolled into objects of 40 lines or 2,000 bytes a user."""
    line = delivery.access_line(F.col("event_id"), F.nullif("event_type", F.lit("view")), F.col("props"), quoted=(2,))
    rows = _table(spark, sf_dir, "events").select("user_id", "event_id", line.alias("line"))
    return delivery.rolled(rows, "user_id", F.col("event_id"), F.col("line"), 2000, 40)


def content_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duplicate share of the documents' texts, cut where their bytes say so."""
    return chunking.duplicate_share_by_content(_table(spark, sf_dir, "documents"), "text", 64, 256, 1024)


QUERIES = {
    f.__name__: f
    for f in (
        select_numbers, select_first, list_versions_page, list_uploads, list_parts, list_encoded, list_merged, first_seen, ranked_versions, usage_cluster, version_counters, stored_bytes,
        stale_uploads, policy_folded, post_forms, networks, stored_filter, access_lines, content_chunks,
    )
}

_V = "v AS (SELECT user_id::VARCHAR AS key, event_id AS version, ts AS modified, floor(value)::BIGINT AS size, event_type = 'signup' AS is_marker FROM events)"

ORACLE_SQL = {
    "select_numbers": """
WITH o AS (SELECT *, o_custkey - 500 AS n FROM orders)
SELECT o_orderkey, n // 7 AS part, n % 7 AS rest, n * 3 - o_orderkey AS made, -n AS other, CASE WHEN n < -100 THEN 'low' WHEN n > 100 THEN 'high' ELSE 'near' END AS size,
       coalesce(CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 END, 0)::INTEGER AS urgent FROM o""",
    "select_first": "SELECT * FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderkey LIMIT 25",
    "list_versions_page": f"""
WITH {_V}, w AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY modified DESC, version DESC) = 1 AS is_latest FROM v WHERE starts_with(key, '1')),
m AS (SELECT modified AS t, version AS n FROM w WHERE key = '11' ORDER BY version DESC LIMIT 1)
SELECT key, version, modified, is_marker, is_latest FROM w, m WHERE key > '11' OR (key = '11' AND (modified < t OR (modified = t AND version < n))) ORDER BY key, modified DESC, version DESC LIMIT 120""",
    "list_uploads": f"WITH {_V} SELECT key, lpad(version::VARCHAR, 8, '0') AS upload, modified FROM v WHERE starts_with(key, '1') AND (key > '1' OR (key = '1' AND lpad(version::VARCHAR, 8, '0') > '00000500')) ORDER BY key, upload LIMIT 90",
    "list_parts": "SELECT l_linenumber FROM (SELECT DISTINCT l_linenumber, l_quantity FROM lineitem WHERE l_orderkey = 7 AND l_linenumber > 1) ORDER BY l_linenumber LIMIT 3",
    "list_encoded": "SELECT page_id, replace(url_encode(url || ' ~é+*'), '%2A', '*') AS key FROM pages",
    "list_merged": "SELECT o_orderkey FROM orders WHERE (o_orderkey % 3 <> 0 OR o_orderkey % 2 = 0) AND o_orderkey > 40 ORDER BY 1 LIMIT 150",
    "first_seen": "SELECT user_id, event_type, min(event_id) AS first_at FROM events GROUP BY 1, 2",
    "ranked_versions": """
WITH r AS (SELECT *, row_number() OVER w AS place, lag(ts) OVER w AS s, count(*) OVER (PARTITION BY event_type) AS n,
           count(*) FILTER (value > 20) OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS had,
           first_value(value > 20) OVER w AS top FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts DESC, event_id DESC))
SELECT event_id, place, epoch_us(s) AS superseded, n, had - CASE WHEN place > 1 AND top THEN 1 ELSE 0 END AS large FROM r""",
    "usage_cluster": """
WITH r AS (SELECT o_custkey AS bucket, count(*) AS objects, sum(round(o_totalprice * 100)::BIGINT)::BIGINT AS logical_bytes FROM orders WHERE o_custkey % 4 <> 1 GROUP BY 1)
SELECT count(*) AS buckets, coalesce(sum(objects), 0)::BIGINT AS objects, coalesce(sum(logical_bytes), 0)::BIGINT AS logical_bytes, coalesce(sum(2 * logical_bytes), 0)::BIGINT AS stored_bytes
FROM customer LEFT JOIN r ON bucket = c_custkey WHERE c_custkey % 3 <> 0""",
    "version_counters": f"""
WITH {_V}, w AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY modified DESC, version DESC) = 1 AS last FROM v)
SELECT key AS bucket, count(*) FILTER (last AND NOT is_marker) AS objects, coalesce(sum(size) FILTER (last AND NOT is_marker), 0)::BIGINT AS logical_bytes,
       count(*) FILTER (NOT last) AS noncurrent_versions, coalesce(sum(size) FILTER (NOT last), 0)::BIGINT AS noncurrent_bytes FROM w GROUP BY 1""",
    "stored_bytes": "SELECT o_orderkey, ((round(o_totalprice * 100)::BIGINT + 3) // 4 * 6 + o_custkey * 3)::BIGINT AS stored FROM orders",
    "stale_uploads": f"WITH {_V} SELECT key, version FROM v WHERE starts_with(key, '3') AND modified + INTERVAL 20 DAY <= TIMESTAMP '{NOW}'",
    "policy_folded": """
SELECT event_id, CASE WHEN user_id::VARCHAR LIKE '%3' OR event_type = 'error' THEN 'Deny' WHEN starts_with(user_id::VARCHAR, '1') OR starts_with(event_type, 'p') THEN 'Allow' ELSE 'ImplicitDeny' END AS decision FROM events""",
    "post_forms": "SELECT event_id, event_type = 'error' AND starts_with(user_id::VARCHAR, '1') AND floor(value) BETWEEN 5 AND 50 AS allowed FROM events",
    "networks": """
SELECT event_id, event_id % 7 BETWEEN 4 AND 7 AS wide, event_id % 7 = 2 AND event_id % 256 BETWEEN 64 AND 127 AS narrow, event_id % 7 = 1 AND event_id % 256 = 1 AND event_id % 199 = 1 AS one FROM events""",
    "stored_filter": "SELECT c_custkey, left(c_name, 3) || '...' AS c_name, c_mktsegment FROM customer WHERE c_mktsegment <> 'BUILDING' AND c_acctbal > 0",
    "access_lines": """
WITH l AS (SELECT user_id, event_id, event_id || ' ' || CASE WHEN event_type = 'view' THEN '-' ELSE event_type END || ' "' || replace(props, '"', '%22') || '"' AS line FROM events),
c AS (SELECT *, sum(strlen(line) + 1) OVER w - (strlen(line) + 1) AS b, row_number() OVER w - 1 AS n FROM l WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, event_id, line, (b // 2000 + n // 40)::INTEGER AS "object" FROM c""",
}
