"""Replay of a table's transaction log into its live files and its metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ACTIONS = "add struct<path:string,partitionValues:map<string,string>,size:long,modificationTime:long,stats:string>, remove struct<path:string,deletionTimestamp:long>, metaData struct<id:string,name:string,format:struct<provider:string>,schemaString:string,partitionColumns:array<string>>, protocol struct<minReaderVersion:int,minWriterVersion:int>"


def read_actions(spark: SparkSession, table: str) -> DataFrame:
    """version, position (line of the commit) and action columns of all commits of a table folder; actions of other kinds have only nulls.

    A log with a checkpoint, or one that lacks a commit, is refused: its replay would not be whole.
    """
    files = spark.read.format("binaryFile").load(f"{table}/_delta_log").select("path")
    if not files.filter(F.col("path").rlike(r"checkpoint[^/]*\.parquet$")).isEmpty():
        raise ValueError("the log has a checkpoint")
    raw = spark.read.text(f"{table}/_delta_log", wholetext=True, pathGlobFilter="*.json").withColumn("version", F.regexp_extract(F.col("_metadata.file_name"), r"^(\d+)\.json$", 1).try_cast("long"))
    raw = raw.filter(F.col("version").isNotNull())
    n, least, most = raw.agg(F.count("*"), F.min("version"), F.max("version")).first()
    if n and (least != 0 or n != most + 1):
        raise ValueError("the log lacks a commit")
    lines = raw.select("version", F.posexplode(F.split("value", "\n")).alias("position", "line")).filter(F.trim("line") != "")
    return lines.select("version", "position", F.from_json("line", ACTIONS).alias("x")).select("version", "position", "x.*")


def live(actions: DataFrame, path: Column, version: Column, is_add: Column, size: Column, position: Column | None = None) -> DataFrame:
    """path, version, size of files whose last action, by version and place in its commit, adds them.

    Last-wins is one combining aggregate per path: no window, no sort.
    """
    place = F.lit(0) if position is None else position
    rows = actions.select(path.alias("path"), F.struct(version.alias("version"), place.alias("position"), is_add.alias("is_add"), size.alias("size")).alias("act")).filter(F.col("path").isNotNull())
    last = rows.groupBy("path").agg(F.max("act").alias("act")).filter("act.is_add")
    return last.select("path", "act.version", "act.size")


def snapshot(spark: SparkSession, table: str, version: int | None = None) -> DataFrame:
    """The live files of a table, of its latest or of an earlier version, with all that their add action says."""
    actions = read_actions(spark, table)
    if version is not None:
        actions = actions.filter(F.col("version") <= version)
    rows = actions.select(F.coalesce("add.path", "remove.path").alias("path"), F.struct("version", "position", F.col("add").isNotNull().alias("is_add"), "add").alias("act"))
    # max of a struct can't compare maps: the place alone is compared
    last = rows.filter("path IS NOT NULL").groupBy("path").agg(F.max_by("act", F.struct("act.version", "act.position")).alias("act")).filter("act.is_add")
    return last.select("path", "act.version", F.coalesce("act.add.size", F.lit(0).cast("long")).alias("size"), F.col("act.add.partitionValues").alias("partition_values"), "act.add.stats", F.col("act.add.modificationTime").alias("modified"))


def metadata(spark: SparkSession, table: str, version: int | None = None) -> DataFrame:
    """One row: version, the last protocol and metadata, the number and bytes of live files."""
    actions = read_actions(spark, table)
    if version is not None:
        actions = actions.filter(F.col("version") <= version)
    place = F.struct("version", "position")
    head = actions.agg(F.max("version").alias("version"), *(F.max_by(k, F.when(F.col(k).isNotNull(), place)).alias(k) for k in ("protocol", "metaData")))
    size = snapshot(spark, table, version).agg(F.count("*").alias("num_files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))
    return head.join(size, F.lit(True))


def sharing_lines(files: DataFrame, url: Column) -> DataFrame:
    """A JSON line for each file: its id is the digest of its path; partition values that are null are left out."""
    values = F.map_filter(F.coalesce("partition_values", F.create_map().cast("map<string,string>")), lambda _, v: v.isNotNull())
    body = F.struct(url.alias("url"), F.sha2("path", 256).alias("id"), values.alias("partitionValues"), "size", "stats")
    return files.select(F.to_json(F.struct(body.alias("file"))).alias("line"))
