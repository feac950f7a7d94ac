"""Micro-batch log delivery: routed, partitioned by destination and event day, rolled by size and count, at least once, idempotent by batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: Bytes and lines after which a destination's object is closed.
ROLL_BYTES, ROLL_LINES = 16 << 20, 100_000


def access_line(*fields: Column, quoted: tuple[int, ...] = ()) -> Column:
    """One log line: fields parted by spaces, - for an absent or empty one; those at the places in `quoted` stand in quotes, their own quotes and breaks made plain."""
    out = []
    for i, f in enumerate(fields):
        text = F.nullif(f.cast("string"), F.lit(""))
        if i in quoted:
            clean = F.replace(F.regexp_replace(text, "[\\r\\n]", " "), F.lit('"'), F.lit("%22"))
            text = F.concat(F.lit('"'), clean, F.lit('"'))
        out.append(F.coalesce(text, F.lit("-")))
    return F.concat_ws(" ", *out)


def routed(events: DataFrame, targets: Column, reads: bool = False, is_read: Column | None = None) -> DataFrame:
    """Each event once for every distinct target it goes to (an array; null ones are left out); reads only where asked for."""
    rows = events if reads or is_read is None else events.filter(~is_read)
    return rows.withColumn("target", F.explode(F.array_distinct(F.filter(targets, lambda x: x.isNotNull()))))


def rolled(df: DataFrame, destination: str, order: Column, line: Column, most_bytes: int = ROLL_BYTES, most_lines: int = ROLL_LINES) -> DataFrame:
    """Adds `object`, the number of the object that a line of its destination goes to: a new one where bytes or lines are full."""
    own = Window.partitionBy(destination).orderBy(order)  # one batch of one destination
    before = F.sum(F.octet_length(line) + 1).over(own) - (F.octet_length(line) + 1)
    by_bytes, by_lines = F.floor(before / most_bytes), F.floor((F.row_number().over(own) - 1) / most_lines)
    return df.withColumn("object", (by_bytes + by_lines).cast("int"))


def deliver(stream: DataFrame, destination: str, day: Column, folder: str, checkpoint: str, line: str = "line", seconds: int | None = None) -> StreamingQuery:
    """Writes each micro-batch under its own folder, by destination and day; a batch that runs again overwrites itself.

    The stream has its lines in the column named by `line`. seconds: the trigger's interval; None takes what is there and ends.
    """

    def batch(df: DataFrame, batch_id: int) -> None:
        rows = df.withColumn("log_date", day)
        rows.repartition(destination, "log_date", F.pmod(F.xxhash64(line), F.lit(16))).write.mode("overwrite").partitionBy(destination, "log_date").parquet(f"{folder}/batch={batch_id}")

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if seconds is None else writer.trigger(processingTime=f"{seconds} seconds")).start()
