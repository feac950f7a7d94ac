"""Regular-expression search over the lines of texts, with byte offsets and caps.

One pass over a text's lines keeps the byte position and the hits so far, so the work grows with the text and only
matching lines are exploded: no shuffle, no Python. Hits gather in blocks, since each append copies what it appends to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hits of a text in a block.
BLOCK = 256


def _cut(line: Column, most: int) -> Column:
    """At most `most` bytes of a line, cut back to a character's end."""
    raw = line.cast("binary")
    shorter = [F.try_validate_utf8(F.substring(raw, 1, max(most - k, 0)).cast("string")) for k in range(4)]
    return F.when(F.octet_length(line) <= most, line).otherwise(F.coalesce(*shorter))


def grep(
    df: DataFrame,
    key: str,
    text: str,
    pattern: str,
    *,
    literal: bool = False,
    case_insensitive: bool = False,
    invert: bool = False,
    max_matches: int | None = 1000,
    content_max_bytes: int | None = 8192,
) -> DataFrame:
    """One row for each matching line of each text, its first match, offsets in bytes from the text's start.

    max_matches caps the lines of one text; `capped` says that the cap was reached, even if nothing follows. None for it
    returns every line, None for content_max_bytes every line whole. A null text has no lines; a newline at the end opens
    no further line. Lines that are not UTF-8 count but never match.
    """
    rule = ("(?i)" if case_insensitive else "") + ("\\Q" + pattern.replace("\\E", "\\E\\\\E\\Q") + "\\E" if literal else pattern)
    whole = F.col(text)
    size = F.octet_length(whole)
    body = F.when(whole.endswith("\n"), F.expr(f"left(`{text}`, char_length(`{text}`) - 1)")).otherwise(whole)

    def tried(line: Column) -> Column:
        found = F.rtrim(line, F.lit("\r")).rlike(rule)
        return F.struct(line.alias("line"), (F.is_valid_utf8(line) & (~found if invert else found)).alias("hit"))

    def step(acc: Column, one: Column) -> Column:
        line, hit = one["line"], one["hit"]
        if max_matches is not None:
            hit = hit & (F.size(acc["full"]) * BLOCK + F.size(acc["hits"]) < max_matches)
        n, after = acc["n"] + 1, acc["pos"] + F.octet_length(line) + 1
        # a line's end counts where there is one
        own = F.struct(n.alias("line_number"), acc["pos"].alias("offset"), (F.least(after, size.cast("long")) - acc["pos"]).cast("int").alias("line_length"), line.alias("line"))
        last = hit & (F.size(acc["hits"]) == BLOCK - 1)
        full = F.when(last, F.array_append(acc["full"], F.array_append(acc["hits"], own))).otherwise(acc["full"])
        return F.struct(n.alias("n"), after.alias("pos"), full.alias("full"), F.when(last, none).when(hit, F.array_append(acc["hits"], own)).otherwise(acc["hits"]).alias("hits"))

    kind = "array<struct<line_number:int,offset:bigint,line_length:int,line:string>>"
    none = F.array().cast(kind)
    start = F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("pos"), F.array().cast(f"array<{kind}>").alias("full"), none.alias("hits"))
    found = F.aggregate(F.transform(F.split(body, "\n", -1), tried), start, step, lambda acc: F.flatten(F.array_append(acc["full"], acc["hits"])))
    hits = df.filter(whole.isNotNull() & (whole != "")).select(key, found.alias("_hits"))
    capped = F.lit(False) if max_matches is None else F.size("_hits") >= max_matches
    rows = hits.select(key, capped.alias("capped"), F.explode("_hits").alias("_hit")).select(key, "capped", "_hit.*")
    line = F.rtrim(F.col("line"), F.lit("\r"))
    at = F.lit(0) if invert else F.octet_length(F.substr(line, F.lit(1), F.regexp_instr(line, F.lit(rule), 0) - 1))
    length = F.lit(0) if invert else F.octet_length(F.regexp_substr(line, F.lit(rule)))
    return rows.select(
        key, "line_number", "offset", "line_length", (F.col("offset") + at).alias("match_offset"), length.alias("match_length"),
        (line if content_max_bytes is None else _cut(line, content_max_bytes)).alias("content"),
        (F.lit(False) if content_max_bytes is None else F.octet_length(line) > content_max_bytes).alias("truncated"), "capped",
    )


def grep_prefix(df: DataFrame, key: str, text: str, pattern: str, *, prefix: str = "", start_after: str | None = None, max_keys: int = 100, max_matches: int = 1000, max_matches_per_object: int = 100, **options) -> DataFrame:
    """grep() over the first max_keys keys under a prefix, in key order, max_matches lines in all; start_after is the last key of the page before.

    The page of keys is a bounded top-k and its texts come by a broadcast of those keys.
    """
    keys = df.select(key).filter(F.col(key).startswith(prefix))
    if start_after is not None:
        keys = keys.filter(F.col(key) > start_after)
    page = keys.distinct().orderBy(key).limit(max_keys)
    found = grep(df.join(F.broadcast(page), key), key, text, pattern, max_matches=max_matches_per_object, **options)
    return found.orderBy(key, "line_number").limit(max_matches)
