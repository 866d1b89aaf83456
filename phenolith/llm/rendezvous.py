"""Sharding by rendezvous hashing over weighted shards, in DataFrame functions only.

A key's score for a shard is ``-ln(u) / weight`` with ``u`` uniform from the
MD5 of key and shard name; the smallest score wins, so a shard added takes rows
only into itself and a shard removed gives up only its own.

Positions within a shard come in two levels: rows are numbered inside
(shard, bucket of the row's own hash), and a bucket starts where the counts
before it end.  The table of counts has shards x buckets rows, at most
``COUNTS``, whatever the input; no task holds a whole shard.

Defined results: a null key is a key like any other; a null text counts no
bytes and has the checksum of an empty one; repeated rows are numbered each; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phenolith.llm.runtime import written

COUNTS = 1 << 20
_DIGITS = 13  # hexadecimal, 52 bits: exact in a double


def _score(key: Column, shard: int, weight: float) -> Column:
    h = F.conv(F.substring(F.md5(F.concat(key, F.lit(f"|{shard}")).cast("binary")), 1, _DIGITS), 16, 10).cast("long")
    u = (h.cast("double") + F.lit(0.5)) / F.lit(float(16**_DIGITS))
    return F.struct((-F.log(u) / F.lit(float(weight))).alias("s"), (-h).alias("h"), F.lit(shard).alias("shard"))


def pick(key: Column, weights: Mapping[int, float]) -> Column:
    """The shard that a key belongs to; shards are numbers with a positive weight."""
    if not weights or min(weights.values()) <= 0:
        raise ValueError("shards need positive weights")
    text = F.coalesce(key.cast("string"), F.lit("null"))
    scores = [_score(text, k, w) for k, w in sorted(weights.items())]
    return (F.least(*scores) if len(scores) > 1 else scores[0])["shard"]


def shard(df: DataFrame, weights: Mapping[int, float], *, grown: Mapping[int, float] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, size, text_crc32, law, shard, slot, grown_shard) for each row of ``df``."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = df.select(
        F.col(key).cast("long").alias("doc_id"),
        (F.octet_length(body).cast("long") * F.col(text).isNotNull().cast("long") + 1).alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        pick(F.col(key), weights).alias("shard"),
        (pick(F.col(key), grown) if grown else F.lit(None).cast("int")).alias("grown_shard"),
    )
    digits = max(d for d in range(4) if d == 0 or len(weights) * 16**d <= COUNTS)
    name = F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("size").cast("string"), F.col("text_crc32").cast("string")).cast("binary"))
    rows = written(rows.withColumn("_o", name).withColumn("_b", F.substring("_o", 1, digits)), "shards")
    counts = rows.groupBy("shard", "_b").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    if len(weights) * 16**digits <= COUNTS:
        starts = F.broadcast(starts)
    inside = Window.partitionBy("shard", "_b").orderBy("_o", "doc_id", "size", "text_crc32")
    out = rows.withColumn("_r", F.row_number().over(inside) - 1).join(starts, ["shard", "_b"])
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("_r") + F.col("_start")).cast("long").alias("slot"), "grown_shard")
