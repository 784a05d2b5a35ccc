"""Shards by jump consistent hashing (Lamping and Veach 2014), and places inside a shard without a sort of the shard.

A document's shard is a function of its doc_id and the number of shards alone: no table of a ring is
kept, and one more shard takes its share from all others while no document moves between those. ``shard_of`` needs no
shuffle. Shares are equal in expectation only (law ``key``); sizes and equal texts are not looked at.

A place (slot) is the rank of a document in its shard by a second hash, so that a shard read in order of
slots is shuffled. Hash prefixes cut each shard into ``BLOCKS`` blocks; counts by block give
the offsets, and only rows of one block are ordered together.

The key is a hash of doc_id as text; null is the empty text. A null text has no bytes and the checksum of none; a very long one is a document as
any other. Rows that repeat in doc_id share a shard; in equal places of the hash order rows go by checksum and size, and those that are equal in
these too are counted first and then numbered one after the other, so that many repeats are one row in the tasks that sort. Other columns may have
any name: ``assign`` reads doc_id and text only, ``with_shard`` returns all columns as they were and one more. Empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

BLOCKS = 1 << 16
#: Fixed value: the multiplier of the generator that the paper gives.
MULTIPLIER = 2862933555777941757


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard, 0 to shards - 1, of each 64-bit key: last jump below ``shards``. Keys that have landed drop out of the loop."""
    state, at = keys.astype(np.uint64), np.zeros(len(keys), np.int64)
    live = np.arange(len(keys))
    while len(live):
        state[live] = state[live] * np.uint64(MULTIPLIER) + np.uint64(1)
        draw = (state[live] >> np.uint64(33)).astype(float) + 1
        ahead = np.floor((at[live] + 1) * (float(1 << 31) / draw)).astype(np.int64)
        inside = ahead < shards
        live = live[inside]
        at[live] = ahead[inside]
    return at


def stable_key(doc_id: Column) -> Column:
    """64 bits of doc_id, as a signed number."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 16), 16, -10).cast("long")


def shard_of(doc_id: Column, shards: int) -> Column:
    """The shard of a document, by its doc_id. Only the key goes to Python, in Arrow batches."""
    if shards < 1:
        raise ValueError("at least one shard")

    @F.pandas_udf("int")
    def of(key: pd.Series) -> pd.Series:
        return pd.Series(jump(key.to_numpy(np.int64).view(np.uint64), shards), dtype="int32")

    return of(stable_key(doc_id))


def with_shard(docs: DataFrame, shards: int, name: str = "shard") -> DataFrame:
    """docs with its shard as one more column, without a shuffle; for ``write.partitionBy(name)``."""
    if name in docs.columns:
        raise ValueError(f"docs has a column {name}")
    return docs.withColumn(name, shard_of(F.col("doc_id"), shards))


def moving(docs: DataFrame, shards: int, more: int = 1) -> DataFrame:
    """The rows of docs that go elsewhere when ``more`` shards are appended: all of them into the new ones."""
    return docs.where(shard_of(F.col("doc_id"), shards) != shard_of(F.col("doc_id"), shards + more))


def assign(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size (bytes of the text and 1), text_crc32, law, shard, slot (from 0 in each shard, without gaps), grown_shard (with one shard more)."""
    s = Scratch(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    order = F.md5(F.concat(F.lit("slot:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), order.alias("place"))
    rows = rows.groupBy("doc_id", "size", "text_crc32", "place").agg(F.count("*").alias("n"))
    rows = rows.withColumns({"shard": shard_of(F.col("doc_id"), shards), "grown_shard": shard_of(F.col("doc_id"), shards + 1), "block": F.conv(F.substring("place", 1, 4), 16, 10).cast("int")})
    rows = s.save(rows)
    blocks = rows.groupBy("shard", "block").agg(F.sum("n").alias("held"))
    earlier = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # at most BLOCKS rows
    offsets = blocks.select("shard", "block", F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("shard", "block").orderBy("place", "doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    numbered = rows.join(offsets, ["shard", "block"]).withColumn("first", F.col("offset") + F.coalesce(F.sum("n").over(inside), F.lit(0)))
    each = numbered.withColumn("slot", F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)))
    return each.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
