"""Merkle fixity audit of WARC archives.

A replica is a table of leaves, one per record: ``pos`` (its place over all files),
``file`` (pos >> 12: files hold up to 4096 records), ``offset``, ``length`` and
``digest``, the SHA-256 of the record's bytes. A node covers 16 neighbours, and so an
ordered range of offsets; its digest is the SHA-256 of its children's ranges and
digests in order. Three levels give a file's root; above, 256 nodes meet in one, up to
the replica's root. Every group has a fixed bound. The audit compares roots, then
from level to level only the children of nodes that differ, and names the leaves.

Records that one replica lacks differ, too ("missing", "extra"). Leaves that share a
pos within a replica are one leaf with both digests. Nulls: a page with a null html
has an empty body; a null url gives an empty target; null page_ids come first in order.
Repeated pages are records of their own. Empty replicas have no root and agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch

FILE_BITS, NODE_BITS, TOP_BITS = 12, 4, 8


def record_bytes(url: Column, body: Column) -> Column:
    """A WARC/1.1 resource record of a page, as bytes."""
    body = F.encode(F.coalesce(body, F.lit("")), "utf-8")
    head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(F.encode(head, "utf-8"), body, F.encode(F.lit("\r\n\r\n"), "utf-8"))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(file, offset, length, record) of the records of uncompressed WARC files below path."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, data in zip(batch["path"], batch["content"], strict=True):
                rows, at = [], 0
                while (head := data.find(b"\r\n\r\n", at)) >= 0:
                    size = next((int(x.split(b":")[1]) for x in data[at:head].split(b"\r\n") if x.lower().startswith(b"content-length:")), 0)
                    end = min(len(data), head + 4 + size + 4)
                    rows.append((name, at, end - at, bytes(data[at:end])))
                    at = end
                if at < len(data):  # a torn last record
                    rows.append((name, at, len(data) - at, bytes(data[at:])))
                yield pd.DataFrame(rows, columns=["file", "offset", "length", "record"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(split, "file string, offset long, length long, record binary")


def archive(pages: DataFrame, scratch: Scratch, copies: dict[str, Column]) -> DataFrame:
    """Lays pages out as records of files, in order of page_id, url and digest; a written table.

    ``copies`` maps a replica's name to the bytes it holds of a page's record (null: none).
    Only lengths and digests are sorted and kept; ``pos`` numbers rows in order within
    range partitions, so that no task sees all rows.
    """
    digests = [F.sha2(c, 256).alias(f"digest_{name}") for name, c in copies.items()]
    record = record_bytes(F.col("url"), F.col("html"))
    rows = pages.select("page_id", "url", F.octet_length(record).cast("long").alias("length"), F.sha2(record, 256).alias("_order"), *digests)
    key = ["page_id", "url", "_order"]
    placed = scratch.save(rows.repartitionByRange(*key).sortWithinPartitions(*key).drop("_order").withColumn("pos", F.monotonically_increasing_id()))
    file = F.shiftright("pos", FILE_BITS).alias("file")
    before = Window.partitionBy("file").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)  # 4096 rows at most
    return placed.withColumn("file", file).withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))


def tree(leaves: DataFrame, scratch: Scratch, last: int) -> list[DataFrame]:
    """Levels of written nodes (id, lo, hi, digest) from the leaves up to the root over places 0 to ``last``.

    Ids of level L are leaf places shifted right, so a parent's id follows from a child's.
    """
    nodes = leaves.groupBy(F.col("pos").alias("id")).agg(F.min("offset").alias("lo"), F.max(F.col("offset") + F.col("length")).alias("hi"), F.array_join(F.sort_array(F.collect_set("digest")), "+").alias("digest"))
    levels, shift = [scratch.save(nodes)], 0
    while shift < FILE_BITS or last >> shift:
        bits = NODE_BITS if shift < FILE_BITS else TOP_BITS
        shift += bits
        child = F.concat_ws(":", "id", "lo", "hi", "digest")
        up = levels[-1].groupBy(F.shiftright("id", bits).alias("up")).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sha2(F.array_join(F.sort_array(F.collect_list(child)), "\n"), 256).alias("digest"))
        levels.append(scratch.save(up.withColumnRenamed("up", "id")))
    return levels


def audit(a: DataFrame, b: DataFrame, scratch: Scratch) -> tuple[bool, DataFrame, list[int]]:
    """Whether the roots agree; (pos, status) of leaves that differ; how many nodes were compared on each level."""
    last = a.select("pos").union(b.select("pos")).agg(F.max("pos")).first()[0] or 0
    left, right = tree(a, scratch, last), tree(b, scratch, last)
    open_, compared = None, []
    for k in reversed(range(len(left))):
        x, y = left[k], right[k]
        if open_ is not None:
            bits = NODE_BITS if k * NODE_BITS < FILE_BITS else TOP_BITS
            x, y = (t.withColumn("up", F.shiftright("id", bits)).join(open_, "up", "left_semi") for t in (x, y))
        both = x.select("id", F.struct("lo", "hi", "digest").alias("x")).join(y.select("id", F.struct("lo", "hi", "digest").alias("y")), "id", "full")
        both = scratch.save(both.select("id", F.when(F.col("y").isNull(), "missing").when(F.col("x").isNull(), "extra").when(F.col("x") != F.col("y"), "corrupt").otherwise("ok").alias("status")))
        compared.append(both.count())
        bad = both.where("status != 'ok'")
        if bad.isEmpty():
            return True, bad.withColumnRenamed("id", "pos"), compared
        open_ = bad.select(F.col("id").alias("up"))
    return False, bad.withColumnRenamed("id", "pos"), compared
