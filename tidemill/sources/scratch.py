"""Tables of one call in the shared folder.

A round of an iteration, or a table that is read more than once, is written and
read again: a lost executor costs the running tasks only, and no plan or lineage grows
over rounds.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset, one in the warehouse.

    A warehouse on a local disk is each machine's own, so on a cluster it is refused.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/scratch"
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).getScheme() == "file" and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return folder


#: Spark's setting by which a query's shuffle files go when it ends, not when the driver happens to collect its garbage.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Written tables, each in a folder of its own. ``clean``: the shuffle files of a written table go as soon as it is there."""

    def __init__(self, spark: SparkSession, clean: bool = False):
        self.spark, self.clean = spark, clean
        self.root = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
        self.n = 0

    def save(self, df: DataFrame) -> DataFrame:
        """Writes ``df`` once and returns the written table."""
        self.n += 1
        path = f"{self.root}/{self.n}"
        before = self.spark.conf.get(CLEAN, None)
        if self.clean:
            self.spark.conf.set(CLEAN, "true")
        try:
            df.write.parquet(path)
        finally:
            if self.clean:
                self.spark.conf.unset(CLEAN) if before is None else self.spark.conf.set(CLEAN, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that nothing reads any more."""
        for t in tables:
            p = self.spark._jvm.org.apache.hadoop.fs.Path(t.path)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
