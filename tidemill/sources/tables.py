"""Table sources and sinks. Paths go through Spark's file systems only."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A CSV with a header; the declared schema saves the pass that inference takes."""
    return spark.read.csv(path, header=True, schema=schema)


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    df.write.mode("overwrite").parquet(path, partitionBy=partition_by)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def with_timestamp(df: DataFrame, column: str = "datetime", form: str | None = None) -> DataFrame:
    """``column`` as a timestamp without zone, parsed by ``form`` where given."""
    c = F.col(column)
    return df.withColumn(column, F.to_timestamp_ntz(c, F.lit(form)) if form else c.cast("timestamp_ntz"))


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


MANIFEST = "_manifest"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def published(spark: SparkSession, path: str) -> str | None:
    """The fingerprint in the manifest of a table that ``publish`` wrote; None for a table without one."""
    p, fs = _fs(spark, f"{path}/{MANIFEST}")
    if not fs.exists(p):
        return None
    with_ = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(with_, "UTF-8")
    finally:
        with_.close()


def publish(df: DataFrame, path: str, fingerprint: str = "") -> None:
    """Writes a table beside ``path``, then its manifest, and puts it there in one rename: a run that dies leaves the old table or none."""
    spark = df.sparkSession
    part = f"{path}.part-{uuid.uuid4().hex}"
    df.write.parquet(part)
    p, fs = _fs(spark, f"{part}/{MANIFEST}")
    out = fs.create(p)
    out.write(bytearray(fingerprint.encode()))
    out.close()
    old, _ = _fs(spark, path)
    fs.delete(old, True)
    if not fs.rename(spark._jvm.org.apache.hadoop.fs.Path(part), old):
        raise OSError(f"{part} could not be renamed to {path}")


def cache_or_compute(spark: SparkSession, path: str, compute: Callable[[], DataFrame], reuse: bool, fingerprint: str = "") -> DataFrame:
    """The table at ``path`` if ``reuse`` and it was published whole with this fingerprint; else computed, published there and read again."""
    if not (reuse and published(spark, path) == fingerprint):
        publish(compute(), path, fingerprint)
    return spark.read.parquet(path)


def fingerprint_of(df: DataFrame) -> str:
    """Rows and a hash of their values that does not depend on their order."""
    r = df.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(*df.columns)).alias("x"), F.sum(F.pmod(F.xxhash64(*df.columns), F.lit(1 << 20))).alias("s")).first()
    return f"{r['n']}:{r['x']}:{r['s']}:{df.schema.simpleString()}"


class Stages:
    """Tables of a run, by name, below one folder. Each has a fingerprint of the run's inputs and settings and of the stages that it names, so a run
    that was cut off goes on after its last whole stage, and another input or setting computes anew."""

    def __init__(self, spark: SparkSession, root: str, fingerprint: str, resume: bool = True):
        self.spark, self.root, self.base, self.resume = spark, root, fingerprint, resume
        self.known: dict[str, str] = {}
        self.computed: list[str] = []

    def table(self, name: str, compute: Callable[[], DataFrame], *after: str) -> DataFrame:
        mark = hashlib.sha256(repr((self.base, name, [self.known[a] for a in after])).encode()).hexdigest()
        self.known[name] = mark

        def noted() -> DataFrame:
            self.computed.append(name)
            return compute()

        return cache_or_compute(self.spark, f"{self.root}/{name}.parquet", noted, self.resume, mark)


def output_dir(root: str, mode: str, window: int, stride: int) -> str:
    return f"{root}/{mode}_W{window}_S{stride}"


def date_axis(spark: SparkSession, start: str | Column, hours: int) -> DataFrame:
    """``hours`` hourly timestamps from ``start``."""
    first = F.lit(start).cast("timestamp_ntz") if isinstance(start, str) else start
    return spark.range(1).select(F.explode(F.sequence(first, first + F.make_interval(hours=F.lit(hours - 1)), F.expr("interval 1 hour"))).alias("datetime"))
