"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate as d5
from . import filter_audit as d11
from . import lexical_search as d12
from . import line_dedup as d10
from . import license_scan as d4
from . import mixing as d2
from . import oracles
from . import near_dedup as d3
from . import quality_mil as d9
from . import quality_rules as d1
from . import quote_links as d6
from . import sharding as d13
from . import substring_dedup as d8
from . import warc_fixity as d7
from .common import Scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = d1.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = d2.mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken", "copies", F.round("expected", 9).alias("expected"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d3.near_duplicates(table(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d4.license_scan(table(spark, sf_dir, "documents"))


def op6_quote_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links the mails that ``mailbox`` makes of all conversations, which hold no quotes of their own."""
    out = d6.quote_links(d6.mailbox(table(spark, sf_dir, "conversations")))
    return out.select("conv_id", "turn", "role", "n_quoted", "max_level", "n_linked", "parent_turn", "thread_turn", "depth", "reply_pos", F.sha2("own_text", 256).alias("own_sha256"))


def op7_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audits a replica of all pages in which a hash of page_id marks records that are flipped, zeroed or lost."""
    s, pages = Scratch(spark), table(spark, sf_dir, "pages")
    pages = pages.withColumn("r", d7.record_bytes(F.col("url"), F.col("html")))
    mark = F.conv(F.substring(F.md5(F.coalesce(F.col("page_id").cast("string"), F.lit(""))), 1, 8), 16, 10).cast("bigint")
    flipped, zeroed = F.expr("substring(r, 1, 40) || unhex('FF') || substring(r, 42)"), F.expr("cast(repeat('0', length(r)) as binary)")
    held = F.when(mark % 211 == 0, None).when(mark % 97 == 0, flipped).when(mark % 89 == 0, zeroed).otherwise(F.col("r"))
    rows = d7.archive(pages, s, {"a": F.col("r"), "b": held})
    a, b = (rows.where(f"digest_{x} is not null").select("pos", "offset", "length", F.col(f"digest_{x}").alias("digest")) for x in "ab")
    _, bad, _ = d7.audit(a, b, s)
    return rows.join(bad, "pos", "left").select("page_id", "length", F.col("digest_a").alias("digest"), F.coalesce("status", F.lit("ok")).alias("status"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d8.repeated_passages(table(spark, sf_dir, "documents"))


def op9_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d9.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = d5.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = d10.line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("_n_removed").cast("long").alias("n_removed_chunks"), F.col("_lines_removed").cast("long").alias("n_removed_lines"), F.sha2("text", 256).alias("clean_sha256"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d11.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d12.lexical_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d13.assign(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_mixing, op3_near_dedup, op4_license_scan, op5_decontaminate, op6_quote_links, op7_warc_fixity, op8_substring_dedup, op9_quality_mil, op10_line_dedup, op11_filter_audit, op12_lexical_search, op13_sharding)}
ORACLES = oracles.ORACLES
