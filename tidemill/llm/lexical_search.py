"""Ranked search of documents by the terms of items, from an index of postings.

The index has one row (bucket, term, doc, doc_id, tf, n) for each document and each of its terms, bucket being a hash of
the term. It comes from the scan of the texts without a shuffle. Each file is in order of (bucket, term), so that a search
reads the row groups of its terms; as all postings of a document are in one file, however
frequent a term is, its postings are dealt over all files, and scores of one document add up before they are shuffled.

A search joins the items' terms on (bucket, term), scores each match in whole numbers, adds scores by (item, document)
and numbers the best k of each item by a window. Before the items are brought together, each task drops what its own best k
exceed. Item terms are broadcast if they measure at most ``MAX_BROADCAST`` bytes; else both sides are shuffled by (bucket,
term, salt), a document's hash being the salt of its postings, so that no term's postings meet in one task.

Nulls: a null text has no terms, is not counted and never found; a null item text finds nothing. Null ids are ids of their own. Rows that
repeat, in doc_id or in all, are documents each, and equal scores go by doc_id (null first). Items that repeat in
item_id are one item with all their terms. Very long texts are one document as any other. Only doc_id and text, item_id and text
are read, so other columns may have any name. Empty tables give no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, Scratch, terms

BUCKETS, SALTS, MAX_BROADCAST, PIECE = 256, 16, 8 << 20, 100_000
#: The term of a document's own row, which no text holds.
OWN = ""
#: Bytes of terms with A-Z lower-cased; all others become blanks.
BYTES = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).translate(bytes.maketrans(UPPER.encode(), LOWER.encode()))


@dataclass
class Index:
    """``postings`` (bucket, term, doc, doc_id, tf, n); the number of documents with a term; all their terms, with repeats."""

    postings: DataFrame
    n_docs: int
    n_terms: int


def bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def counted_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, doc_id, term, tf, n) for each term of each text, and one row with the term ``OWN`` for each text that has any; at most ``PIECE`` rows at a time and one text's more.

    Bytes from 0x80 on are parts of characters that belong to terms, so bytes are mapped and split.
    """
    for batch in batches:
        of, names, times, sizes = [], [], [], []
        texts = batch.column("text")
        for k in range(len(texts)):
            found = Counter((texts[k].as_py() or "").encode().translate(BYTES).split())
            if found:
                of.extend(repeat(k, len(found) + 1))
                names.extend(found)
                names.append(b"")
                times.extend(found.values())
                n = sum(found.values())
                times.append(n)
                sizes.extend(repeat(n, len(found) + 1))
            if of and (len(of) >= PIECE or k == len(texts) - 1):
                at = pa.array(of, pa.int64())
                columns = [batch.column("doc").take(at), batch.column("doc_id").take(at), pa.array(names, pa.binary()).cast(pa.string()), pa.array(times, pa.int32()), pa.array(sizes, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, ["doc", "doc_id", "term", "tf", "n"])
                of, names, times, sizes = [], [], [], []


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, bucket, term): each term of an item once."""
    t = items.select("item_id", F.explode(terms(F.col("text"))).alias("term")).distinct()
    return t.select("item_id", bucket(F.col("term")).alias("bucket"), "term")


def meet(postings: DataFrame, by_term: DataFrame, small: bool, how: str = "inner") -> DataFrame:
    """postings joined with a table of terms: a broadcast where that was measured to be small, else by (bucket, term, salt)."""
    if small:
        return postings.join(F.broadcast(by_term), ["bucket", "term"], how)
    salted = by_term.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return postings.withColumn("salt", F.pmod(F.xxhash64("doc"), F.lit(SALTS)).cast("int")).join(salted.hint("merge"), ["bucket", "term", "salt"], how).drop("salt")


def is_small(by_term: DataFrame, most: int | None = None) -> bool:
    """Whether the rows of a table of terms take at most ``most`` bytes in memory, at 64 bytes a row beside its term."""
    return (by_term.agg(F.sum(F.octet_length("term") + 64)).first()[0] or 0) <= (MAX_BROADCAST if most is None else most)


def build_index(docs: DataFrame, wanted: DataFrame | None = None, small: bool = False) -> Index:
    """The index of all documents, written to the shared folder; with ``wanted`` (bucket, term) only the postings of these terms are kept.

    The counts are of all documents and all terms in either case.
    """
    s = Scratch(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("doc"), "doc_id", "text")
    each = rows.mapInArrow(counted_terms, f"doc long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, term string, tf int, n int")
    each = each.withColumn("bucket", bucket(F.col("term")))
    if wanted is not None:
        each = meet(each, wanted.union(docs.sparkSession.range(1).select(bucket(F.lit(OWN)), F.lit(OWN))), small, "left_semi")
    written = s.save(each.select("bucket", "term", "doc", "doc_id", "tf", "n").sortWithinPartitions("bucket", "term"))
    own = F.col("term") == OWN
    n_docs, n_terms = written.where(own).agg(F.count("*"), F.sum("n")).first()
    return Index(written.where(~own), n_docs, n_terms or 0)


def search(index: Index, asked: DataFrame, k: int = 50, small: bool = True) -> DataFrame:
    """(item_id, rank, doc_id, score) of the k best documents of each item of ``asked`` (item_id, bucket, term)."""
    s = Scratch(asked.sparkSession)
    names = asked.select("bucket", "term").distinct()
    df = meet(index.postings.select("bucket", "term", "doc"), names, small).groupBy("bucket", "term").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.log((2.0 * index.n_docs + 2.0) / (2.0 * F.col("df") + 1.0))).cast("long")
    weighted = s.save(asked.join(df, ["bucket", "term"]).select("item_id", "bucket", "term", weight.alias("w")))
    n, tf = F.col("n").cast("long"), F.col("tf").cast("long")
    m = F.lit(50).cast("long") + F.call_function("div", 50 * n * F.lit(index.n_docs), F.lit(max(1, index.n_terms)))
    part = index.postings.withColumn("part", F.call_function("div", F.lit(1_000_000_000).cast("long") * tf, 1000 * tf + 20 * m))
    each = meet(part.select("bucket", "term", "doc", "doc_id", "part"), weighted, small)
    scores = each.groupBy("item_id", "doc", "doc_id").agg(F.sum(F.col("w") * F.col("part")).alias("score")).where("score > 0")
    best = F.row_number().over(Window.partitionBy("item_id").orderBy(F.col("score").desc(), "doc_id", "doc"))
    return scores.withColumn("rank", best).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def lexical_search(docs: DataFrame, items: DataFrame, k: int = 50, most: int | None = None) -> DataFrame:
    """The k best documents of each item. Only the postings of terms that some item has are written."""
    asked = Scratch(docs.sparkSession).save(item_terms(items))
    small = is_small(asked, most)
    return search(build_index(docs, asked.select("bucket", "term").distinct(), small), asked, k, small)
