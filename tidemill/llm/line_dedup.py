"""Line dedup over content-defined chunks of lines.

A text is split at "\\n". Each line has an MD5 hash; the rolling hash at a line is the
hash of its predecessor's and its own hash, and a chunk ends where its last 32 bits are
0 modulo ``1 << mask_bits``. Boundaries thus depend on content near them only and
come back in step after inserted or deleted lines. Boundaries keep
``min_lines`` lines between them: in a run of boundaries that stand closer than that,
the first counts and the next one that is far enough from it, and the last chunk takes
in a rest that is too short. A chunk of ``min_lines`` lines
or more that holds ``min_chars`` characters is a candidate. Chunks are grouped by
their very bytes (the grouping key is the hash and the text), so equal hashes
alone never remove anything. Of each group the first chunk stays, by doc_id (null
last), place and text; all others are removed, together with the "\\n" after them.

Nulls: a null text has no chunk and stays null; an empty text is one empty line and
stays. Rows that repeat doc_id and text: the first chunk is kept in each of them,
as nothing tells them apart. Repeats inside one text count like those across
texts. A very long text is cut like any other. Columns beside doc_id and text may have any
name and come back as they were. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, beside, fresh, let, own

MASK_BITS, MIN_LINES, MIN_CHARS = 1, 2, 40


def spaced(marks: Column, n: Column, least: int) -> Column:
    """The marks (line numbers in order) that end a chunk of ``least`` lines or more, then the last line of n.

    Marks closer than ``least`` to the one before form a run; a run is cut from its own start, so the choice depends on near content only.
    """
    far = lambda x, y: x - y >= least
    start = F.struct(F.array().cast("array<int>").alias("ends"), F.lit(-1).alias("mark"), F.lit(-1).alias("end"))

    def step(s: Column, x: Column) -> Column:
        taken = (far(x, s["mark"]) | far(x, s["end"])) & (x < n - least)
        return F.struct(F.when(taken, F.concat(s["ends"], F.array(x))).otherwise(s["ends"]).alias("ends"), x.alias("mark"), F.when(taken, x).otherwise(s["end"]).alias("end"))

    return F.aggregate(marks, start, step, lambda s: F.concat(s["ends"], F.array(n - 1)))


def chunks(text: Column, mask_bits: int = MASK_BITS, least: int = 1) -> Column:
    """Array of (start, n, text): the content-defined chunks of a text, in order; they cover its lines. A text of ``least`` lines or more has no shorter chunk."""

    def cut(lines: Column) -> Column:
        def by_hash(h: Column) -> Column:
            rolled = lambda i: F.md5(F.concat(F.get(h, i - 1), F.get(h, i)))
            low = lambda i: F.conv(F.substring(rolled(i), 25, 8), 16, 10).cast("bigint")
            ends = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: ((i > 0) & (low(i) % (1 << mask_bits) == 0)) | (i == F.size(lines) - 1))
            if least > 1:
                ends = spaced(F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: (i > 0) & (low(i) % (1 << mask_bits) == 0)), F.size(lines), least)
            pieces = lambda e: F.transform(e, lambda x, k: F.struct(F.coalesce(F.get(e, k - 1) + 1, F.lit(0)).alias("start"), (x - F.coalesce(F.get(e, k - 1), F.lit(-1))).alias("n")))
            return let(ends, pieces)

        spans = let(F.transform(lines, F.md5), by_hash)
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["n"].alias("n"), F.array_join(F.transform(F.sequence(s["start"], s["start"] + s["n"] - 1), lambda i: F.get(lines, i)), "\n").alias("text")))

    return let(F.split(text, "\n", -1), cut)


def repeated_chunks(docs: DataFrame, mask_bits: int, min_lines: int, min_chars: int, least: int = 1) -> DataFrame:
    """One row per chunk text that occurs twice or more: ``h`` (16 bytes) and its first place (doc_id, start, key)."""
    key = F.unhex(F.md5("text"))
    each = docs.where("text is not null").select("doc_id", key.alias("key"), F.inline(chunks(F.col("text"), mask_bits, least)).alias("start", "n", "chunk"))
    each = each.where((F.col("n") >= min_lines) & (F.length("chunk") >= min_chars))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "start")
    grouped = each.groupBy(F.unhex(F.md5("chunk")).alias("h"), F.col("chunk")).agg(F.count("*").alias("n"), F.min(place).alias("first"))
    # two texts with one hash: neither is told apart by the hash later, so both stay
    return grouped.groupBy("h").agg(F.count("*").alias("texts"), F.sum("n").alias("n"), F.min("first").alias("first")).where("texts = 1 and n > 1").select("h", "first")


def line_dedup(docs: DataFrame, mask_bits: int = MASK_BITS, min_lines: int = MIN_LINES, min_chars: int = MIN_CHARS, made: tuple[str, str] = ("_n_removed", "_lines_removed")) -> DataFrame:
    """All rows and columns of docs with the cleaned ``text``, and in columns named ``made`` the numbers of chunks and lines that were removed.

    Where docs has one of these names, its column comes back as it was, and the new one is named ``new`` and that name.
    """
    least = min_lines
    d, k, removed, n_lines, rest = fresh("d", "k", "removed", "lines", "rest")
    s = Scratch(docs.sparkSession)
    again = s.save(repeated_chunks(docs, mask_bits, min_lines, min_chars, least))
    key = F.unhex(F.md5("text"))
    places = docs.where("text is not null").select("doc_id", key.alias("key"), F.inline(chunks(F.col("text"), mask_bits, least)).alias("start", "n", "chunk"))
    places = places.where((F.col("n") >= min_lines) & (F.length("chunk") >= min_chars)).select("doc_id", "key", "start", "n", F.unhex(F.md5("chunk")).alias("h"))
    f = F.col("first")
    is_first = f["doc_id"].eqNullSafe(F.col("doc_id")) & (f["key"] == F.col("key")) & (f["start"] == F.col("start"))
    gone = places.join(again, "h").where(~is_first).select("doc_id", "key", "start", "n").distinct()
    gone = gone.groupBy(F.col("doc_id").alias(d), F.col("key").alias(k)).agg(F.collect_set("start").alias(removed), F.sum("n").alias(n_lines))
    gone = s.save(gone)
    # the list of removed chunks grows with the data, so it is merged and never broadcast: one plan at every size
    joined = docs.join(gone.hint("merge"), F.col("doc_id").eqNullSafe(F.col(d)) & (F.unhex(F.md5("text")) == F.col(k)), "left")
    kept = let(chunks(F.col("text"), mask_bits, least), lambda c: F.struct(F.size(c).alias("n"), F.array_join(F.transform(F.filter(c, lambda x: ~F.array_contains(F.col(removed), x["start"])), lambda x: x["text"]), "\n").alias("text")))
    joined = joined.withColumn(rest, F.when(F.col(removed).isNotNull(), kept))
    joined = joined.withColumn("text", F.coalesce(F.col(rest)["text"], "text"))
    chunks_name, lines_name = beside(docs, made, "new")
    return joined.select(*own(docs), F.coalesce(F.size(F.when(F.col(removed).isNotNull(), F.col(removed))), F.lit(0)).alias(chunks_name), F.coalesce(n_lines, F.lit(0)).alias(lines_name))


def without_repeated_lines(docs: DataFrame) -> DataFrame:
    """docs with cleaned texts; rows that had a word and lost every line to earlier copies go."""
    had, *made = fresh("had", "chunks", "lines")
    filled = F.length(F.trim(F.coalesce("text", F.lit("")))) > 0
    out = line_dedup(docs.withColumn(had, filled), made=tuple(made))
    return out.where(filled | ~F.col(had)).select(*own(docs))
