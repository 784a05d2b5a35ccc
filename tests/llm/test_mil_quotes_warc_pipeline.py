import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.conftest import SF
from tidemill.llm import queries, quality_mil, quote_links, warc_fixity
from tidemill.llm.common import Scratch


def test_gradient_matches_differences():
    g = np.random.default_rng(0)
    m, sizes, y = quality_mil.Model(), np.array([2, 1, 4]), np.array([1.0, 0.0, 1.0])
    x, starts = g.normal(size=(7, len(quality_mil.MEASURES))), np.array([0, 2, 3])

    def loss():
        p = m._forward(x, starts, sizes)["y"]
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    grad = m._gradient(m._forward(x, starts, sizes), y, starts)
    for name, d in grad.items():
        flat, at = m.p[name].ravel(), 0
        flat[at] += 1e-6
        up = loss()
        flat[at] -= 2e-6
        down = loss()
        flat[at] += 1e-6
        assert abs((up - down) / 2e-6 - d.ravel()[at]) < 1e-6, name


def test_held_out_accuracy(spark):
    out = queries.op9_quality_mil(spark, SF.replace("0.001", "0.01"))
    labels = spark.read.parquet(SF.replace("0.001", "0.01") + "/labels.parquet")
    rows = out.where("held_out").join(labels, "doc_id").collect()
    assert len(rows) > 40 and sum(r.predicted == r.quality for r in rows) >= 0.95 * len(rows)


def test_classifier_edges(spark, docs_of):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = quality_mil.classify(docs_of([(1, None), (None, ""), (2, "a " * 30000), (2, "x")]), empty).collect()
    assert [r.score for r in rows] == [0.5] * 4 and all(r.predicted == 1 for r in rows) and sum(r.held_out for r in rows) >= 0
    assert quality_mil.classify(docs_of([]), empty).count() == 0
    assert quality_mil.keep_good(docs_of([(1, "a")]), empty).columns == docs_of([]).columns


def test_quotes_are_linked(spark):
    m = [
        (1, 0, "the first message says this at length\nand a second line of it"),
        (1, 1, "On Monday, A wrote:\n> the first message  says THIS at length\nI agree with that message of yours"),
        (1, 2, "> I agree with that message of yours\n> > the first message says this at length\nmy own words here"),
        (1, 3, "no quotes in this one at all"),
        (1, 4, "> nobody ever wrote these words\nmy own words here"),
        (2, 5, "> the first message says this at length\nother conversation"),
        (None, 1, "> the first message says this at length"), (1, None, "> the first message says this at length"), (3, 0, None), (3, 1, ""),
    ]
    out = {(r.conv_id, r.turn): r for r in quote_links.quote_links(spark.createDataFrame([(*x, 9) for x in m], "conv_id long, turn long, text string, depth int")).collect()}
    assert len(out) == len(m)
    got = {k: (v.parent_turn, v.thread_turn, v.depth) for k, v in out.items()}
    assert got[1, 1] == (0, 0, 1) and got[1, 2] == (1, 0, 2) and got[1, 3] == (None, 3, 0) and got[1, 4] == (None, 4, 0) and got[2, 5] == (None, 5, 0)
    assert out[1, 1].own_text == "I agree with that message of yours" and out[1, 2].max_level == 2 and out[1, 2].n_quoted == 2 and out[1, 2].n_linked == 2
    assert out[3, 0].own_text == "" and out[None, 1].parent_turn is None
    assert quote_links.quote_links(spark.createDataFrame([], "conv_id long, turn long, text string")).count() == 0


def test_long_reply_chain(spark):
    m = [(7, i, f"> this is the line of message number {i - 1}\nthis is the line of message number {i}") for i in range(40)]
    out = {r.turn: r for r in quote_links.quote_links(spark.createDataFrame(m, "conv_id long, turn long, text string")).collect()}
    assert all(out[i].depth == i and out[i].thread_turn == 0 for i in range(40))


def test_quotes_wrapped_anew_short_partial_and_repeated(spark):
    m = [
        (1, 0, "Yes.\nAgreed"), (1, 1, "one two three four five six seven eight\nnine ten eleven twelve thirteen"),
        (1, 2, "B wrote:\n> YES. agreed\nfine"), (1, 3, "> one two three four\n> five six seven eight nine ten\n>  eleven twelve thirteen\n> > yes. Agreed"),
        (1, 4, "> nine ten eleven twelve thirteen\nonly a part"), (1, 5, "> yes.\ntoo short a part"), (1, 5, "Yes.\nagreed"), (1, 6, "> Yes. agreed\n\nboth said so, the first counts"),
        (1, 7, "x" * 300_000), (1, 8, "> " + "x" * 300_000),
    ]
    out = [(r.turn, r.parent_turn, r.n_linked, r.thread_turn, r.depth, r.reply_pos) for r in quote_links.quote_links(spark.createDataFrame(m, "conv_id long, turn int, text string")).orderBy("turn").collect()]
    assert out == [(0, None, 0, 0, 0, 0), (1, None, 0, 1, 0, 0), (2, 0, 1, 0, 1, 1), (3, 1, 2, 1, 1, 1), (4, 1, 1, 1, 1, 2), (5, None, 0, 5, 0, 0), (5, None, 0, 5, 0, 0), (6, 0, 1, 0, 1, 2), (7, None, 0, 7, 0, 0), (8, 7, 1, 7, 1, 1)]


def test_reply_order_equals_a_walk_of_the_trees(spark):
    g = np.random.default_rng(11)
    rows = [(0, t, t - 1) for t in range(1, 400)] + [(1, t, 0) for t in range(1, 300)]  # a chain and a star
    rows += [(k, t, int(g.integers(max(0, t - 9), t))) for k in range(2, 12) for t in range(1, 60) if g.random() < 0.8]
    got = {(r.c, r.t): (r.top, r.depth, r.pos) for r in quote_links.reply_order(spark.createDataFrame(rows, "c long, t long, parent long"), Scratch(spark)).collect()}
    kids, want = {}, {}
    for c, t, parent in rows:
        kids.setdefault((c, parent), []).append(t)
    for c, top in set(kids) - {(c, t) for c, t, _ in rows}:
        stack, n = [(top, 0)], 0
        while stack:
            t, depth = stack.pop()
            want[c, t] = (top, depth, n)
            n += 1
            stack += [(x, depth + 1) for x in sorted(kids.get((c, t), []), reverse=True)]
    assert got == want


def test_mailbox_links_most_messages(spark):
    out = queries.op6_quote_links(spark, SF).collect()
    later = [r for r in out if r.turn > 0]
    assert sum(r.n_linked > 0 for r in later) > 0.6 * len(later) and max(r.depth for r in out) > 1 and all(r.n_quoted == r.n_linked for r in out)


def test_audit_finds_the_damage(spark):
    n = 9000
    good = spark.range(n).select(F.col("id").alias("pos"), (F.col("id") * 10).alias("offset"), F.lit(10).cast("long").alias("length"), F.sha2(F.col("id").cast("string"), 256).alias("digest"))
    bad = good.where("id is null" if False else "pos not in (77, 8999)").withColumn("digest", F.when(F.col("pos").isin(5, 4096, 8000), F.sha2(F.lit("x"), 256)).otherwise(F.col("digest")))
    bad = bad.union(good.where("pos = 3").withColumn("pos", F.lit(n + 50).cast("long")))
    same, found, compared = warc_fixity.audit(good, bad, Scratch(spark))
    assert not same and {(r.pos, r.status) for r in found.collect()} == {(77, "missing"), (8999, "missing"), (5, "corrupt"), (4096, "corrupt"), (8000, "corrupt"), (n + 50, "extra")}
    assert sum(compared) < 400  # only mismatching branches are opened
    same, found, compared = warc_fixity.audit(good, good, Scratch(spark))
    assert same and found.count() == 0 and compared == [1]
    assert warc_fixity.audit(good.limit(0), good.limit(0), Scratch(spark))[0]


def test_warc_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/é", "<p>ü</p>"), (2, None, None), (2, "http://b", "x\r\n\r\ny")], "page_id long, url string, html string")
    records = [bytes(r[0]) for r in pages.select(warc_fixity.record_bytes(F.col("url"), F.col("html"))).collect()]
    (tmp_path / "a.warc").write_bytes(b"".join(records))
    got = warc_fixity.read_warc(spark, f"file://{tmp_path}").orderBy("offset").collect()
    assert [bytes(r.record) for r in got] == records and [r.offset for r in got] == [0, len(records[0]), len(records[0]) + len(records[1])]


def test_fixity_query_equals_direct_digests(spark):
    out = queries.op7_warc_fixity(spark, SF)
    assert out.where("status = 'ok'").count() < out.count() == spark.read.parquet(f"{SF}/pages.parquet").count()


def test_pipeline_stages(spark):
    docs, sizes = spark.read.parquet(f"{SF}/documents.parquet"), []
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = Scratch(spark).save(stage(spark, docs, SF))
        sizes.append(docs.count())
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 100
    assert {"copies", "taken"} <= set(docs.columns)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(spark, name):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "labels", "benchmark", "pages", "conversations"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    r = c.execute(queries.ORACLES[name])
    cols = [x[0] for x in r.description]
    assert sorted(map(str, (tuple(x) for x in queries.QUERIES[name](spark, SF).select(*cols).collect()))) == sorted(map(str, r.fetchall()))
    assert hashlib.sha256(b"").hexdigest()
