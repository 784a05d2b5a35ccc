"""Every stage on nulls, empty texts, repeated rows, a very long text, empty tables, and columns with names that a stage might use inside."""

import pytest

import corpus_pipeline

NAMES = ["__key", "__d", "__k", "__comp", "__score", "_d", "_k", "__gone", "__kept", "__had", "_n_removed", "_lines_removed", "copies", "taken", "size", "target", "source_size", "node", "comp", "h", "n", "rank", "odd name"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in NAMES)


@pytest.fixture
def tables(spark, words, tmp_path):
    long = "\n".join(" ".join(words(12, 900 + k)) for k in range(3000))
    rows = [(i, "\n".join(" ".join(words(15, 20 * i + k)) for k in range(4))) for i in range(40)]
    rows += [(50, None), (51, ""), (52, " \n "), (53, long), (54, rows[3][1]), (55, rows[3][1]), (3, rows[3][1]), (3, rows[3][1]), (None, rows[5][1]), (None, None), (56, "x")]
    full = [(d, t, "en", ["a", None, "b"][k % 3], None if t is None else len(t), *[f"{n}-{k}" for n in NAMES]) for k, (d, t) in enumerate(rows)]
    spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(40)] + [(None, 1, 0), (53, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(words(15, 20 * 7 + 1))), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return spark.createDataFrame(full, DOCS), str(tmp_path)


@pytest.mark.parametrize("stage", range(5))
def test_columns_of_users_come_back_as_they_were(spark, tables, stage):
    docs, folder = tables
    name, f = corpus_pipeline.STAGES[stage]
    out = f(spark, docs, folder)
    assert out.columns[: len(docs.columns)] == docs.columns
    held = {r["rank"]: r for r in docs.collect()}  # its value tells rows apart
    rows = out.collect()
    assert rows
    for r in rows:
        was = held[r["rank"]]
        assert all(r[n] == was[n] for n in NAMES) and (r["doc_id"], r["source"], r["lang"]) == (was["doc_id"], was["source"], was["lang"])
    if name == "mixing":
        assert all(r["mix_copies"] >= 1 and r["mix_taken"] == r["mix_copies"] * r["mix_size"] for r in rows)
    if name == "decontamination":
        assert len(rows) == docs.count() - 1 and 7 not in {r["doc_id"] for r in rows}
    if name == "near_dedup":
        assert [r["doc_id"] for r in rows].count(3) == 1 and not {54, 55} & {r["doc_id"] for r in rows}
    assert f(spark, docs.limit(0), folder).count() == 0
