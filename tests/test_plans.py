import subprocess
import sys

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tests.conftest import SF
from tidemill import sources, streaming
from tidemill.config import Config
from tidemill.plans import queries, regime_analysis


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, name):
    import duckdb

    c = duckdb.connect()
    sf = SF.replace("0.001", "0.01")
    for t in ("events", "embeddings", "lineitem"):
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    r = c.execute(queries.ORACLES[name])
    cols = [x[0] for x in r.description]
    df = queries.QUERIES[name](spark, sf)
    assert sorted(cols) == sorted(df.columns)
    flat = lambda rows: sorted(tuple(round(v, 5) + 0.0 if isinstance(v, float) else str(v) for v in row) for row in rows)
    got, want = flat(tuple(x) for x in df.select(*cols).collect()), flat(r.fetchall())
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a == pytest.approx(b, abs=2e-5) if all(isinstance(v, float) for v in a) else [v if isinstance(v, str) else pytest.approx(v, abs=2e-5) for v in b] == list(a)


def test_entry(spark):
    out = __spark_entry__.entry(spark)
    assert out.count() == 4 and len(out.columns) == 17


def test_entry_without_text_subpackage():
    code = "import sys\nsys.modules['tidemill.llm'] = None\nimport __spark_entry__ as e\nassert 'window_features' in e.queries() and 'pipeline' not in e.queries() and set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True)


def test_whole_analysis(spark, tmp_path):
    cfg = Config(window=128, stride=6, periods=(24, 168), neighbours=(10, 20), n_sim=20, min_regime_windows=5)
    hourly = queries.hourly_series(spark, SF.replace("0.001", "0.01"))
    prepared = regime_analysis.prepare(hourly, cfg)
    assert [regime_analysis.signals(m) for m in ("split", "r", "dr")] == [("dr", "r"), ("r", "r"), ("dr", "dr")]
    for mode in ("split",):
        one = regime_analysis.analyse(spark, prepared, f"file://{tmp_path}", mode, cfg, sweep=range(2, 4)).first()
        assert one.N == (719 - 128) // 6 + 1 and one.K_FE >= 1 and -1 <= one.ARI <= 1
        root = sources.output_dir(f"file://{tmp_path}", mode, 128, 6)
        assert spark.read.parquet(f"{root}/labels.parquet").count() == one.N
        assert sources.read_csv(spark, f"{root}/eta_squared.csv", "feature string, eta2_FE double, eta2_EMB double").count() == 19
        assert spark.read.csv(f"{root}/moment_comparison.csv", header=True).count() == 3
        assert one.sil_FE is not None and one.sil_EMB is not None


def test_stages_resume_and_other_settings_compute_anew(spark, tmp_path):
    root = f"file://{tmp_path}/run"

    def run(fingerprint, dies=None):
        stages = sources.Stages(spark, root, fingerprint)
        a = stages.table("a", lambda: spark.range(5))
        if dies == "b":
            # a torn table has files but no manifest
            spark.range(2).write.mode("overwrite").parquet(f"{root}/b.parquet")
            return stages.computed
        b = stages.table("b", lambda: a.selectExpr("id * 2 AS id"), "a")
        assert b.agg({"id": "sum"}).first()[0] == 20
        return stages.computed

    assert run("x", dies="b") == ["a"] and run("x") == ["b"] and run("x") == [] and run("y") == ["a", "b"] and run("y") == []
    one, two = spark.createDataFrame([(1, "a"), (2, None)], "i int, s string"), spark.createDataFrame([(2, None), (1, "a")], "i int, s string")
    assert sources.fingerprint_of(one) == sources.fingerprint_of(two) != sources.fingerprint_of(one.union(one))


def test_sources(spark, tmp_path):
    root, calls = f"file://{tmp_path}", []
    make = lambda: calls.append(1) or spark.range(3)
    for reuse in (True, True, False):
        assert sources.cache_or_compute(spark, f"{root}/t", make, reuse).count() == 3
    assert len(calls) == 2
    axis = sources.date_axis(spark, "2024-01-01 00:00:00", 30)
    assert axis.count() == 30 and dict(axis.dtypes)["datetime"] == "timestamp_ntz"
    assert sources.with_timestamp(spark.createDataFrame([("2024-01-02 03:00:00",)], "datetime string")).first()[0].hour == 3


def test_stream(spark, tmp_path):
    queries.table(spark, SF, "events").select("ts", "value").repartition(1).write.parquet(f"{tmp_path}/in")
    stream = streaming.hourly_stream(spark.readStream.schema("ts timestamp_ntz, value double").parquet(f"{tmp_path}/in"))
    q = stream.writeStream.format("memory").queryName("hours").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = queries.hourly_series(spark, SF)
    assert spark.table("hours").join(want.withColumnRenamed("lmp", "w"), "datetime").where(F.abs(F.col("lmp") - F.col("w")) < 1e-9).count() == want.count()


def test_queries_run_at_full_size(spark, monkeypatch):
    """The arguments of the analysis reach the operators; only these are looked at."""
    seen, cfg = {}, Config()

    def stop(name):
        def call(*args, **kwargs):
            seen[name] = (args, kwargs)
            raise InterruptedError

        return call

    for module, name, query in ((queries.spectral, "choose_dimension", "dimension_sweep"), (queries.modes, "search", "tomato_modes"), (queries.simulate, "simulate_moments", "mc_moments")):
        with monkeypatch.context() as m:
            m.setattr(module, name, stop(name))
            with pytest.raises(InterruptedError):
                queries.QUERIES[query](spark, SF)
    args, kwargs = seen["choose_dimension"]
    assert (*args, *kwargs.values())[2:] == (range(2, 21), 5)
    assert seen["search"][0][1] == cfg.neighbours
    args, kwargs = seen["simulate_moments"]
    first = queries.branches(spark, SF).orderBy("idx").first()["lmp"]
    assert (*args, *kwargs.values())[2:] == (first, cfg.n_sim)
