"""The whole analysis: series -> branches -> windows -> two descriptions -> partitions -> diagnostics -> models -> simulation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..operators import decompose, embed, knn, merge, modes, regime_models, regimes, series, simulate, spectral, windows
from ..sources import Scratch, Stages, fingerprint_of, output_dir, write_csv


def prepare(hourly: DataFrame, cfg: Config) -> DataFrame:
    """(datetime, lmp, r, dr, idx): r is the remainder of asinh(lmp) after decomposition, dr its first difference."""
    parts = decompose.decompose(series.indexed(hourly), "y", cfg.periods)
    return series.branches(parts, "resid")


def signals(mode: str) -> tuple[str, str]:
    """The columns that the distribution features and the embedding read: split takes dr and r, r and dr take one for both."""
    return {"split": ("dr", "r"), "r": ("r", "r"), "dr": ("dr", "dr")}[mode]


def partition(coords: DataFrame, dim: int, cfg: Config) -> tuple[DataFrame, int, int]:
    """(window_id, label) of density modes in the first ``dim`` coordinates, and the chosen k and number of modes.

    Neighbours and densities are those of all rows against all; the cells of the index only keep what groups of rows send to each other small.
    """
    s = Scratch(coords.sparkSession)
    x = s.save(coords.select("window_id", F.slice("dc", 1, dim).alias("x")))
    n = x.count()
    spread = x.select(F.explode("x").alias("v")).agg(F.stddev_pop("v")).first()[0] or 1.0
    ks = tuple(k for k in cfg.neighbours if k < n) or (max(1, n - 1),)
    width = max(spread * n ** (-1 / (dim + 4)), 1e-12)
    edges = knn.search(knn.build(x, "window_id", "x", max(ks), recall=None), max(ks), width)
    return modes.search(s.save(edges), ks)


def dimension(coords: DataFrame, cfg: Config, sweep: range | None) -> DataFrame:
    """(d, silhouette): the best dimension of the sweep, or the fixed one, with the silhouette of k-means in it; bounded by the coordinates there are."""
    first = coords.select(F.size("dc").alias("n")).first()
    most = max(1, first["n"] if first else 0)
    if sweep is not None:
        scores = spectral.choose_dimension(coords, "window_id", range(sweep.start, min(sweep.stop, most + 1)))
        return scores.orderBy(F.col("silhouette").desc_nulls_last(), "d").limit(1).select("d", "silhouette")
    d, n = min(cfg.fixed_dim, most), coords.count()
    score = spectral.silhouette(spectral.k_means(coords, d, spectral.clusters_for(n)), "window_id", "x", "label") if n > 2 else coords.sparkSession.createDataFrame([(None,)], "silhouette double")
    return score.select(F.lit(d).alias("d"), "silhouette")


def analyse(spark: SparkSession, prepared: DataFrame, out: str, mode: str = "split", cfg: Config | None = None, make: Callable = embed.SpectralEmbedder, reuse_embedding: bool | None = None, sweep: range = range(2, 21), resume: bool = True) -> DataFrame:
    """Runs every stage, publishes each table below ``out`` and returns the one-row summary.

    A run that was cut off resumes after its last whole stage; other input, mode or settings compute anew. ``reuse_embedding`` says so for the embedding alone.
    """
    cfg, s = cfg or Config(), Scratch(spark)
    fe_signal, emb_signal = signals(mode)
    root = output_dir(out, mode, cfg.window, cfg.stride)
    prepared = s.save(prepared)
    stages = Stages(spark, root, repr((fingerprint_of(prepared), mode, cfg, sweep)), resume)
    prepared = stages.table("preprocessed", lambda: prepared)
    w = stages.table("windows", lambda: windows.windows(prepared, cfg.window, cfg.stride), "preprocessed")
    fe = stages.table("fe_features", lambda: windows.features(w, fe_signal, cfg.window), "windows")
    stages.resume = resume if reuse_embedding is None else reuse_embedding
    emb = stages.table("embeddings", lambda: embed.embed(windows.as_arrays(w, emb_signal), make), "windows")
    stages.resume = resume
    columns = list(cfg.features)
    fe_x = lambda: spectral.standardize(fe, columns).select("window_id", F.array(*columns).alias("x"))
    emb_x = lambda: spectral.principal_components(spectral.standardize_vectors(emb.select("window_id", F.col("embedding").alias("x"))))
    summary: dict[str, object] = {"N": fe.count()}
    targets = windows.targets(w.withColumn("r", F.col(emb_signal)))
    found = []
    for name, x, target, side, source in (("FE", fe_x, "lmp_mean", "regime_E", "fe_features"), ("EMB", emb_x, "acf_6h", "regime_D", "embeddings")):
        coords = stages.table(f"coords_{name}", lambda x=x: spectral.diffusion_coordinates(x(), "window_id", "x", cfg.eigenpairs)[0], source)
        best = stages.table(f"dimension_{name}", lambda coords=coords, name=name: dimension(coords, cfg, sweep if name == "FE" else None), f"coords_{name}").first()
        dim = best["d"] if best else 2

        def parted(coords=coords, dim=dim, target=target, side=side) -> DataFrame:
            modes_, k, n = partition(coords, dim, cfg)
            merged = merge.tukey_merge(targets.join(modes_.select(F.col("i").alias("window_id"), "label"), "window_id"), "label", target, cfg.alpha, cfg.min_regime_windows, name=side)
            return merged.select("window_id", side, F.lit(k).alias("k"), F.lit(n).alias("n_modes"))

        part = stages.table(f"regimes_{name}", parted, f"dimension_{name}", f"coords_{name}")
        one = part.select("k", "n_modes").first()
        summary |= {f"d_{name}": dim, f"sil_{name}": best["silhouette"] if best else None, f"knn_{name}": one and one["k"], f"modes_{name}": one and one["n_modes"]}
        found.append(part.select("window_id", side))
    labels = stages.table("labels", lambda: targets.join(found[0], "window_id").join(found[1], "window_id"), "regimes_FE", "regimes_EMB")
    summary |= {"K_FE": labels.where("regime_E >= 0").select("regime_E").distinct().count(), "K_EMB": labels.where("regime_D >= 0").select("regime_D").distinct().count()}
    summary["ARI"] = regimes.adjusted_rand(labels, "regime_E", "regime_D").first()[0]
    acf = windows.acf_of(w, emb_signal, cfg.acf_lags)
    described = fe.join(acf, "window_id").join(labels.select("window_id", "regime_E", "regime_D"), "window_id")
    write_csv(regimes.eta_table(described, [*columns, *[f"acf_{k}h" for k in cfg.acf_lags]], {"eta2_FE": "regime_E", "eta2_EMB": "regime_D"}), f"{root}/eta_squared.csv")
    hours = series.labels_by_hour(prepared, labels.select("window_id", F.col("regime_E").alias("e"), F.col("regime_D").alias("d")), cfg.stride)
    hours = s.save(hours)
    p = s.save(regime_models.pairs(hours))
    by_e, by_ed = (regime_models.cell_table(p, x, cfg.min_cell_hours) for x in (["e"], ["e", "d"]))
    write_csv(by_e, f"{root}/ar1_by_E.csv")
    write_csv(by_ed, f"{root}/ar1_by_ED.csv")
    models = regime_models.comparison(p, {"phi_E": ["e"], "phi_ED": ["e", "d"]}, cfg.min_cell_hours)
    write_csv(models, f"{root}/model_comparison.csv")
    overall = regime_models.global_summary(p).select("n", "phi", "c", F.col("sig_eps").alias("sigma"), "half_life", "kurt")
    first = prepared.orderBy("idx").select("lmp").first()
    empirical = regime_models.moments(p, "dp").select(F.lit("empirical").alias("series"), "*")
    per_e = p.where("e >= 0").groupBy("e").agg(F.count("*").alias("n"), (F.kurtosis("dp") + 3).alias("kurt")).where(F.col("n") >= cfg.min_kurtosis_hours)
    winners = {}
    for name, x in (("phi_E", ["e"]), ("phi_ED", ["e", "d"])):
        cells = regime_models.simulation_parameters(hours, x, cfg.min_cell_hours)
        sums = simulate.simulate_moments(spark, simulate.hourly_parameters(hours, cells, overall, x), first[0] if first else 1.0, cfg.n_sim, cfg.seed)
        sums = s.save(sums)
        empirical = empirical.union(simulate.pooled_moments(sums).select(F.lit(name).alias("series"), "*"))
        winners[name] = simulate.group_kurtosis(sums, cfg.min_kurtosis_hours)
    write_csv(empirical, f"{root}/moment_comparison.csv")
    write_csv(regime_models.kurtosis_winners(per_e, winners["phi_E"], winners["phi_ED"]), f"{root}/moment_comparison_per_E.csv")
    o = overall.first()
    summary |= {"phi": o["phi"], "half_life": o["half_life"], "kurt_eps": o["kurt"]}
    for m in models.collect():  # two rows
        summary |= {f"{k}_{m['model']}": m[k] for k in ("rmse", "kurtosis", "loglik", "aic", "bic")}
    one = spark.createDataFrame([tuple(float(v) if v is not None else None for v in summary.values())], ", ".join(f"{k} double" for k in summary))
    write_csv(one, f"{root}/summary.csv")
    return one
