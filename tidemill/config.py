"""Parameters of the analysis."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Config:
    #: The settings of the study.
    window: int = 512
    stride: int = 6
    periods: tuple[int, ...] = (24, 168, 8760)
    embed_dim: int = 1024
    fixed_dim: int = 5
    eigenpairs: int = 20
    neighbours: tuple[int, ...] = (20, 40, 60, 80, 100, 150)
    acf_lags: tuple[int, ...] = (1, 6, 24, 168)
    alpha: float = 0.05
    min_regime_windows: int = 20
    min_cell_hours: int = 30
    min_kurtosis_hours: int = 50
    n_sim: int = 1000
    seed: int = 42
    #: The names of the features in the outputs.
    features: tuple[str, ...] = field(default=("mean", "std", "skew", "kurt", "min", "max", "range", "median", "p5", "p95", "iqr", "vol_24h", "lmp_mean", "lmp_p95", "lmp_std"))
