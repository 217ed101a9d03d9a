"""Chained-equations imputation (M1) of one frame: fitted and applied at once.

The estimator and its fitted form, for use inside folds, are
``pipeline.fit_imputer`` and ``pipeline.Imputer``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from .pipeline import fit_imputer


def impute_chained(df: DataFrame, cols: list[str], rounds: int = 3, n_nearest: int = 10,
                   min_value: float = -5000.0, max_value: float = 5000.0, reg: float = 1e-3) -> DataFrame:
    """M1: observed cells are never changed; missing cells are predicted."""
    return fit_imputer(df, cols, rounds, n_nearest, reg, min_value, max_value).transform(df)
