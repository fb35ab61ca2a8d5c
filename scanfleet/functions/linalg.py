"""Batched 3x3 decompositions, the only Python kernels point statistics need.

Both take a handful of doubles per *reduced* row (one neighbourhood, plane or window pair), never points.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_EIGH = T.StructType(
    [T.StructField(n, T.DoubleType()) for n in
     ("l0", "l1", "l2", "v0x", "v0y", "v0z", "v1x", "v1y", "v1z", "v2x", "v2y", "v2z")]
)


@F.pandas_udf(_EIGH)
def _eigh3(xx: pd.Series, xy: pd.Series, xz: pd.Series, yy: pd.Series, yz: pd.Series, zz: pd.Series) -> pd.DataFrame:
    a, b, c, d, e, f = (s.to_numpy(dtype=float) for s in (xx, xy, xz, yy, yz, zz))
    m = np.stack([np.stack([a, b, c], -1), np.stack([b, d, e], -1), np.stack([c, e, f], -1)], -2)
    bad = ~np.isfinite(m).all(axis=(1, 2))
    m[bad] = np.eye(3)
    w, v = np.linalg.eigh(m)
    out = np.concatenate([w, v.transpose(0, 2, 1).reshape(len(w), 9)], axis=1)
    out[bad] = np.nan
    return pd.DataFrame(out, columns=_EIGH.names)


def eigh3(xx, xy, xz, yy, yz, zz) -> Column:
    """Eigenvalues ascending (l0..l2) and their unit vectors (v0.., v1.., v2..) of a symmetric 3x3."""
    return _eigh3(*(F.col(c) if isinstance(c, str) else c for c in (xx, xy, xz, yy, yz, zz)))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _rotation3(acc: pd.Series) -> pd.Series:
    m = np.stack([np.asarray(a, dtype=float).reshape(3, 3) for a in acc]) if len(acc) else np.zeros((0, 3, 3))
    u, _, vt = np.linalg.svd(m)
    flip = np.linalg.det(u @ vt) < 0
    u[flip, :, 2] *= -1.0
    return pd.Series(list((u @ vt).reshape(len(m), 9)))


def nearest_rotation(acc: Column) -> Column:
    """Proper rotation (row-major, 9 doubles) closest to an accumulated 3x3 matrix."""
    return _rotation3(acc)


def moments(x: Column, y: Column, z: Column) -> list[Column]:
    """Additive second moments about zero; centre the columns first for accuracy."""
    return [
        F.count(F.lit(1)).alias("n"),
        F.sum(x).alias("mx"), F.sum(y).alias("my"), F.sum(z).alias("mz"),
        F.sum(x * x).alias("mxx"), F.sum(x * y).alias("mxy"), F.sum(x * z).alias("mxz"),
        F.sum(y * y).alias("myy"), F.sum(y * z).alias("myz"), F.sum(z * z).alias("mzz"),
    ]


def covariance_of_moments() -> list[Column]:
    """xx, xy, xz, yy, yz, zz of the population covariance from the columns of :func:`moments`."""
    n = F.col("n")
    mean = {a: F.col(f"m{a}") / n for a in "xyz"}
    return [F.col(f"m{a}{b}") / n - mean[a] * mean[b] for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")]
