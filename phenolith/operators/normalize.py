"""Normalization: statistics of a reference subset, applied to every row.

Fitting is one aggregation, some passes of counts for exact percentiles, or a
distributed QR decomposition for whitening; applying is a projection, or a map over Arrow batches
where the transform mixes columns or tables are very wide.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phenolith.functions.exprs import col, number, subset
from phenolith.functions.linalg import matrix, moments, triangle
from phenolith.functions.ranks import order_statistics
from phenolith.functions.schema import features_of, infer_features
from phenolith.sources.readers import load_profiles
from phenolith.sources.sinks import sink

METHODS = ("standardize", "robustize", "mad_robustize", "spherize", "inverse_normal")
#: Texts that stand for a missing number.
MISSING = ("", "na", "n/a", "nan", "none", "null")
#: Columns beyond which a projection is replaced by a map over Arrow batches.
WIDE = 600


@dataclass
class Shift:
    """(x - center) / scale for each column."""

    center: np.ndarray
    scale: np.ndarray

    def column(self, name: str, j: int) -> Column:
        c, s = float(self.center[j]), float(self.scale[j])
        if math.isnan(c):
            return F.lit(None).cast("double").alias(name)
        x = number(name) - F.lit(c)
        if s == 0:  # as floating point has it
            return F.when(x == 0, F.lit(float("nan"))).when(x > 0, F.lit(float("inf"))).when(x < 0, F.lit(float("-inf"))).alias(name)
        return (x / F.lit(s)).alias(name)

    def array(self, x: np.ndarray) -> np.ndarray:
        with np.errstate(all="ignore"):
            return (x - self.center) / self.scale


@dataclass
class Whiten:
    center: np.ndarray
    scale: np.ndarray
    weight: np.ndarray

    def array(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.center) / self.scale) @ self.weight


@dataclass
class Quantiles:
    """Interpolation of quantiles, then the normal's inverse; ends are clipped."""

    grid: np.ndarray  # quantiles x columns
    edge: float = 1e-7

    def array(self, x: np.ndarray) -> np.ndarray:
        out = np.full_like(x, np.nan)
        p = np.linspace(0, 1, len(self.grid))
        low = inverse_normal(np.array([self.edge - np.spacing(1)]))[0]
        for j in range(x.shape[1]):
            q, v = self.grid[:, j], x[:, j]
            ok = np.isfinite(v)
            if np.isnan(q).any() or not ok.any():
                continue
            v = v[ok]
            y = 0.5 * (np.interp(v, q, p) - np.interp(-v, -q[::-1], -p[::-1]))
            y[v + self.edge > q[-1]] = 1.0
            y[v - self.edge < q[0]] = 0.0
            out[ok, j] = np.clip(inverse_normal(np.clip(y, self.edge / 10, 1 - self.edge / 10)), low, -low)
        return out


#: Wichura's rational approximations (algorithm AS 241, double precision), lowest power first.
_AS241 = (
    ((3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3), (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3, 2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3)),
    ((1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4), (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1, 1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9)),
    ((6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7), (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2, 7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15)),
)


def inverse_normal(p: np.ndarray) -> np.ndarray:
    """The standard normal's quantile of each probability strictly between 0 and 1."""
    q = p - 0.5
    ratio = lambda k, r: np.polyval(_AS241[k][0][::-1], r) / np.polyval(_AS241[k][1][::-1], r)
    with np.errstate(all="ignore"):
        r = np.sqrt(-np.log(np.minimum(p, 1 - p)))
        tail = np.where(r <= 5, ratio(1, r - 1.6), ratio(2, r - 5))
        return np.where(np.abs(q) <= 0.425, q * ratio(0, 0.180625 - q * q), np.copysign(tail, q))


def _percentiles(df: DataFrame, columns: Sequence[str], at: Sequence[float]) -> np.ndarray:
    """Exact, linearly interpolated percentiles: a row each, NaN for columns without values."""
    return order_statistics(df, columns, at)[0]


def fit_standardize(df: DataFrame, columns: list[str]) -> Shift:
    n, mean, std = moments(df, columns)
    eps = np.finfo(float).eps  # deviations that rounding alone can make count as none
    flat = std**2 <= n * eps * std**2 + (n * mean * eps) ** 2
    return Shift(mean, np.where((std == 0) | flat, 1.0, std))


def fit_robustize(df: DataFrame, columns: list[str]) -> Shift:
    q = _percentiles(df, columns, (0.25, 0.5, 0.75))
    spread = q[2] - q[0]
    return Shift(q[1], np.where(spread == 0, 1.0, spread))


def fit_mad(df: DataFrame, columns: list[str], epsilon: float | None = 1e-18) -> Shift:
    if epsilon is None:
        raise ValueError("mad_robustize needs an epsilon")
    median = _percentiles(df, columns, (0.5,))[0]
    away = df.select(*[F.abs(number(c) - F.lit(float(m) if not math.isnan(m) else None).cast("double")).alias(c) for c, m in zip(columns, median, strict=True)])
    return Shift(median, _percentiles(away, columns, (0.5,))[0] * 1.4826 + epsilon)


def fit_inverse_normal(df: DataFrame, columns: list[str], n_quantiles: int = 1000) -> Quantiles:
    """All rows make the quantiles, however many there are."""
    n = max(1, min(n_quantiles, df.count()))
    return Quantiles(_percentiles(df, columns, np.linspace(0, 1, n).tolist()))


def fit_spherize(df: DataFrame, columns: list[str], center: bool = True, method: str = "ZCA-cor", epsilon: float = 1e-6, svd_on: str = "raw") -> Whiten:
    """Whitening by PCA or ZCA of the covariance, or of the correlation (``-cor``).

    The singular vectors come from the matrix as given (``svd_on="raw"``), which is what users of
    this method rely on, or from the centred or standardized one (``"transformed"``), which whitens
    data that aren't standardized yet.  Both agree on standardized input.
    """
    if method not in ("PCA", "ZCA", "PCA-cor", "ZCA-cor"):
        raise ValueError("spherize_method must be PCA, ZCA, PCA-cor or ZCA-cor")
    if method.endswith("-cor") and not center:
        raise ValueError("PCA-cor and ZCA-cor need spherize_center=True")
    d = len(columns)
    n, mean, std = moments(df, columns)
    if np.isnan(mean).any() or df.filter(" or ".join(f"`{c}` is null or isnan(cast(`{c}` as double))" for c in columns)).limit(1).count():
        raise ValueError("spherize needs columns without missing values")
    if method.endswith("-cor"):
        if (std <= 1e-14 * np.maximum(1, np.abs(mean))).any():
            raise ValueError("Divide by zero error, make sure low variance columns are removed")
        scale = std
    else:
        scale = np.ones(d)
        mean = mean if center else np.zeros(d)
    changed = triangle(df, columns, mean, scale)  # as many rows as columns, with the singular values of the whole matrix
    top = np.linalg.svd(changed, compute_uv=False)
    rank = int((top > top.max(initial=0.0) * max(n, d) * np.finfo(float).eps).sum())
    _, s, vt = np.linalg.svd(triangle(df, columns) if svd_on == "raw" else changed, full_matrices=True)
    s = np.concatenate([s, np.zeros(d - len(s))])
    least = n - 1 if center else n
    if rank not in (d, least):
        raise ValueError(f"the matrix has rank {rank}; {d} (columns) or {least} (rows) is needed: remove columns that depend on others")
    if n <= d:
        s = np.concatenate([s[:rank], np.full(d - rank, s[rank - 1])])
    weight = (vt / (s[:d, None] + epsilon)).T * np.sqrt(n - 1)
    return Whiten(mean, scale, weight @ vt if method.startswith("ZCA") else weight)


def apply(df: DataFrame, model, keep: Sequence[str], columns: Sequence[str], names: Sequence[str] | None = None) -> DataFrame:
    """``keep`` as they are, then the transformed columns."""
    names = list(names or columns)
    if isinstance(model, Shift) and len(columns) <= WIDE:
        return df.select(*[col(c) for c in keep], *[model.column(c, j) for j, c in enumerate(columns)])
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(c, T.DoubleType()) for c in names])
    chosen = df.select(*[col(c) for c in keep], *[number(c).alias(f"_x{j}") for j, c in enumerate(columns)])
    inputs = [f"_x{j}" for j in range(len(columns))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 4096):
                part = b.slice(lo, 4096)
                x = matrix(part, inputs)
                y = model.array(x)  # missing values stay missing; what arithmetic makes of others stays as it is
                missing = np.isnan(x) | np.isnan(model.center) if isinstance(model, Shift) else np.isnan(y)
                cols = [part.column(i) for i in range(len(keep))] + [pa.array(np.ascontiguousarray(y[:, j]), mask=missing[:, j]) for j in range(y.shape[1])]
                yield pa.RecordBatch.from_arrays(cols, schema=pa.schema([*[b.schema.field(i) for i in range(len(keep))], *[(c, pa.float64()) for c in names]]))

    return chosen.mapInArrow(run, schema)


def drop_flagged(df: DataFrame) -> DataFrame:
    """Rows that no ``Metadata_cqc_*`` column flags."""
    flags = [c for c in df.columns if c.startswith("Metadata_cqc_")]
    if not flags:
        raise ValueError("no Metadata_cqc_ columns to filter by")
    bad = F.lit(False)
    for c in flags:
        bad = bad | F.coalesce(col(c).cast("boolean"), F.lit(False))
    out = df.filter(~bad)
    if out.isEmpty():
        raise ValueError("every row is flagged")
    return out


def numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Text columns that hold numbers and marks of missing ones alone, as doubles; others are refused."""
    text = [c for c in columns if isinstance(df.schema[c].dataType, T.StringType)]
    bad = [c for c in columns if c not in text and not isinstance(df.schema[c].dataType, (T.NumericType, T.BooleanType, T.NullType))]
    if text:
        mark = lambda c: F.lower(F.trim(col(c))).isin(*MISSING)
        row = df.agg(*[F.coalesce(F.bool_or(~mark(c) & col(c).try_cast("double").isNull()), F.lit(False)).alias(f"_{i}") for i, c in enumerate(text)]).first()
        bad += [c for c, b in zip(text, row, strict=True) if b]
        df = df.withColumns({c: F.when(~mark(c), col(c).try_cast("double")) for c in text if c not in bad})
    if bad:
        raise ValueError(f"normalize needs numeric feature columns; these aren't: {bad}")
    return df


@sink
def normalize(
    profiles: str | DataFrame,
    features: str | Sequence[str] = "infer",
    image_features: bool = False,
    meta_features: str | Sequence[str] = "infer",
    samples: str | Column = "all",
    method: str = "standardize",
    drop_cosmicqc_rows: bool = False,
    mad_robustize_epsilon: float | None = 1e-18,
    spherize_center: bool = True,
    spherize_method: str = "ZCA-cor",
    spherize_epsilon: float = 1e-6,
    spherize_svd_on: str = "raw",
    inverse_normal_n_quantiles: int = 1000,
) -> DataFrame:
    """Metadata, image payload, then features normalized by statistics of ``samples``.

    NaN counts as missing; missing values stay missing and take no part in statistics.
    """
    df = load_profiles(profiles)
    if drop_cosmicqc_rows:
        df = drop_flagged(df)
    method = method.lower()
    if method not in METHODS:
        raise ValueError(f"method must be one of {list(METHODS)}")
    features = features_of(df, features, image_features=image_features)
    if isinstance(meta_features, str) and meta_features != "infer":
        raise ValueError("meta_features must be 'infer' or a list of column names")
    meta = infer_features(df, metadata=True) if isinstance(meta_features, str) else list(meta_features)
    df = numeric(df, features)
    used = {*features, *meta}
    payload = [c for c in df.columns if c not in used and c.startswith(("Image_", "ome_arrow_"))]
    reference = subset(df, samples)
    names = features
    if method == "standardize":
        model = fit_standardize(reference, features)
    elif method == "robustize":
        model = fit_robustize(reference, features)
    elif method == "mad_robustize":
        model = fit_mad(reference, features, mad_robustize_epsilon)
    elif method == "inverse_normal":
        model = fit_inverse_normal(reference, features, inverse_normal_n_quantiles)
    else:
        model = fit_spherize(reference, features, spherize_center, spherize_method, spherize_epsilon, spherize_svd_on)
        if spherize_method.startswith("PCA"):
            names = [f"PC{i + 1}" for i in range(len(features))]
    return apply(df, model, [*meta, *payload], features, names)
