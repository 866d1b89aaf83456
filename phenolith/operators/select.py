"""Feature selection: columns that statistics flag are dropped.

Statistics that look at one column at a time are taken for all columns in one
aggregation, whatever the order of operations; correlations are taken for the
columns that are left when their turn comes.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phenolith.functions.exprs import col, is_missing, number, subset, unique_name
from phenolith.functions.linalg import NARROW, column_stats, pairwise
from phenolith.functions.schema import features_of
from phenolith.sources.blocklist import Blocklist, blocked
from phenolith.sources.readers import load_profiles
from phenolith.sources.sinks import sink

OPERATIONS = ("variance_threshold", "frequency_threshold", "drop_na_columns", "correlation_threshold", "blocklist", "drop_outliers", "noise_removal")
CHUNK = 300


def _stats(df: DataFrame, features: Sequence[str], kinds: Sequence[str]) -> dict[str, dict[str, float | None]]:
    """For each feature the asked statistics, of one pass over wide tables of numbers, else of one
    aggregation for each ``CHUNK`` columns."""
    if len(features) > NARROW and all(isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType, T.IntegralType)) for c in features):
        s = column_stats(df, list(features))
        none = lambda x: [None if n == 0 else float(v) for v, n in zip(x, s.count, strict=True)]
        found = {"var": none(s.squares / np.maximum(s.count, 1)), "na": [1 - float(n) / s.rows if s.rows else None for n in s.count], "max": none(s.high), "min": none(s.low)}
        return {c: {k: found[k][i] for k in kinds} for i, c in enumerate(features)}
    make = {"var": lambda c: F.var_pop(number(c)), "na": lambda c: F.avg(is_missing(df, c).cast("double")), "max": lambda c: F.max(number(c)), "min": lambda c: F.min(number(c))}
    out = {}
    for lo in range(0, len(features), CHUNK):
        part = features[lo : lo + CHUNK]
        row = df.agg(*[make[k](c).alias(f"_{i}_{k}") for i, c in enumerate(part) for k in kinds]).first()
        out |= {c: {k: row[f"_{i}_{k}"] for k in kinds} for i, c in enumerate(part)}
    return out


def variance_threshold(df: DataFrame, features: str | Sequence[str] = "infer", samples: str | Column = "all", min_variance: float = 1e-6, *, stats: dict | None = None) -> list[str]:
    """Features whose population variance is at most ``min_variance``; an error if that is all of them."""
    if not isinstance(min_variance, (int, float)) or min_variance < 0:
        raise ValueError("min_variance must be a number of at least 0")
    features = features_of(df, features)
    stats = stats or _stats(subset(df, samples), features, ["var"])
    out = [c for c in features if stats[c]["var"] is None or stats[c]["var"] <= min_variance]
    if features and len(out) == len(features):
        raise ValueError(f"no feature has a variance over {float(min_variance)}")
    return out


def na_columns(df: DataFrame, features: str | Sequence[str] = "infer", samples: str | Column = "all", cutoff: float = 0.05, *, stats: dict | None = None) -> list[str]:
    """Features with more than ``cutoff`` of their values missing."""
    if not 0 <= cutoff <= 1:
        raise ValueError("cutoff must be between 0 and 1")
    features = features_of(df, features)
    stats = stats or _stats(subset(df, samples), features, ["na"])
    return [c for c in features if (stats[c]["na"] or 0.0) > cutoff]


def outlier_features(df: DataFrame, features: str | Sequence[str] = "infer", samples: str | Column = "all", outlier_cutoff: float = 500, *, stats: dict | None = None) -> list[str]:
    """Features with a value farther than ``outlier_cutoff`` from 0."""
    features = features_of(df, features)
    stats = stats or _stats(subset(df, samples), features, ["max", "min"])
    return [c for c in features if any(abs(v) > outlier_cutoff for v in (stats[c]["max"], stats[c]["min"]) if v is not None)]


def value_counts(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, distinct, most, second): counts of each feature's two commonest values.

    Values are counted with partial sums before the shuffle; the two largest counts of a
    feature come from aggregations too, so no task holds a feature's values.
    """
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), number(c).alias("value")) for c in features])).alias("x")
    counts = df.select(each).select("x.*").filter("value is not null").groupBy("feature", "value").agg(F.count("*").alias("n"))
    top = counts.groupBy("feature").agg(F.count("*").alias("distinct"), F.max(F.struct("n", "value")).alias("t"))
    rest = counts.join(F.broadcast(top.select("feature", F.col("t.value").alias("v"))), "feature").filter("value != v").groupBy("feature").agg(F.max("n").alias("second"))
    return top.join(rest, "feature", "left").select("feature", "distinct", F.col("t.n").alias("most"), F.coalesce("second", F.lit(0)).alias("second"))


def frequency_threshold(df: DataFrame, features: str | Sequence[str] = "infer", samples: str | Column = "all", freq_cut: float = 0.05, unique_cut: float = 0.01) -> list[str]:
    """Features whose second commonest value is rarer than ``freq_cut`` of the commonest, or that
    have fewer distinct values than ``unique_cut`` of the rows."""
    if not 0 <= freq_cut <= 1 or not 0 <= unique_cut <= 1:
        raise ValueError("freq_cut and unique_cut must be between 0 and 1")
    features, rows = features_of(df, features), subset(df, samples)
    n = rows.count()
    found = {r.feature: r for lo in range(0, len(features), CHUNK) for r in value_counts(rows, features[lo : lo + CHUNK]).collect()}

    def low(c: str) -> bool:
        r = found.get(c)
        return r is None or r.second / r.most < freq_cut or (n > 0 and r.distinct / n < unique_cut)

    return [c for c in features if low(c)]


def noise_removal(df: DataFrame, noise_removal_perturb_groups: str | Sequence[str], features: str | Sequence[str] = "infer", samples: str | Column = "all", noise_removal_stdev_cutoff: float = 0.8) -> list[str]:
    """Features whose standard deviation within groups, averaged over them, is over the cutoff.

    Groups are a column, or a list with a label for each row of the subset, in its order.
    """
    features, rows = features_of(df, features), subset(df, samples)
    if isinstance(noise_removal_perturb_groups, str):
        group = noise_removal_perturb_groups
        if group not in df.columns:
            raise ValueError(f"{group} is not a column")
    else:
        labels, group = [str(x) for x in noise_removal_perturb_groups], unique_name("_group", df.columns)
        at, part = unique_name("_at", df.columns), unique_name("_part", df.columns)
        numbered = rows.withColumn(at, F.monotonically_increasing_id())  # the partition, and the row's place in it
        sizes = {r[0]: r[1] for r in numbered.groupBy(F.shiftright(at, 33).alias(part)).agg(F.count("*")).collect()}
        if sum(sizes.values()) != len(labels):
            raise ValueError("noise_removal_perturb_groups must have a label for each row")
        places = [(p << 33) + i for p in sorted(sizes) for i in range(sizes[p])]
        named = df.sparkSession.createDataFrame(list(zip(places, labels, strict=True)), T.StructType([T.StructField(at, T.LongType()), T.StructField(group, T.StringType())]))
        rows = numbered.join(named, at)
    spread: dict[str, float | None] = {}
    for lo in range(0, len(features), CHUNK):
        part = features[lo : lo + CHUNK]
        one = rows.filter(col(group).isNotNull()).groupBy(col(group)).agg(*[F.stddev_pop(number(c)).alias(f"_{i}") for i, c in enumerate(part)])
        row = one.agg(*[F.avg(f"_{i}").alias(f"_{i}") for i in range(len(part))]).first()
        spread |= dict(zip(part, row, strict=True))
    return [c for c in features if spread[c] is not None and spread[c] > noise_removal_stdev_cutoff]


def correlation_threshold(df: DataFrame, features: str | Sequence[str] = "infer", samples: str | Column = "all", threshold: float = 0.9, method: str = "pearson") -> list[str]:
    """Of each pair that correlates (with its sign) over ``threshold``, the feature that has the larger
    sum of absolute correlations; of equals, the later column."""
    if not 0 <= threshold <= 1:
        raise ValueError("threshold must be between 0 and 1")
    features = features_of(df, features)
    if len(features) < 2:
        return []
    c, pairs = pairwise(subset(df, samples), features, method)
    total = np.nansum(np.abs(c), axis=0).round(12)
    place = {features[i]: p for p, i in enumerate(np.argsort(total, kind="stable"))}
    out = {a if place[a] > place[b] else b for a, b, r in pairs if r > threshold}
    return [f for f in features if f in out]


@sink
def feature_select(
    profiles: str | DataFrame,
    features: str | Sequence[str] = "infer",
    image_features: bool = False,
    samples: str | Column = "all",
    operation: str | Sequence[str] = "variance_threshold",
    na_cutoff: float = 0.05,
    corr_threshold: float = 0.9,
    corr_method: str = "pearson",
    freq_cut: float = 0.05,
    unique_cut: float = 0.01,
    blocklist: str | Sequence[str] | Blocklist | None = None,
    blocklist_name: str | Sequence[str] | None = None,
    blocklist_file: str | None = None,
    outlier_cutoff: float = 500.0,
    noise_removal_perturb_groups: str | Sequence[str] | None = None,
    noise_removal_stdev_cutoff: float | None = None,
    min_variance: float = 1e-6,
) -> DataFrame:
    """The table without the features that the operations flag, each looking at what the last left."""
    if not isinstance(operation, (str, list, tuple)):
        raise ValueError("operation must be a name or a list of names")
    operations = [operation] if isinstance(operation, str) else list(operation)
    if unknown := [o for o in operations if o not in OPERATIONS]:
        raise ValueError(f"unknown operations {unknown}; there are {list(OPERATIONS)}")
    if "noise_removal" in operations and (noise_removal_perturb_groups is None or noise_removal_stdev_cutoff is None):
        raise ValueError("noise_removal needs noise_removal_perturb_groups and noise_removal_stdev_cutoff")
    df = load_profiles(profiles)
    features = features_of(df, features, image_features=image_features)
    kinds = [k for o, ks in (("variance_threshold", ["var"]), ("drop_na_columns", ["na"]), ("drop_outliers", ["max", "min"])) if o in operations for k in ks]
    stats = _stats(subset(df, samples), features, kinds) if kinds else {}
    only = lambda *ks: {c: {k: stats[c][k] for k in ks} for c in features}
    dropped: dict[str, None] = {}
    for o in operations:
        if not features and o != "blocklist":
            continue
        if o == "variance_threshold":
            out = variance_threshold(df, features, samples, min_variance, stats=only("var"))
        elif o == "frequency_threshold":
            out = frequency_threshold(df, features, samples, freq_cut, unique_cut)
        elif o == "drop_na_columns":
            out = na_columns(df, features, samples, na_cutoff, stats=only("na"))
        elif o == "correlation_threshold":
            out = correlation_threshold(df, features, samples, corr_threshold, corr_method)
        elif o == "blocklist":
            out = blocked(df, blocklist, blocklist_name, blocklist_file)
        elif o == "drop_outliers":
            out = outlier_features(df, features, samples, outlier_cutoff, stats=only("max", "min"))
        else:
            out = noise_removal(df, noise_removal_perturb_groups, features, samples, noise_removal_stdev_cutoff)
        dropped |= dict.fromkeys(out)
        features = [c for c in features if c not in dropped]
    return df.drop(*dropped)


def count_na(df: DataFrame, features: str | Sequence[str] = "infer") -> DataFrame:
    """(feature, num_na) for each feature."""
    features = features_of(df, features)
    one = df.agg(*[F.coalesce(F.sum(is_missing(df, c).cast("long")), F.lit(0)).alias(c) for c in features])
    return one.unpivot([], [col(c) for c in features], "feature", "num_na")
