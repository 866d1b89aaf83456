"""Rows of a stratum combined into one profile."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phenolith.functions.exprs import col, number, unique_name
from phenolith.functions.ranks import order_statistics
from phenolith.functions.reuse import kept
from phenolith.functions.schema import features_of
from phenolith.sources.sinks import sink

#: Features of one aggregation; wider tables are aggregated in pieces and joined.
CHUNK = 400
#: Rows of a stratum up to which a task may hold its values for a median, and values of a stratum that
#: one aggregation holds.  Medians of larger strata come from counts over all tasks.
LARGE, CELLS = 1 << 18, 1 << 22


def check_operation(operation: str, allowed: Sequence[str] = ("mean", "median")) -> str:
    if operation.lower() not in allowed:
        raise ValueError(f"operation must be one of {list(allowed)}")
    return operation.lower()


def null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Join on equal keys, null with null; key columns come from the left."""
    marks = [unique_name(f"_k{i}", [*left.columns, *right.columns]) for i in range(len(keys))]
    for k, m in zip(keys, marks, strict=True):
        right = right.withColumnRenamed(k, m)
    on = [col(k).eqNullSafe(F.col(m)) for k, m in zip(keys, marks, strict=True)]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return left.join(right, cond, how).drop(*marks)


def _sizes(df: DataFrame, strata: Sequence[str], counts: Sequence[Column]) -> tuple[int | None, list[tuple], list[list[int]]]:
    """(most rows of the strata of ``LARGE`` rows or fewer, keys of the larger ones, their ``counts``)."""
    n, found = unique_name("_n", strata), [unique_name(f"_c{i}", strata) for i in range(len(counts))]
    sizes = df.groupBy(*[col(k) for k in strata]).agg(F.count("*").alias(n), *[c.alias(name) for c, name in zip(counts, found, strict=True)])
    row = sizes.agg(F.max(F.when(col(n) <= LARGE, col(n))), F.collect_list(F.when(col(n) > LARGE, F.struct(F.struct(*[col(k) for k in strata]), F.array(*map(F.col, found)).cast("array<long>"))))).first()
    return row[0], [tuple(k) for k, _ in row[1]], [list(c) for _, c in row[1]]


def _large_medians(df: DataFrame, strata: Sequence[str], features: Sequence[str], counts: Sequence[Column], names: Sequence[str]) -> tuple[int | None, DataFrame | None, DataFrame | None]:
    """(most rows of the other strata, keys of the strata of more than ``LARGE`` rows, these strata's profiles); all passes read rows that are made once."""
    spark = df.sparkSession
    with kept(df) as rows:
        most, large, counted = _sizes(rows, strata, counts)
        if not large:
            return most, None, None
        keys, group = [df.schema[k] for k in strata], unique_name("_group", df.columns)
        of = spark.createDataFrame([(*k, i) for i, k in enumerate(large)], T.StructType([*keys, T.StructField(group, T.IntegerType())]))
        some = null_safe(rows, F.broadcast(of), strata, "inner")  # at most a stratum for each LARGE rows
        found = order_statistics(some, features, (0.5,), group, once=False)
    none = np.full((1, len(features)), np.nan)
    profiles = [(*k, *c, *[None if v != v else float(v) for v in found.get(i, none)[0]]) for i, (k, c) in enumerate(zip(large, counted, strict=True))]
    return most, of, spark.createDataFrame(profiles, T.StructType([*keys, *[T.StructField(c, T.LongType()) for c in names], *[T.StructField(c, T.DoubleType()) for c in features]]))


@sink
def aggregate(
    population_df: DataFrame,
    strata: Sequence[str] = ("Metadata_Plate", "Metadata_Well"),
    features: str | Sequence[str] = "infer",
    image_features: bool = False,
    operation: str = "median",
    compute_object_count: bool = False,
    object_feature: str = "Metadata_ObjectNumber",
    subset_data_df: DataFrame | None = None,
) -> DataFrame:
    """One row a stratum: the mean or exact median of each feature, missing values left out.

    Null keys form strata of their own; their object count is null.  With
    ``subset_data_df`` each row counts as often as the subset holds its keys.
    """
    how = check_operation(operation)
    strata = [strata] if isinstance(strata, str) else list(strata)
    if subset_data_df is not None:
        population_df = null_safe(population_df, subset_data_df.select(*[col(c) for c in subset_data_df.columns if c in population_df.columns]), [c for c in subset_data_df.columns if c in population_df.columns], "inner")
    features = [c for c in features_of(population_df, features, image_features=image_features) if c not in strata]
    measure = F.median if how == "median" else F.avg
    keys = [col(k) for k in strata]
    counts = []
    if compute_object_count:
        known = F.lit(True)
        for k in keys:
            known = known & k.isNotNull()
        counts = [F.count(F.when(known, col(object_feature))).alias("Metadata_Object_Count")]
    names = ["Metadata_Object_Count"] * len(counts)
    width, profiles = CHUNK, None
    if how == "median" and features:
        needed = list(dict.fromkeys([*strata, *features, *([object_feature] if counts else [])]))
        most, large, profiles = _large_medians(population_df.select(*[col(c) for c in needed]), strata, features, counts, names)
        width = max(1, min(CHUNK, CELLS // (most or 1)))
        if large is not None:
            population_df = null_safe(population_df, F.broadcast(large), strata, "leftanti") if most else None
    out = None
    if population_df is not None:
        pieces = [features[i : i + width] for i in range(0, len(features), width)] or [[]]
        for i, piece in enumerate(pieces):
            one = population_df.groupBy(*keys).agg(*(counts if i == 0 else []), *[measure(number(c)).alias(c) for c in piece])
            out = one if out is None else null_safe(out, one, strata, "inner")
    if profiles is not None:
        out = profiles if out is None else out.unionByName(profiles)
    if compute_object_count:
        any_null = F.lit(False)
        for k in strata:
            any_null = any_null | col(k).isNull()
        out = out.withColumn("Metadata_Object_Count", F.when(~any_null, F.col("Metadata_Object_Count")))
    return out.drop("ImageNumber", "ObjectNumber")
