"""Image-level columns: counts of fields of view and objects, and aggregated image features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phenolith.functions.exprs import col
from phenolith.functions.schema import METADATA
from phenolith.operators.aggregate import aggregate, null_safe


def check_image_features(categories: Sequence[str], columns: Sequence[str]) -> None:
    """Every category must be the first part of a column's name, behind ``Image_`` where that is used."""
    labelled = any(c.split("_")[0] == "Image" for c in columns)
    have = {c.split("_")[1] if labelled else c.split("_")[0] for c in columns if not labelled or "_" in c}
    if not set(categories) <= have:
        raise ValueError(f"image features {sorted(set(categories) - have)} are not in the image table")


def extract_image_features(categories: Sequence[str], image: DataFrame, image_cols: Sequence[str], strata: Sequence[str]) -> DataFrame:
    """Keys and the image columns of the categories: counts as metadata, the others behind ``Image_``."""
    check_image_features(categories, image.columns)
    keys = sorted({*image_cols, *strata})
    new = {}
    for c in image.columns:
        if c.startswith(tuple(categories)):
            new[c] = METADATA + c if c.startswith("Count_") else c if c.startswith("Image_") else f"Image_{c}"
    return image.select(*[col(c) for c in keys], *[col(c).alias(n) for c, n in new.items() if c not in keys])


def count_fields(image: DataFrame, strata: Sequence[str], field: str = "Metadata_Site") -> DataFrame:
    """Fields of view of each stratum; strata with null keys are left out."""
    known = F.lit(True)
    for k in strata:
        known = known & col(k).isNotNull()
    return image.filter(known).groupBy(*[col(k) for k in strata]).agg(F.count(col(field)).alias("Metadata_Site_Count"))


def add_counts(df: DataFrame, image_features: DataFrame, image_cols: Sequence[str], strata: Sequence[str], count_prefix: str = "Count") -> tuple[DataFrame, list[str]]:
    """``df`` with each stratum's summed counts, and the image columns that are then done with."""
    counts = [c for c in image_features.columns if c.startswith(METADATA + count_prefix)]
    total = image_features.groupBy(*[col(k) for k in strata]).agg(*[F.coalesce(F.sum(col(c)), F.lit(0)).alias(c) for c in counts]) if counts else image_features.select(*[col(k) for k in strata]).distinct()
    return null_safe(df, total, strata, "left"), sorted({*image_cols, *counts})


def aggregate_image_features(df: DataFrame, image_features: DataFrame, categories: Sequence[str], image_cols: Sequence[str], strata: Sequence[str], operation: str = "median", count_prefix: str = "Count") -> DataFrame:
    """``df`` with counts (if asked for) summed and the other image columns aggregated by stratum."""
    done = list(image_cols)
    if count_prefix in categories:
        df, done = add_counts(df, image_features, image_cols, strata, count_prefix)
    rest = image_features.drop(*[c for c in done if c not in strata])
    values = [c for c in rest.columns if c not in strata]
    return null_safe(df, aggregate(rest, strata=strata, features=values, operation=operation), strata, "left") if values else df
