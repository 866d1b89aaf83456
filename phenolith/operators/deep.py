"""Profiles of deep features: one NPZ archive for each site, planned from an index table."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phenolith.functions.exprs import col, is_missing
from phenolith.functions.schema import METADATA
from phenolith.operators.aggregate import aggregate, check_operation
from phenolith.operators.normalize import normalize
from phenolith.sources.readers import exists, load_index, load_npz, session
from phenolith.sources.sinks import write

LEVELS = {"site": ["Metadata_Plate", "Metadata_Well", "Metadata_Site"], "well": ["Metadata_Plate", "Metadata_Well"], "plate": ["Metadata_Plate"]}


class DeepProfiles:
    """Archives ``<folder>/<plate>/<well><delimiter><site><extension>`` of an index file's rows."""

    def __init__(self, index: str | DataFrame, folder: str, filename_delimiter: str = "_", file_extension: str = ".npz"):
        self.index = index if isinstance(index, DataFrame) else load_index(index)
        self.folder, self.delimiter = folder.rstrip("/"), filename_delimiter
        self.extension = file_extension if file_extension.startswith(".") else f".{file_extension}"

    def paths(self) -> list[str]:
        """One path an index row: an index names files, so it fits the driver."""
        rows = self.index.select("Metadata_Plate", "Metadata_Well", "Metadata_Site").distinct().orderBy("Metadata_Plate", "Metadata_Well", "Metadata_Site").collect()
        return [f"{self.folder}/{p}/{w}{self.delimiter}{s}{self.extension}" for p, w, s in rows]

    def present(self) -> list[str]:
        spark, out = session(), []
        for p in self.paths():
            if exists(spark, p):
                out.append(p)
            else:
                warnings.warn(f"{p} is missing and skipped", stacklevel=3)
        return out

    def _with_names(self, df: DataFrame) -> DataFrame:
        """Plate, well and site from each archive's path."""
        parts = F.split("_file", "/")
        stem = F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", "")
        if self.delimiter == "/":
            plate, well, site = F.element_at(parts, -3), F.element_at(parts, -2), stem
        else:
            pieces = F.split(stem, self.delimiter.replace(".", r"\.").replace("|", r"\|"))
            plate, well, site = F.element_at(parts, -2), F.element_at(pieces, -2), F.element_at(pieces, -1)
        return df.withColumns({"Metadata_Plate": plate, "Metadata_Well": well, "Metadata_Site": site})

    def rows(self, locations: bool = False, x_idx: int = 0, y_idx: int = 1) -> DataFrame:
        """All cells of all archives."""
        df = load_npz(self.present(), locations=locations, x_idx=x_idx, y_idx=y_idx)
        return self._with_names(df).drop("_file") if df.columns else df

    def single_cells(self, output_file: str | None = None, location_x_col_index: int = 0, location_y_col_index: int = 1) -> DataFrame | str:
        df = self.rows(True, location_x_col_index, location_y_col_index)
        centres = [c for c in df.columns if c.startswith("Location_Center_")]
        meta = [c for c in df.columns if c.startswith(METADATA)]
        out = df.select(*centres, *[col(c) for c in meta], *[col(c) for c in df.columns if c not in {*centres, *meta}])
        return write(out, output_file) if output_file else out

    def normalize_single_cells(self, samples: str = "all", method: str = "standardize", location_x_col_index: int = 0, location_y_col_index: int = 1, **how) -> DataFrame | str:
        df = self.single_cells(None, location_x_col_index, location_y_col_index)
        centres = [c for c in df.columns if c.startswith("Location_Center_")]
        meta = [c for c in df.columns if c.startswith(METADATA)]
        features = [c for c in df.columns if c not in {*centres, *meta}]
        return normalize(df, features=features, meta_features=[*centres, *meta], samples=samples, method=method, **how)

    def aggregate(self, aggregate_operation: str = "median", aggregate_on: str = "well", output_folder: str | None = None, output_file: str | None = None) -> DataFrame | str:
        """A profile a site, well or plate; metadata that is the same all over a group stays,
        features with a missing value are dropped."""
        check_operation(aggregate_operation)
        if aggregate_on not in LEVELS:
            raise ValueError("aggregate_on must be site, well or plate")
        strata, df = LEVELS[aggregate_on], self.rows()
        if not df.columns:
            return df
        features = [f.name for f in df.schema if isinstance(f.dataType, T.DoubleType)]
        others = [c for c in df.columns if c.startswith(METADATA) and c not in strata]
        out = aggregate(df, strata=strata, features=features, operation=aggregate_operation)
        if others:
            same = df.groupBy(*strata).agg(*[F.when(F.count_distinct(col(c)) == 1, F.first(col(c), True)).alias(c) for c in others])
            kept = same.agg(*[F.count(col(c)).alias(c) for c in others]).first()
            out = out.join(same.select(*strata, *[c for c in others if kept[c]]), strata)
        holes = out.agg(*[F.max(is_missing(out, c).cast("int")).alias(c) for c in features]).first()
        out = out.drop(*[c for c in features if holes[c]])
        meta = [c for c in out.columns if c.startswith(METADATA)]
        out = out.select(*meta, *[c for c in out.columns if c not in meta])
        if output_folder:
            write(out, output_folder, partition_by=strata)
        return write(out, output_file) if output_file else out


def deep_features(df: DataFrame) -> Sequence[str]:
    return [c for c in df.columns if not c.startswith((METADATA, "Location_Center_"))]
