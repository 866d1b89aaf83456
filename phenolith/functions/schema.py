"""Which columns are features and which are metadata, decided from the schema alone."""

from __future__ import annotations

import warnings
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import types as T

COMPARTMENTS = ("cells", "cytoplasm", "nuclei")
METADATA = "Metadata_"
_NESTED = (T.StructType, T.ArrayType, T.MapType, T.BinaryType, T.VariantType)


def as_list(value: str | Sequence[str]) -> list[str]:
    return [value] if isinstance(value, str) else list(value)


def check_compartments(compartments: str | Sequence[str]) -> None:
    """Warn about compartments other than the usual three."""
    other = [c for c in as_list(compartments) if c not in COMPARTMENTS]
    if other:
        warnings.warn(f"Non-canonical compartment detected: {', '.join(other)}", stacklevel=2)


def infer_features(df: DataFrame, compartments: str | Sequence[str] = ("Cells", "Nuclei", "Cytoplasm"), metadata: bool = False, image_features: bool = False) -> list[str]:
    """Feature columns by prefix, in table order; with ``metadata`` the metadata columns instead.

    Nested and binary columns are payload, not features; ``Image`` columns count only
    on demand and only if numeric.  Raises ``ValueError`` if there are none.
    """
    if metadata:
        found = [f.name for f in df.schema if f.name.startswith(METADATA)]
    else:
        prefixes = tuple(c.title() for c in as_list(compartments)) + (("Image",) if image_features else ())
        found = [f.name for f in df.schema if f.name.startswith(prefixes) and not isinstance(f.dataType, _NESTED)]
        if image_features:
            numeric = {f.name for f in df.schema if isinstance(f.dataType, (T.NumericType, T.BooleanType))}
            found = [c for c in found if not c.startswith("Image_") or c in numeric]
    if not found:
        raise ValueError("No features or metadata found. Pass them explicitly or check that columns carry compartment or Metadata_ prefixes.")
    return found


def features_of(df: DataFrame, features: str | Sequence[str], **how) -> list[str]:
    """``features`` as a list, inferred on demand."""
    if isinstance(features, str):
        if features != "infer":
            raise ValueError("features must be 'infer' or a list of column names")
        return infer_features(df, **how)
    return list(features)


def with_prefix(columns: Iterable[str], compartment: str, keep: Iterable[str] = ()) -> list[str]:
    """Columns labelled with a compartment, but for those in ``keep``, which become metadata."""
    if compartment not in ("Cells", "Cytoplasm", "Nuclei", "Image", "Barcode"):
        raise ValueError(f"unknown compartment {compartment}")
    keep = set(keep)
    return [f"{METADATA}{c}" if c in keep else f"{compartment}_{c}" for c in columns]


#: Columns that each compartment's table keeps as metadata.
KNOWN_METADATA = {
    "cells": ["Children_Cytoplasm_Count", "Children_ResizeCells_Count", "Number_Object_Number", "Parent_Nuclei", "ImageNumber", "ObjectNumber"],
    "nuclei": ["Children_Cells_Count", "Children_Cytoplasm_Count", "Children_ResizeNuclei_Count", "Neighbors_FirstClosestObjectNumber_2", "Neighbors_SecondClosestObjectNumber_2", "Number_Object_Number", "ImageNumber", "ObjectNumber"],
    "cytoplasm": ["Number_Object_Number", "Parent_Nuclei", "Parent_Cells", "ImageNumber", "ObjectNumber"],
}


def known_metadata(path: str | None = None) -> dict[str, list[str]]:
    """Metadata columns by compartment; from a tab-separated file (compartment, feature) if one is given."""
    if path is None:
        return {k: list(v) for k, v in KNOWN_METADATA.items()}
    out: dict[str, list[str]] = {}
    with open(path, encoding="utf-8") as f:
        next(f)
        for line in f:
            if line.strip():
                compartment, feature = line.rstrip("\n").split("\t")
                out.setdefault(compartment.lower(), []).append(feature)
    return out
