"""Profiles joined with plate maps and other metadata."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phenolith.functions.exprs import col
from phenolith.functions.schema import METADATA, infer_features
from phenolith.operators.aggregate import null_safe
from phenolith.sources.readers import load_platemap, load_profiles
from phenolith.sources.sinks import sink


def prepare_external(external: DataFrame) -> DataFrame:
    """Every column that is neither metadata, a feature nor image metadata gets the prefix."""
    try:
        kept = set(infer_features(external, image_features=True))
    except ValueError:
        kept = set()
    return external.toDF(*[c if c in kept or c.startswith((METADATA, "Image_Metadata_")) else METADATA + c for c in external.columns])


#: Names that image tables give to plate, well and site.
_IMAGE_NAMES = {f"Image_Metadata_{x}": f"Metadata_{x}" for x in ("Plate", "Well", "Site")}


def clean_names(profiles: DataFrame) -> DataFrame:
    return profiles.withColumnsRenamed({a: b for a, b in _IMAGE_NAMES.items() if a in profiles.columns and b not in profiles.columns})


#: Columns of the Connectivity Map layout, and the marks of samples in it.
_SAMPLE, _KIND, _PERT = "Metadata_broad_sample", "Metadata_broad_sample_type", "Metadata_pert_type"
_ID, _ID_FORM = "Metadata_pert_id", r"(BRD[-N][A-Z0-9]+)"
_COPIES = {"Metadata_pert_iname": ("Metadata_pert_mfc_desc", "Metadata_pert_name")}
_DOSES, _VEHICLE = ("Metadata_mmoles_per_liter", "Metadata_mg_per_ml"), ("Metadata_solvent", "Metadata_pert_vehicle")
_SOLVENT, _NOTHING, _NO_GENE = "DMSO", "empty", "EMPTY"
_MODES = ("none", "chemical", "genetic")


def annotate_cmap(annotated: DataFrame, join_on: str, cell_id: str = "unknown", perturbation_mode: str = "none") -> DataFrame:
    """Columns of the Connectivity Map layout, from the sample names.

    All are expressions over the given columns, put on in one projection: identifiers in every mode, the
    kind of a sample by its name (chemical) or its gene (genetic), and for solvents a dose of 0.
    """
    if perturbation_mode not in _MODES:
        raise ValueError(f"perturbation mode must be one of {_MODES}")
    if _SAMPLE not in annotated.columns:
        raise ValueError(f"column {_SAMPLE} is needed")
    have, sample = set(annotated.columns), F.col(_SAMPLE)
    found = F.regexp_extract(sample, _ID_FORM, 1)
    rules = {_ID: F.when(found != "", found), "Metadata_pert_mfc_id": sample, "Metadata_pert_well": col(join_on), "Metadata_pert_id_vendor": F.lit("")}
    rules |= {new: F.col(old) for old, copies in _COPIES.items() if old in have for new in copies}
    rules |= {} if "Metadata_cell_id" in have else {"Metadata_cell_id": F.lit(cell_id)}
    kind = F.col(_KIND) if _KIND in have else F.lit("")
    if perturbation_mode == "chemical":
        control = sample.isNull() | (sample == _SOLVENT)
        kind = F.when(control, "control").when(sample == _NOTHING, _NOTHING).otherwise("trt")
        rules[_SAMPLE] = F.when(control, _SOLVENT).otherwise(sample)
        rules |= {c: F.when(control, F.lit(0).cast(annotated.schema[c].dataType)).otherwise(col(c)) for c in _DOSES if c in have}
        rules |= {_VEHICLE[1]: F.col(_VEHICLE[0])} if _VEHICLE[0] in have else {}
    elif perturbation_mode == "genetic" and {"Metadata_pert_iname", "Metadata_pert_name"} & have:
        gene = F.col("Metadata_pert_iname" if "Metadata_pert_iname" in have else "Metadata_pert_name")
        kind = F.when(gene == _NO_GENE, "control").otherwise("trt")
    return annotated.withColumns(rules | {_KIND: kind, _PERT: kind})


@sink
def annotate(
    profiles: str | DataFrame,
    platemap: str | DataFrame,
    join_on: str | Sequence[str] = ("Metadata_well_position", "Metadata_Well"),
    add_metadata_id_to_platemap: bool = True,
    format_broad_cmap: bool = False,
    clean_cellprofiler: bool = True,
    external_metadata: str | DataFrame | None = None,
    external_join_on: str | Sequence[str] | None = None,
    cmap_args: dict | None = None,
    platemap_sep: str | None = None,
) -> DataFrame:
    """Inner join with the plate map, then a left join with external metadata without repeated rows.

    ``join_on`` names the plate map's and the profiles' key, or one key of both.
    Columns of both sides keep the profiles' name; the plate map's get ``_platemap``,
    the external table's ``_external``.  Sides are broadcast where Spark's size limit allows.
    """
    if (external_metadata is None) != (external_join_on is None):
        raise ValueError("external_metadata and external_join_on go together")
    left_key, right_key = (join_on, join_on) if isinstance(join_on, str) else join_on
    profiles, platemap = load_profiles(profiles), load_platemap(platemap, add_metadata_id_to_platemap, platemap_sep)
    shared = (set(platemap.columns) & set(profiles.columns)) - ({left_key} if left_key == right_key else set())
    renamed = platemap.withColumnsRenamed({c: f"{c}_platemap" for c in shared})
    key = f"{left_key}_platemap" if left_key in shared else left_key
    kept = [c for c in renamed.columns if c != key]
    joined = null_safe(profiles, renamed, [right_key], "inner") if key == right_key else null_safe(profiles, renamed.withColumnRenamed(key, right_key), [right_key], "inner")
    out = joined.select(*([col(right_key)] if key == right_key else []), *[col(c) for c in kept], *[col(c) for c in profiles.columns if key != right_key or c != right_key])
    if format_broad_cmap:
        warnings.warn("format_broad_cmap is deprecated", DeprecationWarning, stacklevel=2)
        args = cmap_args or {}
        out = annotate_cmap(out, right_key, args.get("cell_id", "unknown"), args.get("perturbation_mode", "none"))
    if external_metadata is not None:
        extra = prepare_external(load_profiles(external_metadata))
        keys = [external_join_on] if isinstance(external_join_on, str) else list(external_join_on)
        clash = (set(extra.columns) & set(out.columns)) - set(keys)
        extra = extra.withColumnsRenamed({c: f"{c}_external" for c in clash})
        out = null_safe(out, extra, keys, "left").dropDuplicates()
    if clean_cellprofiler:
        out = clean_names(out)
    meta = infer_features(out, metadata=True)
    return out.select(*[col(c) for c in meta], *[col(c) for c in out.columns if c not in set(meta)])
