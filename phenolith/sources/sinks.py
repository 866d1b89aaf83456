"""Writing results: a path or a DataFrame comes out of every verb."""

from __future__ import annotations

import csv
import functools
import os
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phenolith.functions.exprs import col

OUTPUT_TYPES = ("csv", "parquet", "anndata_h5ad", "anndata_zarr")


def codec(output_file: str, compression: str | dict | None) -> str | None:
    """gzip or None; without an option a .gz name decides."""
    if isinstance(compression, dict):
        compression = compression.get("method")
    if compression is None:
        return "gzip" if str(output_file).endswith(".gz") else None
    if compression != "gzip":
        raise ValueError(f"compression must be gzip or None, not {compression}")
    return compression


def _formatted(df: DataFrame, float_format: str | None) -> DataFrame:
    if not float_format:
        return df
    return df.select(*[F.format_string(float_format, col(f.name)).alias(f.name) if isinstance(f.dataType, (T.FloatType, T.DoubleType)) else col(f.name) for f in df.schema])


def write(df: DataFrame, output_file: str, output_type: str | None = "csv", compression_options: str | dict | None = None, float_format: str | None = None, sep: str = ",", mode: str = "overwrite", single_file: bool = False, partition_by: Sequence[str] = ()) -> str:
    """Write ``df`` as a folder of part files and return its path.

    ``single_file`` writes one part (through one task, for small results only);
    ``partition_by`` a folder for each value of the given columns.
    """
    output_type = output_type or "csv"
    if output_type not in OUTPUT_TYPES:
        raise ValueError(f"output_type must be one of {OUTPUT_TYPES}")
    if output_type.startswith("anndata"):
        from phenolith.sources.anndata import write_anndata

        return write_anndata(df, output_file, output_type)
    writer = (df.coalesce(1) if single_file else df).write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if output_type == "parquet":
        writer.option("compression", "snappy").parquet(str(output_file))
    else:
        out = _formatted(df.coalesce(1) if single_file else df, float_format).write.mode(mode).option("header", True).option("sep", sep).option("emptyValue", "")
        if partition_by:
            out = out.partitionBy(*partition_by)
        if (kind := codec(str(output_file), compression_options)) is not None:
            out = out.option("compression", kind)
        out.csv(str(output_file))
    return str(output_file)


def sink(verb: Callable[..., DataFrame]) -> Callable[..., DataFrame | str]:
    """Give a verb ``output_file``, ``output_type``, ``compression_options`` and ``float_format``:
    with ``output_file`` its result is written and the path returned."""

    @functools.wraps(verb)
    def run(*args, output_file: str | None = None, output_type: str | None = "csv", compression_options: str | dict | None = None, float_format: str | None = None, **kwargs):
        if output_type is not None and output_type not in OUTPUT_TYPES:
            raise ValueError(f"output_type must be one of {OUTPUT_TYPES}")
        out = verb(*args, **kwargs)
        return out if output_file is None else write(out, output_file, output_type, compression_options, float_format)

    return run


#: Samples of one GCT file: it is one transposed text matrix, so it is made on the driver.
GCT_SAMPLES = 200_000


def write_gct(profiles: DataFrame, output_file: str, features: str | Sequence[str] = "infer", meta_features: str | Sequence[str] = "infer", feature_metadata: dict[str, dict[str, str]] | None = None, version: str = "#1.3") -> str:
    """A GCT 1.3 file: features as rows, samples as columns, sample metadata above.

    ``feature_metadata`` maps names of columns to values by row id; a row ``id`` must hold
    the columns' titles.  More than ``GCT_SAMPLES`` samples are refused.
    """
    from phenolith.functions.schema import METADATA, features_of, infer_features

    if version != "#1.3":
        raise ValueError("only version #1.3 is supported")
    features = features_of(profiles, features)
    meta = infer_features(profiles, metadata=True) if meta_features == "infer" else list(meta_features)
    rows = profiles.select(*[col(c) for c in [*meta, *features]]).limit(GCT_SAMPLES + 1).collect()
    if len(rows) > GCT_SAMPLES:
        raise ValueError(f"a GCT file holds at most {GCT_SAMPLES} samples")
    if feature_metadata is None:
        titles, about = ["cp_feature_name"], {f: [f] for f in features}
    else:
        if any("id" not in values for values in feature_metadata.values()):
            raise ValueError("feature metadata needs a row id that holds the names of its columns")
        titles = [values["id"] for values in feature_metadata.values()]
        about = {f: [values.get(f) for values in feature_metadata.values()] for f in [*meta, *features]}
    text = lambda v: "" if v is None else v
    os.makedirs(os.path.dirname(os.path.abspath(output_file)), exist_ok=True)
    with open(output_file, "w", newline="", encoding="utf-8") as f:
        out = csv.writer(f, delimiter="\t")
        out.writerow([version])
        out.writerow([len(features), len(rows), len(titles), len(meta)])
        out.writerow(["id", *titles, *[f"SAMPLE_{i}" for i in range(len(rows))]])
        for j, c in enumerate([*meta, *features]):
            name = c.replace(METADATA, "") if j < len(meta) else c
            out.writerow([name, *map(text, about.get(c, [None] * len(titles))), *[text(r[j]) for r in rows]])
    return output_file
