"""Image tables with the centres of all cells of each image, nested in one column."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phenolith.functions.exprs import col
from phenolith.sources.readers import exists, load_location_metadata, read_sqlite, session


def nested_centres(cells: DataFrame, image_key: Sequence[str], object_column: str = "ObjectNumber", x: str = "Nuclei_Location_Center_X", y: str = "Nuclei_Location_Center_Y") -> DataFrame:
    """(image key, CellCenters): a list of (ObjectNumber, X, Y) by object number."""
    one = F.struct(col(object_column).cast("long").alias(object_column), col(x).cast("double").alias(x), col(y).cast("double").alias(y))
    return cells.groupBy(*[col(k) for k in image_key]).agg(F.sort_array(F.collect_list(one)).alias("CellCenters"))


def add_cell_locations(
    metadata: str | DataFrame,
    single_cells: str | Mapping[str, DataFrame],
    augmented_metadata_output: str | None = None,
    overwrite: bool = False,
    image_column: str = "ImageNumber",
    object_column: str = "ObjectNumber",
    table_column: str = "TableNumber",
    image_key: Sequence[str] = ("Metadata_Plate", "Metadata_Well", "Metadata_Site"),
    cell_x_loc: str = "Nuclei_Location_Center_X",
    cell_y_loc: str = "Nuclei_Location_Center_Y",
) -> DataFrame:
    """``metadata`` with a column CellCenters, null for images without cells.

    ``single_cells`` is a SQLite file or tables by name, with ``Image`` and ``Nuclei``.
    With an output path the result is written there as Parquet, unless it exists
    already and ``overwrite`` is false; then what is there is read.
    """
    out_path = augmented_metadata_output
    spark = session()
    if out_path is not None and not overwrite and exists(spark, out_path):
        return spark.read.parquet(out_path)
    meta = load_location_metadata(metadata, image_key)
    keys = [table_column, image_column]
    wanted = {"Image": [*image_key, *keys], "Nuclei": [*keys, object_column, cell_x_loc, cell_y_loc]}
    tables = {}
    for name, columns in wanted.items():
        df = single_cells[name] if isinstance(single_cells, Mapping) else read_sqlite(single_cells, name)
        if missing := [c for c in columns if c not in df.columns]:
            raise ValueError(f"table {name} lacks {missing}")
        tables[name] = df.select(*[col(c).cast("string").alias(c) if c in image_key else col(c) for c in columns])
    cells = tables["Nuclei"].join(tables["Image"], keys)
    out = meta.join(nested_centres(cells, image_key, object_column, cell_x_loc, cell_y_loc), list(image_key), "left")
    out = out.select(*[col(c) for c in meta.columns], "CellCenters")
    if out_path is not None:
        out.write.mode("overwrite").parquet(out_path)
        return spark.read.parquet(out_path)
    return out
