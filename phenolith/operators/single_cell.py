"""Single cells in several compartment tables: counting, sampling, aggregating and merging them."""

from __future__ import annotations

import os
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phenolith.functions.exprs import col, unique_name
from phenolith.functions.ranks import repeatable_rank
from phenolith.functions.schema import COMPARTMENTS, METADATA, infer_features
from phenolith.operators.aggregate import aggregate, check_operation, null_safe
from phenolith.operators.annotate import annotate
from phenolith.operators.images import aggregate_image_features, count_fields, extract_image_features
from phenolith.operators.normalize import normalize
from phenolith.sources.readers import read_sqlite, sqlite_columns
from phenolith.sources.sinks import write

#: How objects of one compartment name those of another.
LINKS = {"cytoplasm": {"cells": "Cytoplasm_Parent_Cells", "nuclei": "Cytoplasm_Parent_Nuclei"}, "cells": {"cytoplasm": "ObjectNumber"}, "nuclei": {"cytoplasm": "ObjectNumber"}}


def check_links(links: Mapping[str, Mapping[str, str]] = LINKS, compartments: Sequence[str] = COMPARTMENTS) -> None:
    """Links must go both ways between known compartments and reach every one of them."""
    if not isinstance(links, Mapping):
        raise ValueError("links must be a mapping")
    if not isinstance(compartments, (list, tuple)):
        raise ValueError("compartments must be a list")
    for a, others in links.items():
        for b in others:
            if a not in compartments or b not in compartments:
                raise ValueError(f"compartment {a if a not in compartments else b} not found; check the compartments")
            if a not in links.get(b, {}):
                raise ValueError(f"{a} links to {b} but not back")
    if len(compartments) > 1 and (alone := [c for c in compartments if c not in links]):
        raise ValueError(f"compartments {alone} are linked with nothing")


def link_names(links: Mapping[str, Mapping[str, str]] = LINKS) -> dict[str, str]:
    """Linking columns and what they are called in a merged table."""
    return {c: c if c.startswith(METADATA) else METADATA + c for others in links.values() for c in others.values()}


def sample_fraction(df: DataFrame, strata: Sequence[str], fraction: float, seed: int) -> DataFrame:
    """Exactly round(fraction * rows) rows of each stratum, without replacement; a rerun draws the same."""
    keys = [col(k) for k in strata]
    place, size = (unique_name(x, df.columns) for x in ("_place", "_size"))
    sizes = df.groupBy(*keys).agg(F.count("*").alias(size))
    ranked = null_safe(repeatable_rank(df, keys, seed, place), sizes, strata, "inner")
    return ranked.filter(F.col(place) <= F.bround(F.col(size) * fraction)).select(*[col(c) for c in df.columns])


def sample_number(df: DataFrame, strata: Sequence[str], n: int, seed: int) -> DataFrame:
    """n rows of each stratum, with replacement; a rerun draws the same."""
    keys = [col(k) for k in strata]
    place, size, draw = (unique_name(x, df.columns) for x in ("_place", "_size", "_draw"))
    sizes = df.groupBy(*keys).agg(F.count("*").alias(size)).withColumn(draw, F.explode(F.sequence(F.lit(1), F.lit(n))))
    drawn = sizes.select(*keys, (F.pmod(F.xxhash64(F.lit(seed), *keys, F.col(draw)), F.col(size)) + 1).alias(place))
    return null_safe(repeatable_rank(df, keys, seed, place), drawn, [*strata, place], "inner").select(*[col(c) for c in df.columns])


class SingleCells:
    """Compartment tables of a SQLite file, a folder of Parquet tables, or DataFrames by name.

    Every method gives a lazy DataFrame; joins between compartments, images, counts
    and samples make one plan.
    """

    def __init__(
        self,
        source: str | Mapping[str, DataFrame],
        strata: Sequence[str] = ("Metadata_Plate", "Metadata_Well"),
        aggregation_operation: str = "median",
        output_file: str | None = None,
        compartments: Sequence[str] = COMPARTMENTS,
        compartment_linking_cols: Mapping[str, Mapping[str, str]] | None = None,
        merge_cols: Sequence[str] = ("TableNumber", "ImageNumber"),
        image_cols: Sequence[str] = ("TableNumber", "ImageNumber", "Metadata_Site"),
        add_image_features: bool = False,
        image_feature_categories: Sequence[str] | None = None,
        features: str | Sequence[str] = "infer",
        load_image_data: bool = True,
        image_table_name: str = "image",
        subsample_frac: float = 1.0,
        subsample_n: str | int = "all",
        subsampling_random_state: int | None = None,
        fields_of_view: str | Sequence[int] = "all",
        fields_of_view_feature: str = "Metadata_Site",
        object_feature: str = "Metadata_ObjectNumber",
        default_datatype_float: str = "double",
    ):
        check_operation(aggregation_operation)
        if not 0 < subsample_frac <= 1:
            raise ValueError("subsample_frac must be between 0 and 1")
        if subsample_n != "all":
            subsample_n = int(subsample_n)
            if subsample_n < 1:
                raise ValueError("subsample_n must be positive")
        if subsample_frac < 1 and subsample_n != "all":
            raise ValueError("set subsample_frac or subsample_n, not both")
        if add_image_features and not image_feature_categories:
            raise ValueError("add_image_features needs image_feature_categories")
        self.links = LINKS if compartment_linking_cols is None else compartment_linking_cols
        check_links(self.links, list(compartments))
        self.source, self.strata, self.operation, self.output_file = source, list(strata), aggregation_operation, output_file
        self.compartments, self.merge_cols, self.image_cols = list(compartments), list(merge_cols), list(image_cols)
        self.add_image_features, self.categories = add_image_features, list(image_feature_categories or [])
        self.features, self.image_table_name = features, image_table_name
        self.subsample_frac, self.subsample_n = subsample_frac, subsample_n
        self.seed = int.from_bytes(os.urandom(2), "big") % 10_000 if subsampling_random_state is None else int(subsampling_random_state)
        self.fields_of_view, self.fields_of_view_feature, self.object_feature = fields_of_view, fields_of_view_feature, object_feature
        self.float = default_datatype_float
        self._image: DataFrame | None = None
        if load_image_data:
            self.load_image()

    def table(self, name: str, columns: Sequence[str] | None = None) -> DataFrame:
        if isinstance(self.source, Mapping):
            df = self.source[name]
        elif os.path.isdir(self.source):
            from phenolith.sources.readers import session

            df = session().read.parquet(f"{self.source}/{name}.parquet")
        else:
            return read_sqlite(self.source, name, columns)
        return df if columns is None else df.select(*[col(c) for c in columns])

    def columns(self, name: str) -> list[str]:
        sqlite = isinstance(self.source, str) and not os.path.isdir(self.source)
        return list(sqlite_columns(self.source, name)) if sqlite else self.table(name).columns

    def load_image(self, image_table_name: str | None = None) -> DataFrame:
        """Image keys (and image features) of the chosen fields of view."""
        name = image_table_name or self.image_table_name
        keys = sorted({*self.image_cols, *self.strata})
        image = self.table(name) if self.add_image_features else self.table(name, [c for c in keys if c in self.columns(name)])
        if self.fields_of_view != "all":
            wanted = list(self.fields_of_view)
            have = {r[0] for r in image.select(col(self.fields_of_view_feature)).filter(col(self.fields_of_view_feature).isin(wanted)).distinct().collect()}
            if missing := [f for f in wanted if f not in have]:
                raise ValueError(f"fields of view {missing} are not in the image table")
            image = image.filter(col(self.fields_of_view_feature).isin(wanted))
        self._full_image = image
        self._image = extract_image_features(self.categories, image, self.image_cols, self.strata) if self.add_image_features else image
        return self._image

    @property
    def image(self) -> DataFrame:
        return self._image if self._image is not None else self.load_image()

    def _keys(self) -> DataFrame:
        return self.image.select(*[col(c) for c in sorted({*self.image_cols, *self.strata}) if c in self.image.columns])

    def load_compartment(self, compartment: str) -> DataFrame:
        """A compartment's table, keys first; its features as ``default_datatype_float``."""
        names = self.columns(compartment)
        features = [c for c in names if c.lower().startswith(compartment.lower()) and c not in set(link_names(self.links))]
        if self.features != "infer":
            features = [c for c in features if c in set(self.features)]
        meta = [c for c in names if not c.lower().startswith(compartment.lower()) or c in set(link_names(self.links))]
        df = self.table(compartment, [*meta, *features])
        return df.select(*[col(c) for c in meta], *[col(c).cast(self.float).alias(c) for c in features])

    def _objects(self, compartment: str) -> DataFrame:
        return self.load_compartment(compartment).join(F.broadcast(self._keys()) if isinstance(self.source, str) and not os.path.isdir(self.source) else self._keys(), self.merge_cols)

    def count_cells(self, compartment: str = "cells", count_subset: bool = False) -> DataFrame:
        """Objects of each stratum: of the sample, else from the image table's counts, else counted."""
        keys = [col(k) for k in self.strata]
        if count_subset:
            return self.subsample(compartment).groupBy(*keys).agg(F.count("*").alias("cell_count"))
        count = f"Count_{compartment.title()}"
        if count in self.columns(self.image_table_name):
            own = self.table(self.image_table_name, [*self.merge_cols, count])
            return self._keys().join(own, self.merge_cols).groupBy(*keys).agg(F.sum(count).alias("cell_count"))
        return self.table(compartment, self.merge_cols).join(self._keys(), self.merge_cols).groupBy(*keys).agg(F.count("*").alias("cell_count"))

    def _sampled(self) -> bool:
        return self.subsample_frac < 1 or self.subsample_n != "all"

    def subsample(self, compartment: str = "cells") -> DataFrame:
        """Keys of the sampled objects of a compartment, a row each draw."""
        rows = self.table(compartment, [*self.merge_cols, "ObjectNumber"]).join(self._keys(), self.merge_cols)
        if not self._sampled():
            return rows
        return sample_fraction(rows, self.strata, self.subsample_frac, self.seed) if self.subsample_n == "all" else sample_number(rows, self.strata, self.subsample_n, self.seed)

    def aggregate_compartment(self, compartment: str, compute_subsample: bool = False, compute_counts: bool = False, add_image_features: bool = False) -> DataFrame:
        """A profile a stratum of one compartment; sampled, counted, and with image features on demand."""
        objects = self._objects(compartment)
        if compute_subsample and self._sampled():
            chosen = self.subsample(compartment).select(*[col(c) for c in [*self.merge_cols, "ObjectNumber"]])
            objects = objects.join(chosen, [*self.merge_cols, "ObjectNumber"])
        objects = objects.withColumnsRenamed({a: b for a, b in link_names(self.links).items() if a in objects.columns})
        features = infer_features(objects, [compartment])
        if self.features != "infer":
            features = [c for c in features if c in set(self.features)]
        out = aggregate(objects, strata=self.strata, features=features, operation=self.operation, compute_object_count=compute_counts, object_feature=self.object_feature)
        if compute_counts and self.fields_of_view_feature in self.image.columns:
            sites = count_fields(self._keys().dropDuplicates(), self.strata, self.fields_of_view_feature)
            out = null_safe(out, sites, self.strata, "left")
        if add_image_features:
            out = aggregate_image_features(out, self.image, self.categories, self.image_cols, self.strata, self.operation)
        meta = infer_features(out, metadata=True)
        first = [*self.strata, *[c for c in meta if c not in self.strata]]
        return out.select(*[col(c) for c in first], *[col(c) for c in out.columns if c not in set(first)])

    def aggregate_profiles(self, compute_subsample: bool = False, output_file: str | None = None, **how) -> DataFrame | str:
        """Profiles of all compartments side by side, joined on strata."""
        out = None
        for i, c in enumerate(self.compartments):
            one = self.aggregate_compartment(c, compute_subsample, compute_counts=i == 0, add_image_features=self.add_image_features and i == 0)
            out = one if out is None else null_safe(out, one, self.strata, "inner")
        path = output_file or self.output_file
        return write(out, path, **how) if path else out

    def _order(self) -> list[tuple[str, str, str, str]]:
        """Links to join over, each compartment reached once: (have, new, column of have, column of new)."""
        have, out = [self._root()], []
        while len(have) < len(self.compartments):
            step = next(((a, b) for a in have for b in self.links.get(a, {}) if b not in have), None)
            if step is None:
                raise ValueError("compartments are not connected by links")
            out.append((*step, self.links[step[0]][step[1]], self.links[step[1]][step[0]]))
            have.append(step[1])
        return out

    def _root(self) -> str:
        return max(self.compartments, key=lambda c: len(self.links.get(c, {})))

    def merge_single_cells(self, compute_subsample: bool = False, single_cell_normalize: bool = False, normalize_args: dict | None = None, platemap: str | DataFrame | None = None, annotate_args: dict | None = None, output_file: str | None = None, **how) -> DataFrame | str:
        """A row a cell: compartments joined over their links, then image keys; normalized and annotated on demand."""

        def named(c: str) -> DataFrame:
            df = self.load_compartment(c)
            return df.withColumnsRenamed({x: f"{METADATA}{x}_{c}" for x in df.columns if x not in self.merge_cols and not x.lower().startswith(c.lower()) and x not in set(link_names(self.links)) - {"ObjectNumber"}})

        def key(c: str, x: str) -> str:
            return f"{METADATA}ObjectNumber_{c}" if x == "ObjectNumber" else x

        out = named(self._root())
        for have, new, x, y in self._order():
            other = named(new).withColumnsRenamed({m: f"_{m}" for m in self.merge_cols})
            on = [col(m).eqNullSafe(col(f"_{m}")) for m in self.merge_cols] + [col(key(have, x)) == col(key(new, y))]
            cond = on[0]
            for o in on[1:]:
                cond = cond & o
            out = out.join(other, cond).drop(*[f"_{m}" for m in self.merge_cols])
        if compute_subsample and self._sampled():
            c = "cells" if "cells" in self.compartments else self.compartments[0]
            drawn = self.subsample(c).select(*[col(m) for m in self.merge_cols], col("ObjectNumber").alias(key(c, "ObjectNumber")))
            out = drawn.join(out, [*self.merge_cols, key(c, "ObjectNumber")], "left")
        out = out.join(self.image, self.merge_cols, "left")
        out = out.withColumnsRenamed({x: y for x, y in link_names(self.links).items() if x in out.columns} | {m: METADATA + m for m in self.merge_cols})
        meta = [c for c in out.columns if c.startswith(METADATA)]
        out = out.select(*[col(c) for c in meta], *[col(c) for c in out.columns if c not in set(meta)])
        if single_cell_normalize:
            args = dict(normalize_args or {})
            args.setdefault("features", infer_features(out, self.compartments))
            out = normalize(out, **args)
        if platemap is not None:
            out = annotate(out, platemap, **(annotate_args or {}))
        path = output_file or self.output_file
        return write(out, path, **how) if path else out
