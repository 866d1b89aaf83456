"""Command line: ``python -m phenolith.cli <verb> PROFILES OUTPUT [options]`` (or under spark-submit)."""

from __future__ import annotations

import argparse
import json
from collections.abc import Sequence

from pyspark.sql import SparkSession


def listed(text: str) -> list[str]:
    """Comma-separated names; a JSON list is taken too."""
    if text.strip().startswith("["):
        return [str(x) for x in json.loads(text)]
    return [x.strip() for x in text.split(",") if x.strip()]


def infer_or_list(text: str) -> str | list[str]:
    return "infer" if text == "infer" else listed(text)


def one_or_list(text: str) -> str | list[str]:
    found = listed(text)
    return found[0] if len(found) == 1 else found


def _flag(p: argparse.ArgumentParser, *names: str) -> None:
    for n in names:
        p.add_argument(f"--{n}", action=argparse.BooleanOptionalAction, default=None)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="phenolith")
    verbs = top.add_subparsers(dest="verb", required=True)

    def verb(name: str, *extra: tuple[str, type]) -> argparse.ArgumentParser:
        p = verbs.add_parser(name)
        p.add_argument("profiles")
        p.add_argument("output_file")
        p.add_argument("--output_type", choices=["csv", "parquet", "anndata_h5ad", "anndata_zarr"])
        p.add_argument("--compression_options")
        p.add_argument("--float_format")
        for flag, kind in extra:
            p.add_argument(f"--{flag}", type=kind)
        return p

    p = verb("aggregate", ("strata", listed), ("features", infer_or_list), ("operation", str), ("object_feature", str), ("subset_data_file", str))
    _flag(p, "image_features", "compute_object_count")
    p = verb("annotate", ("join_on", listed), ("external_metadata", str), ("external_join_on", listed), ("platemap_sep", str))
    p.add_argument("--platemap", required=True)
    _flag(p, "add_metadata_id_to_platemap", "format_broad_cmap", "clean_cellprofiler")
    p = verb("normalize", ("features", infer_or_list), ("meta_features", infer_or_list), ("samples", str), ("method", str), ("mad_robustize_epsilon", float), ("spherize_method", str), ("spherize_epsilon", float), ("inverse_normal_n_quantiles", int))
    _flag(p, "image_features", "drop_cosmicqc_rows", "spherize_center")
    p = verb("feature_select", ("features", infer_or_list), ("samples", str), ("operation", listed), ("na_cutoff", float), ("corr_threshold", float), ("corr_method", str), ("freq_cut", float), ("unique_cut", float), ("blocklist", one_or_list), ("blocklist_name", one_or_list), ("blocklist_file", str), ("outlier_cutoff", float), ("noise_removal_perturb_groups", one_or_list), ("noise_removal_stdev_cutoff", float), ("min_variance", float))
    _flag(p, "image_features")
    verb("consensus", ("replicate_columns", listed), ("operation", str), ("features", infer_or_list), ("modz_method", str))
    p = verbs.add_parser("collate")
    p.add_argument("folder")
    p.add_argument("plate")
    p.add_argument("output_folder")
    p.add_argument("--tables", type=listed, default=["Image", "Cells", "Cytoplasm", "Nuclei"])
    p = verbs.add_parser("cell_locations")
    p.add_argument("metadata")
    p.add_argument("single_cells")
    p.add_argument("output_file")
    _flag(p, "overwrite")
    return top


def main(argv: Sequence[str] | None = None) -> str:
    args = {k: v for k, v in vars(parser().parse_args(argv)).items() if v is not None}
    SparkSession.builder.appName("phenolith").getOrCreate()
    name = args.pop("verb")
    if name == "collate":
        from phenolith.sources.readers import collate, collated

        path = args["output_folder"]
        if path.endswith(".sqlite"):
            collate(args["folder"], args["plate"], path, args["tables"])
        else:
            for table, df in collated(args["folder"], args["plate"], args["tables"]).items():
                df.write.mode("overwrite").parquet(f"{path}/{table}.parquet")
    elif name == "cell_locations":
        from phenolith.operators.locations import add_cell_locations

        add_cell_locations(args["metadata"], args["single_cells"], args["output_file"], overwrite=args.get("overwrite", False))
        path = args["output_file"]
    else:
        path = _verb(name, args)
    print(path)
    return path


def _verb(name: str, args: dict) -> str:
    from phenolith.operators.aggregate import aggregate
    from phenolith.operators.annotate import annotate
    from phenolith.operators.consensus import consensus
    from phenolith.operators.normalize import normalize
    from phenolith.operators.select import feature_select
    from phenolith.sources.readers import load_profiles

    profiles = load_profiles(args.pop("profiles"))
    if name == "annotate":
        keys = args.get("join_on")
        if keys is not None and len(keys) != 2:
            raise SystemExit("join_on needs two column names")
        return annotate(profiles, args.pop("platemap"), **args)
    if name == "aggregate" and (file := args.pop("subset_data_file", None)):
        args["subset_data_df"] = load_profiles(file)
    if name == "consensus" and (method := args.pop("modz_method", None)):
        args["modz_args"] = {"method": method}
    return {"aggregate": aggregate, "normalize": normalize, "feature_select": feature_select, "consensus": consensus}[name](profiles, **args)


if __name__ == "__main__":
    main()
