"""The five verbs on small frames with known results."""

import importlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from phenolith import aggregate, annotate, consensus, feature_select, normalize
from phenolith.functions.exprs import predicate
from phenolith.functions.linalg import correlation, tau_b, triangle
from phenolith.functions.schema import infer_features, with_prefix
from phenolith.operators.consensus import modz_profile
from phenolith.operators.normalize import Quantiles, fit_spherize, inverse_normal
from phenolith.operators.select import correlation_threshold, count_na, frequency_threshold, na_columns, noise_removal, outlier_features, variance_threshold
from phenolith.operators.single_cell import sample_fraction, sample_number


@pytest.fixture(scope="module")
def cells(spark):
    return spark.createDataFrame([("a", 1, 2.0, 6.0), ("a", 2, 9.0, 4.0), ("a", 3, 4.0, 11.0), ("b", 4, 7.0, 1.0), ("b", 5, 2.0, 9.0), ("b", 6, 6.0, 2.0)], "g string, Metadata_ObjectNumber long, Cells_x double, Nuclei_y double")


def rows(df, by):
    return [tuple(r) for r in df.orderBy(F.col(by).asc_nulls_last()).collect()]


def test_aggregate(cells):
    assert rows(aggregate(cells, strata=["g"]), "g") == [("a", 4, 6), ("b", 6, 2)]
    assert rows(aggregate(cells, strata=["g"], operation="MEAN"), "g") == [("a", 5, 7), ("b", 5, 4)]
    counted = aggregate(cells, strata=["g"], compute_object_count=True)
    assert counted.columns == ["g", "Metadata_Object_Count", "Cells_x", "Nuclei_y"]
    assert [r[1] for r in rows(counted, "g")] == [3, 3]
    with pytest.raises(ValueError):
        aggregate(cells, strata=["g"], operation="mode")


def test_aggregate_missing_and_null_strata(spark):
    df = spark.createDataFrame([("a", "1", float("nan")), ("a", "nan", 2.0), ("a", "3", 4.0), (None, "5", None)], "g string, Cells_x string, Cells_y double")
    out = rows(aggregate(df, strata=["g"], compute_object_count=True, object_feature="Cells_x"), "g")
    assert out == [("a", 3, 2.0, 3.0), (None, None, 5.0, None)]


def test_aggregate_subset_multiplicity(spark, cells):
    twice = spark.createDataFrame([(1,), (1,), (3,)], "Metadata_ObjectNumber long")
    assert rows(aggregate(cells, strata=["g"], operation="mean", subset_data_df=twice), "g") == [("a", pytest.approx(8 / 3), pytest.approx(23 / 3))]


def test_aggregate_wide_pieces(spark, monkeypatch):
    from phenolith.operators import aggregate as module

    monkeypatch.setattr(module, "CHUNK", 2)
    df = spark.createDataFrame([("a", *map(float, range(5))), (None, *map(float, range(5)))], "g string, " + ", ".join(f"Cells_{i} double" for i in range(5)))
    assert rows(aggregate(df, strata=["g"]), "g") == [("a", 0, 1, 2, 3, 4), (None, 0, 1, 2, 3, 4)]


def test_inference(spark):
    df = spark.createDataFrame([(1, 1.0, 1, "x", [1], 1.0, "m")], "Cells_a int, Nuclei_b double, CElls_c int, Image_name string, Cells_list array<int>, Image_num double, Metadata_m string")
    assert infer_features(df) == ["Cells_a", "Nuclei_b"]
    assert infer_features(df, image_features=True) == ["Cells_a", "Nuclei_b", "Image_num"]
    assert infer_features(df, metadata=True) == ["Metadata_m"]
    assert infer_features(df, ["cells"]) == ["Cells_a"]
    with pytest.raises(ValueError):
        infer_features(df.select("CElls_c"))
    assert with_prefix(["a", "k"], "Nuclei", ["k"]) == ["Nuclei_a", "Metadata_k"]


def test_predicate(spark):
    df = spark.createDataFrame([("a", 1.0, 1), (None, 2.0, 2), ("b", float("nan"), 3)], "Metadata_t string, x double, `odd name` int")
    kept = lambda q: [r["odd name"] for r in df.filter(predicate(df, q)).collect()]
    assert kept("Metadata_t == 'a'") == [1]
    assert kept("Metadata_t != 'a'") == [2, 3]
    assert kept("x > 0 & `odd name` <= 2 | Metadata_t == 'b'") == [1, 2, 3]
    assert kept("Metadata_t in ['a', 'b'] and not x > 5") == [1, 3]
    assert kept("Metadata_t not in ('a',)") == [2, 3]
    assert kept("0 < x < 2") == [1]
    assert kept("x.isnull()") == [3]
    assert kept("Metadata_t.str.startswith('b')") == [3]
    for bad in ("nothing == 1", "__import__('os')", "x + 1"):
        with pytest.raises(ValueError):
            kept(bad)


@pytest.fixture(scope="module")
def plate(spark):
    return spark.createDataFrame([("A01", 4, 6), ("A02", 7, 2), ("B01", 5, 9)], "Metadata_Well string, x long, y long")


def test_annotate(spark, plate):
    platemap = spark.createDataFrame([("A01", "p"), ("A02", "q"), ("B01", "r"), ("C01", "s")], "well_position string, gene string")
    out = annotate(plate, platemap)
    assert out.columns == ["Metadata_gene", "Metadata_Well", "x", "y"]
    assert rows(out, "Metadata_Well") == [("p", "A01", 4, 6), ("q", "A02", 7, 2), ("r", "B01", 5, 9)]
    extra = spark.createDataFrame([("p", "one"), ("p", "one"), ("q", "two")], "gene string, pathway string")
    out = annotate(plate, platemap, external_metadata=extra, external_join_on="Metadata_gene")
    assert [r.Metadata_pathway for r in out.orderBy("Metadata_Well").collect()] == ["one", "two", None]
    with pytest.raises(ValueError):
        annotate(plate, platemap, external_metadata=extra)


def test_annotate_collisions_and_names(spark, plate):
    df = plate.withColumns({"Metadata_gene": F.lit("own"), "Image_Metadata_Plate": F.lit("P")})
    platemap = spark.createDataFrame([("A01", "p")], "Metadata_Well string, Metadata_gene string")
    out = annotate(df, platemap, join_on="Metadata_Well")
    assert set(out.columns) == {"Metadata_Well", "Metadata_gene_platemap", "Metadata_gene", "Metadata_Plate", "x", "y"}
    assert out.first().Metadata_gene_platemap == "p" and out.first().Metadata_gene == "own"


def test_cmap_modes(spark, plate):
    samples = spark.createDataFrame([("A01", "BRD-K1234-001", "x"), ("A02", None, "EMPTY"), ("B01", "empty", "y")], "Metadata_Well string, Metadata_broad_sample string, Metadata_pert_iname string")
    out = {r.Metadata_Well: r for r in annotate(plate, samples, join_on="Metadata_Well", format_broad_cmap=True, cmap_args={"perturbation_mode": "chemical"}).collect()}
    assert out["A01"].Metadata_pert_id == "BRD-K1234" and out["A02"].Metadata_pert_id is None
    assert [out[w].Metadata_pert_type for w in ("A01", "A02", "B01")] == ["trt", "control", "empty"]
    out = {r.Metadata_Well: r for r in annotate(plate, samples, join_on="Metadata_Well", format_broad_cmap=True, cmap_args={"perturbation_mode": "genetic"}).collect()}
    assert out["A02"].Metadata_pert_type == "control" and out["A01"].Metadata_pert_type == "trt"


@pytest.fixture(scope="module")
def drugs(spark):
    data = pd.DataFrame({"Metadata_plate": ["a"] * 8, "Metadata_treatment": ["drug"] * 4 + ["control"] * 4, "Cells_x": [2, 9, 4, 4, 7, 7, 7, 3], "Cytoplasm_y": [6, 2, 8, 5, 4, 11, 9, 2], "Nuclei_z": [3, 11, 7, 2, 15, 4, 4, 9], "Nuclei_c": [4.0] * 8})
    return spark.createDataFrame(data), data


def test_standardize(drugs):
    df, data = drugs
    out = normalize(df).toPandas()
    x = data[["Cells_x", "Cytoplasm_y", "Nuclei_z"]]
    assert np.allclose(out[x.columns], (x - x.mean()) / x.std(ddof=0))
    assert (out.Nuclei_c == 0).all() and list(out.columns) == list(data.columns)
    again = normalize(normalize(df)).toPandas()
    assert np.allclose(again[x.columns], out[x.columns])


def test_robust_methods_on_controls(drugs):
    df, data = drugs
    names = ["Cells_x", "Cytoplasm_y", "Nuclei_z"]
    x, ref = data[names], data[data.Metadata_treatment == "control"][names]
    out = normalize(df, samples="Metadata_treatment == 'control'", method="robustize", features=names).toPandas()
    spread = (ref.quantile(0.75) - ref.quantile(0.25)).replace(0, 1)
    assert np.allclose(out[names], (x - ref.median()) / spread)
    out = normalize(df, method="mad_robustize").toPandas()
    mad = (x - x.median()).abs().median() * 1.4826
    assert np.allclose(out[names], (x - x.median()) / mad) and (out.Nuclei_c == 0).all()
    zero = normalize(df, method="mad_robustize", mad_robustize_epsilon=0, features=["Nuclei_c"]).toPandas()
    assert zero.Nuclei_c.isna().all()
    with pytest.raises(ValueError):
        normalize(df, method="mad_robustize", mad_robustize_epsilon=None)
    with pytest.raises(ValueError):
        normalize(df, method="other")


def test_qc_tokens_and_payload(spark):
    df = spark.createDataFrame([("A01", False, 1.0, " NaN", (1,)), ("A02", True, 9.0, "7", (2,)), ("A03", None, 2.0, "1", (3,)), ("A04", False, 3.0, "3", (4,))], "Metadata_Well string, Metadata_cqc_x boolean, Cells_x double, Nuclei_y string, ome_arrow_a struct<v:int>")
    out = normalize(df, drop_cosmicqc_rows=True).orderBy("Metadata_Well").toPandas()
    assert list(out.Metadata_Well) == ["A01", "A03", "A04"] and np.allclose(out.Cells_x, [-1.224744871, 0, 1.224744871])
    assert math.isnan(out.Nuclei_y[0]) and np.allclose(out.Nuclei_y[1:], [-1, 1]) and out.ome_arrow_a[0].v == 1
    with pytest.raises(ValueError, match="Nuclei_y"):
        normalize(df.withColumn("Nuclei_y", F.lit("abc")))
    with pytest.raises(ValueError):
        normalize(df.drop("Metadata_cqc_x"), drop_cosmicqc_rows=True)


@pytest.mark.parametrize("method", ["PCA", "ZCA", "PCA-cor", "ZCA-cor"])
def test_spherize_whitens(spark, method):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 4)) @ rng.normal(size=(4, 4)) + 5
    df = spark.createDataFrame(pd.DataFrame(x, columns=[f"Cells_{i}" for i in range(4)]).assign(Metadata_id=range(200)))
    out = normalize(df, method="spherize", spherize_method=method, spherize_svd_on="transformed", spherize_epsilon=0).drop("Metadata_id").toPandas()
    assert np.allclose(np.cov(out.T), np.eye(4), atol=1e-8)
    assert list(out.columns) == ([f"PC{i}" for i in range(1, 5)] if method.startswith("PCA") else [f"Cells_{i}" for i in range(4)])
    for n in (2, 150):  # few rows a task, and more tasks than rows in a block: the decomposition is the same
        again = fit_spherize(df.repartition(n), [f"Cells_{i}" for i in range(4)], method=method).weight
        assert np.allclose(np.abs(again), np.abs(fit_spherize(df, [f"Cells_{i}" for i in range(4)], method=method).weight), atol=1e-9)


def test_whitening_keeps_all_digits(spark):
    """Columns that differ in the ninth digit are told apart, whatever the number of rows, and constant ones refused."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 3))
    x[:, 1] = x[:, 0] + 1e-9 * x[:, 1]
    df = spark.createDataFrame(pd.DataFrame(x, columns=["Cells_a", "Cells_b", "Cells_c"])).repartition(7)
    got = triangle(df, df.columns)
    assert np.allclose(np.linalg.svd(got, compute_uv=False), np.linalg.svd(x, compute_uv=False), rtol=1e-6)
    assert fit_spherize(df, df.columns).weight.shape == (3, 3)


def test_spherize_errors(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 4.0, 5.0), (3.0, 6.5, 5.0)], "Cells_a double, Cells_b double, Cells_c double").withColumn("Metadata_m", F.lit(1))
    with pytest.raises(ValueError):
        normalize(df, method="spherize")
    with pytest.raises(ValueError):
        normalize(df, method="spherize", spherize_center=False)


def test_inverse_normal(spark):
    from statistics import NormalDist

    p = np.array([1e-9, 1e-4, 0.02, 0.3, 0.5, 0.7, 0.999, 1 - 1e-7])
    assert np.allclose(inverse_normal(p), [NormalDist().inv_cdf(v) for v in p], rtol=1e-12)
    out = normalize(spark.range(100).select(F.col("id").alias("Metadata_i"), F.col("id").cast("double").alias("Cells_x")), method="inverse_normal").orderBy("Metadata_i").toPandas()
    assert out.Cells_x.is_monotonic_increasing and np.isclose(out.Cells_x.iloc[0], -5.199337582605575) and np.allclose(out.Cells_x + out.Cells_x[::-1].to_numpy(), 0)
    assert np.isnan(Quantiles(np.array([[0.0], [1.0]])).array(np.array([[np.nan]]))).all()


@pytest.fixture(scope="module")
def four(spark):
    return spark.createDataFrame(pd.DataFrame({"x": [2, 7, 4, 8, 5, 5], "y": [1, 7, 4, 8, 5, 6], "z": [9, 4, 8, 8, 1, 9], "zz": [1, -4, 7, 8, 5, 9]}).astype(float).assign(g=["a", "a", "a", "b", "b", "b"]))


def test_correlation(spark, four):
    data = four.toPandas()[["x", "y", "z", "zz"]]
    for method in ("pearson", "spearman", "kendall"):
        got = correlation(four, list(data.columns), method)
        want = data.corr("pearson") if method == "pearson" else data.rank().corr("pearson") if method == "spearman" else None
        if want is not None:
            assert np.allclose(got, want)
        else:
            n = len(data)
            for i, a in enumerate(data):
                for j, b in enumerate(data):
                    s = sum(np.sign(data[a][p] - data[a][q]) * np.sign(data[b][p] - data[b][q]) for p in range(n) for q in range(p))
                    ties = [sum(data[c][p] == data[c][q] for p in range(n) for q in range(p)) for c in (a, b)]
                    assert np.isclose(got[i, j], s / np.sqrt((15 - ties[0]) * (15 - ties[1]))) or i == j
    holes = four.withColumn("x", F.when(F.col("x") < 8, F.col("x")))
    seen = holes.toPandas()[["x", "y", "z", "zz"]]
    assert np.allclose(correlation(holes, list(seen.columns)), seen.corr())
    assert np.allclose(correlation(holes, list(seen.columns), "spearman"), _spearman(seen))
    assert np.isnan(correlation(four.withColumn("k", F.lit(1.0)), ["x", "k"])[0, 1])
    assert tau_b(np.array([1.0, 1.0]), np.array([1.0, 2.0]), np.ones(2)) != tau_b(np.array([1.0, 2.0]), np.array([1.0, 2.0]), np.ones(2))


def _spearman(df):
    out = np.eye(df.shape[1])
    for i, a in enumerate(df):
        for j, b in enumerate(df):
            both = df[[a, b]].dropna().rank()
            out[i, j] = 1.0 if i == j else both[a].corr(both[b])
    return out


def test_selection_rules(spark, four):
    names = ["x", "y", "z", "zz"]
    r = four.toPandas()[names].corr()
    weight = r.abs().sum()
    for threshold in (0.9, 0.2):
        want = {max(a, b, key=lambda c: weight[c]) for a in names for b in names if a < b and r[a][b] > threshold}
        assert want and set(correlation_threshold(four, names, threshold=threshold)) == want
    spread = {c: four.toPandas().groupby("g")[c].std(ddof=0).mean() for c in names}
    assert noise_removal(four, "g", names, noise_removal_stdev_cutoff=2.5) == [c for c in names if spread[c] > 2.5]
    assert noise_removal(four, ["a"] * 3 + ["b"] * 3, names, noise_removal_stdev_cutoff=2.5) == [c for c in names if spread[c] > 2.5]
    assert outlier_features(four, names, outlier_cutoff=8.5) == ["z", "zz"]
    holes = four.withColumn("x", F.when(F.col("x") > 5, F.col("x"))).withColumn("y", F.when(F.col("y") > 1, F.col("y")).otherwise(float("nan")))
    assert na_columns(holes, names, cutoff=0.4) == ["x"] and na_columns(holes, names, cutoff=0.1) == ["x", "y"]
    assert {r.feature: r.num_na for r in count_na(holes, names).collect()} == {"x": 4, "y": 1, "z": 0, "zz": 0}
    low = spark.createDataFrame([(1.0, float(i)) for i in range(6)], "low double, high double")
    assert variance_threshold(low, ["low", "high"]) == ["low"]
    with pytest.raises(ValueError):
        variance_threshold(low, ["low"])
    with pytest.raises(ValueError):
        na_columns(four, names, cutoff=2)


def test_frequency(spark):
    df = spark.createDataFrame([(1.0 if i < 99 else 2.0, 1.0 + i % 2, float(i), None, 7.0) for i in range(100)], "a double, b double, c double, d double, e double")
    names = ["a", "b", "c", "d", "e"]
    assert frequency_threshold(df, names, freq_cut=0.05, unique_cut=0.01) == ["a", "d", "e"]
    assert frequency_threshold(df, names, freq_cut=0.0, unique_cut=0.03) == ["a", "b", "d", "e"]


def test_feature_select(spark):
    df = spark.createDataFrame([(i, float(i), float(i) * 2 + (i % 3) * 0.01, 1.0, 1000.0 * i, float(i % 4)) for i in range(12)], "Metadata_i int, Cells_a double, Cells_b double, Cells_flat double, Nuclei_big double, Nuclei_Correlation_RWC_ER_RNA double")
    out = feature_select(df, operation=["variance_threshold", "drop_outliers", "blocklist", "correlation_threshold"])
    assert out.columns[0] == "Metadata_i" and len(out.columns) == 2 and out.columns[1] in ("Cells_a", "Cells_b")
    with pytest.raises(ValueError):
        feature_select(df, operation="other")
    with pytest.raises(ValueError):
        feature_select(df, operation={})
    with pytest.raises(ValueError):
        feature_select(df, operation="noise_removal")


def test_modz(spark):
    df = spark.createDataFrame([("a", 3, 6, 4), ("a", 3, 6, 4), ("b", 7, 3, -2), ("b", 7, 3, 1), (None, 6, 8, 9)], "Metadata_g string, Cells_x long, Cytoplasm_y long, Nuclei_z long")
    out = {r.Metadata_g: tuple(r)[1:] for r in consensus(df, "Metadata_g", operation="MODZ").collect()}
    assert out["a"] == (3, 6, 4) and out["b"] == (7, 3, -0.5) and out[None] == (6, 8, 9)
    flat = np.array([[1.0, 1, 1], [1, 2, 3], [1, 2, 4]])
    assert np.allclose(modz_profile(flat, "pearson"), 0.5 * flat[1] + 0.5 * flat[2])
    opposite = np.array([[1.0, 2], [2, 1]])
    assert np.allclose(modz_profile(opposite, "pearson", min_weight=0), [1.5, 1.5])
    assert [tuple(r) for r in consensus(df, ["Metadata_g"], operation="mean").orderBy("Metadata_g").collect()][1] == ("a", 3, 6, 4)


@pytest.mark.parametrize("method", ["pearson", "spearman"])
def test_modz_of_large_groups_in_blocks(spark, monkeypatch, method):
    """Groups beyond a block are correlated block by block: no task holds a group, and the profile is that of all rows."""
    module = importlib.import_module("phenolith.operators.consensus")
    rng = np.random.default_rng(5)
    groups = {"a": rng.normal(size=(61, 6)), None: rng.normal(size=(23, 6)), "small": rng.normal(size=(7, 6)), "copies": np.tile(rng.normal(size=6), (40, 1)), "flat": np.ones((30, 6))}
    groups["a"][3, 2] = groups["a"][17] = np.nan
    df = spark.createDataFrame([(g, *map(float, r)) for g, x in groups.items() for r in x], "Metadata_g string, " + ", ".join(f"Cells_{i} double" for i in range(6))).repartition(5)
    want = {g: modz_profile(x, method) for g, x in groups.items()}
    brute = {}
    for g, x in groups.items():
        r = pd.DataFrame(x).T.corr(method=method, min_periods=2).to_numpy(copy=True)
        np.fill_diagonal(r, np.nan)
        raw = np.maximum(pd.DataFrame(np.maximum(r, 0)).mean().to_numpy(), 0.01)
        brute[g] = np.nansum(x * np.round(raw / np.nansum(raw) if np.nansum(raw) else np.full(len(x), 1 / len(x)), 4)[:, None], axis=0)
    monkeypatch.setattr(module, "BLOCK", 8)
    made = module._blocks
    called = []
    monkeypatch.setattr(module, "_blocks", lambda *a: called.append(1) or made(*a))
    got = {r.Metadata_g: np.array(tuple(r)[1:]) for r in consensus(df, "Metadata_g", operation="modz", modz_args={"method": method}).collect()}
    assert called and set(got) == set(groups)
    for g in groups:
        assert np.allclose(want[g], brute[g]) and np.allclose(got[g], want[g])


def test_partition_invariance(drugs):
    df, _ = drugs
    for n in (1, 8):
        assert np.allclose(normalize(df.repartition(n)).orderBy("Cells_x", "Nuclei_z").toPandas()["Nuclei_z"], normalize(df).orderBy("Cells_x", "Nuclei_z").toPandas()["Nuclei_z"])


def test_wide_and_narrow_transforms_agree(spark, monkeypatch):
    """A scale of 0, infinite and missing values give the same in a projection and in a map over batches."""
    module = importlib.import_module("phenolith.operators.normalize")
    df = spark.createDataFrame([(i, 4.0, None if i == 2 else float(i), math.inf if i == 3 else float(i), None) for i in range(6)], "Metadata_i int, Cells_flat double, Cells_x double, Cells_far double, Cells_none double")
    both = []
    for wide in (600, 1):
        monkeypatch.setattr(module, "WIDE", wide)
        both.append([tuple("nan" if v is not None and v != v else v for v in r) for r in normalize(df, method="mad_robustize", mad_robustize_epsilon=0).orderBy("Metadata_i").collect()])
    assert both[0] == both[1] and both[0][0][1] == "nan" and both[0][2][2] is None and both[0][3][3] == math.inf and both[0][0][4] is None


@pytest.mark.parametrize("rows", [1 << 21, 40])
def test_order_statistics(spark, monkeypatch, rows):
    """Exact percentiles by counts of leading bits, in one pass or in many, by group and with missing values."""
    module = importlib.import_module("phenolith.functions.ranks")
    monkeypatch.setattr(module, "ROWS", rows)
    monkeypatch.setattr(module, "FIRST", 12 if rows > 40 else 3)
    rng = np.random.default_rng(1)
    data = pd.DataFrame({"g": rng.integers(0, 3, 400), "a": rng.normal(size=400), "b": rng.integers(-3, 3, 400).astype(float), "c": 10 ** rng.uniform(-30, 30, 400) * rng.choice([-1, 1], 400)})
    data.loc[data.g == 2, "b"] = np.nan
    data.loc[5, "a"] = np.nan
    df = spark.createDataFrame(data).repartition(5)
    p = [0, 0.1, 0.25, 0.5, 0.77, 1]
    for key, got in module.order_statistics(df, ["a", "b", "c"], p).items():
        assert key == 0 and np.allclose(got, data[["a", "b", "c"]].quantile(p), rtol=1e-12, equal_nan=True)
    got = module.order_statistics(df, ["a", "b", "c"], p, "g")
    assert set(got) == {0, 1, 2} and all(np.allclose(got[g], data[data.g == g][["a", "b", "c"]].quantile(p), rtol=1e-12, equal_nan=True) for g in got)
    assert np.isnan(module.order_statistics(df.limit(0), ["a"], [0.5])[0]).all()


def test_medians_of_large_strata(spark, monkeypatch):
    """Strata beyond a size are counted over all tasks, and give what smaller ones give."""
    module = importlib.import_module("phenolith.operators.aggregate")
    rng = np.random.default_rng(2)
    data = pd.DataFrame({"Metadata_g": ["big"] * 200 + ["small"] * 7 + [None] * 90 + ["none"] * 80, "Cells_x": rng.normal(size=377), "Nuclei_y": rng.integers(0, 9, 377).astype(float)})
    data.loc[data.Metadata_g == "none", ["Cells_x", "Nuclei_y"]] = np.nan
    df = spark.createDataFrame(data).replace(float("nan"), None).repartition(6)
    want = sorted(map(str, aggregate(df, strata=["Metadata_g"], compute_object_count=True, object_feature="Metadata_g").collect()))
    monkeypatch.setattr(module, "LARGE", 50)
    monkeypatch.setattr(module, "CELLS", 8)
    got = aggregate(df, strata=["Metadata_g"], compute_object_count=True, object_feature="Metadata_g")
    assert sorted(map(str, got.collect())) == want and len(want) == 4


def test_samples_are_repeatable(spark):
    """The same seed draws the same rows, however they are dealt; columns of any name stay."""
    df = spark.createDataFrame([("a" if i < 70 else None if i < 90 else "b", i, i % 4, 1) for i in range(101)], "g string, _n int, _r int, _place int")
    for n in (1, 9):
        for draw, size in ((lambda d: sample_fraction(d, ["g"], 0.3, 5), {"a": 21, None: 6, "b": 3}), (lambda d: sample_number(d, ["g"], 12, 5), {"a": 12, None: 12, "b": 12})):
            rows = sorted(map(str, draw(df.repartition(n)).collect()))
            assert rows == sorted(map(str, draw(df).collect())) and draw(df).columns == df.columns
            assert {r.g: r["count"] for r in draw(df).groupBy("g").count().collect()} == size
    assert sample_fraction(df, ["g"], 0.3, 6).exceptAll(sample_fraction(df, ["g"], 0.3, 5)).count()
    assert sample_fraction(df, ["g"], 0.3, 5).distinct().count() == 30


@pytest.mark.parametrize("limit", [1 << 21, 3])
def test_spearman_with_few_and_many_values(spark, monkeypatch, four, limit):
    module = importlib.import_module("phenolith.functions.linalg")
    monkeypatch.setattr(module, "RANKS", limit)
    data = four.toPandas()[["x", "y", "z", "zz"]]
    assert np.allclose(correlation(four, list(data.columns), "spearman"), data.rank().corr())


@pytest.mark.parametrize("small, times", [(0, 1), (5, 2)])
def test_medians_of_joined_rows_make_them_once(spark, monkeypatch, small, times):
    """The passes of a median of large strata read joined rows that were made once (twice where smaller strata are there too)."""
    module, n = importlib.import_module("phenolith.operators.aggregate"), 3000
    monkeypatch.setattr(module, "LARGE", 50)
    rng = np.random.default_rng(2)
    data = pd.DataFrame({"Metadata_g": rng.choice(["a", "b", None], n), "Metadata_k": np.arange(n) % 7, "Metadata_o": 1.0, "Cells_x": rng.normal(size=n), "Cells_y": rng.normal(size=n).round(2), "Cells_none": np.nan})
    data = pd.concat([data, data.iloc[:small].assign(Metadata_g="few")])
    made = spark.sparkContext.accumulator(0)

    def counting(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    source = spark.createDataFrame(data)
    df = source.mapInArrow(counting, source.schema)
    keys = spark.createDataFrame([(i,) for i in (1, 2, 2, 5)], "Metadata_k long")
    out = aggregate(df, strata=["Metadata_g"], subset_data_df=keys, compute_object_count=True, object_feature="Metadata_o").collect()
    assert made.value == times * len(data) and not df.sparkSession._jsparkSession.sharedState().cacheManager().numCachedEntries()
    joined = data.merge(pd.DataFrame({"Metadata_k": [1, 2, 2, 5]}))
    want = joined.groupby("Metadata_g", dropna=False)[["Cells_x", "Cells_y", "Metadata_o"]].agg(lambda v: v.median() if v.name != "Metadata_o" else len(v))
    assert len(out) == len(want)
    for r in out:
        w = want[want.index.isna()].iloc[0] if r.Metadata_g is None else want.loc[r.Metadata_g]
        assert (r.Cells_x, r["Cells_y"], r.Cells_none) == (w.Cells_x, w["Cells_y"], None) and r.Metadata_Object_Count == (None if r.Metadata_g is None else w.Metadata_o)
    made.value = 0
    normalize(df, features=["Cells_x", "Cells_y"], method="mad_robustize").count()
    assert made.value <= 3 * len(data)


@pytest.mark.parametrize("block, size", [(1 << 20, 1 << 21), (600, 250)])
def test_ranks_by_ranges(spark, monkeypatch, block, size):
    """Ranks of any number of distinct values, often repeated ones among them, come from packed blocks of rows, not from a row a value."""
    ranks, linalg = (importlib.import_module(f"phenolith.functions.{m}") for m in ("ranks", "linalg"))
    monkeypatch.setattr(ranks, "BLOCK", block)
    monkeypatch.setattr(ranks, "RANGE", size)
    monkeypatch.setattr(linalg, "RANKS", 100)
    rng = np.random.default_rng(8)
    x = rng.normal(size=6000)
    data = pd.DataFrame({"a": x, "b": np.where(rng.random(6000) < 0.8, 0.0, np.round(x, 2)), "c": np.where(rng.random(6000) < 0.5, -0.0, 0.0), "d": rng.integers(-3, 3, 6000) * 1e300})
    df = spark.createDataFrame(data).repartition(3).cache()
    assert ranks.rank_bounds(df.select("c"), ["c"], 6000, 2) is None
    dealt, matrices = ranks.average_ranks(df, list(data.columns), ranks.rank_bounds(df, list(data.columns), 6000, 0))
    rows = dealt.collect()
    got = np.concatenate(list(matrices(iter(pa.RecordBatch.from_pylist([r.asDict() for r in rows if r.block == b]) for b in {r.block for r in rows}))))
    assert sorted(map(tuple, got)) == sorted(map(tuple, data.rank().to_numpy()))
    assert len(rows) < 24_000 / 4
    assert np.allclose(correlation(df, ["a", "b", "d"], "spearman"), data[["a", "b", "d"]].rank().corr())
    with_missing = data[["a", "b"]].assign(a=np.where(rng.random(6000) < 0.1, np.nan, data.a))
    assert np.isclose(correlation(spark.createDataFrame(with_missing), ["a", "b"], "spearman")[1, 0], with_missing.dropna().rank().corr().iloc[1, 0])


def test_wide_tables_have_the_statistics_of_narrow_ones(spark, monkeypatch):
    """Statistics of many columns in one pass over batches equal those of an aggregation, missing values and constants included."""
    linalg, select = (importlib.import_module(f"phenolith.{m}") for m in ("functions.linalg", "operators.select"))
    rng = np.random.default_rng(4)
    x = rng.normal(size=(90, 7)) * 10.0 ** rng.integers(-3, 4, 7) + 100
    x[:, 3], x[rng.random((90, 7)) < 0.1] = 4.0, np.nan
    x[:, 5] = np.nan
    names = [f"Cells_{i}" for i in range(7)]
    df = spark.createDataFrame(pd.DataFrame(x, columns=names)).withColumn("Cells_int", F.expr("cast(pmod(hash(Cells_0), 5) as int)")).repartition(6)
    names.append("Cells_int")
    kinds = ["var", "na", "max", "min"]
    narrow = linalg.moments(df, names), select._stats(df, names, kinds), linalg.moments(df.limit(0), names)
    monkeypatch.setattr(linalg, "NARROW", 1)
    monkeypatch.setattr(select, "NARROW", 1)
    wide = linalg.moments(df, names), select._stats(df, names, kinds), linalg.moments(df.limit(0), names)
    for a, b in ((narrow[0], wide[0]), (narrow[2], wide[2])):
        assert a[0] == b[0] and np.allclose(a[1], b[1], rtol=1e-13, equal_nan=True) and np.allclose(a[2], b[2], rtol=1e-9, equal_nan=True)
    for c in names:
        for k in kinds:
            a, b = narrow[1][c][k], wide[1][c][k]
            assert a is b is None or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-15), (c, k)
