"""Catalogue queries against their SQL on the smallest tables, where those are present."""

import os

import pytest

from phenolith.plans import files  # noqa: F401
from phenolith.plans.catalogue import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
SOME = ["aggregate_null_strata", "annotate_external", "annotate_cmap", "normalize_standardize_control", "normalize_mad", "select_frequency", "select_correlation", "correlation_spearman", "single_cells_aggregate", "sample_fraction", "normalize_inverse_normal", "normalize_spherize", "normalize_spherize_vectors", "correlation_kendall", "consensus_modz", "source_warehouse", "source_text_tab", "source_platemap", "source_sqlite", "sink_float_format", "sink_gct", "collated_profiles", "cell_locations", "deep_profiles", "deep_cells", "deep_normalized", "deep_profiles_by_folder", "command_line", "single_cells_counted", "single_cells_fields", "single_cells_sampled", "single_cells_normalized", "single_cells_prefixed", "sample_repeated", "stream_means"]


def plain(table):
    return sorted(tuple(None if v is None or v != v else round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in r) for r in table)


@pytest.mark.parametrize("name", SOME)
def test_query_equals_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(DATA):
        pytest.skip("no tables here")
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{DATA}/{f}')")
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    want = con.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({ORACLE_SQL[name]})")
    key = lambda rows: sorted(plain(rows), key=str)
    assert key(df.select(*columns).collect()) == key(want.fetchall())


@pytest.mark.parametrize("method", ["pearson", "spearman"])
def test_modz_of_all_vectors_equals_its_sql(spark, method):
    test_query_equals_its_sql(spark, f"consensus_modz_{method}")


def test_external_metadata_of_all_orders_equals_its_sql(spark):
    test_query_equals_its_sql(spark, "annotate_external_all")
    priorities = {r[0] for r in QUERIES["annotate_external_all"](spark, DATA).select("Metadata_o_orderpriority").distinct().collect()}
    assert len(priorities - {None}) > 1


def test_every_query_has_its_sql():
    assert set(ORACLE_SQL) == set(QUERIES)
