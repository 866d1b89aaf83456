"""Sources, sinks, single cells, locations, deep profiles, the command line and plans."""

import io
import os
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from phenolith import aggregate, annotate, normalize
from phenolith.cli import listed, main
from phenolith.operators.deep import DeepProfiles
from phenolith.operators.images import check_image_features
from phenolith.operators.locations import add_cell_locations
from phenolith.operators.single_cell import LINKS, SingleCells, check_links
from phenolith.sources.anndata import is_anndata
from phenolith.sources.blocklist import Blocklist, blocked
from phenolith.sources.readers import fetched, infer_delimiter, load_npz, load_npz_features, load_npz_locations, load_platemap, load_profiles, load_warehouse, read_sqlite, sqlite_count, write_sqlite
from phenolith.sources.sinks import write, write_gct


@pytest.fixture(scope="module")
def wells(spark):
    return spark.createDataFrame([("A01", 1, 8.0), ("A02", 3, 1.5), ("B01", 8, 5.25)], "Metadata_Well string, Cells_x long, Nuclei_y double")


def same(a, b):
    return sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_loading(spark, wells, tmp_path):
    assert load_profiles(wells) is wells
    for sep, name in ((",", "c.csv"), ("\t", "t.tsv.gz")):
        text = "Metadata_Well,Cells_x,Nuclei_y\nA01,1,8.0\nA02,3,1.5\nB01,8,5.25\n".replace(",", sep)
        path = tmp_path / name
        if name.endswith("gz"):
            import gzip

            path.write_bytes(gzip.compress(text.encode()))
        else:
            path.write_bytes(b"\xef\xbb\xbf" + text.encode())
        assert infer_delimiter(str(path)) == sep and same(load_profiles(str(path)), wells)
    (tmp_path / "bad.csv").write_text("abc\n")
    with pytest.raises(ValueError):
        infer_delimiter(str(tmp_path / "bad.csv"))
    wells.write.parquet(str(tmp_path / "w.parquet"))
    wells.write.parquet(str(tmp_path / "house/warehouse/profiles/joined_profiles/data"))
    assert same(load_profiles(str(tmp_path / "w.parquet")), wells)
    assert same(load_profiles(str(tmp_path / "house")), wells) and same(load_warehouse(str(tmp_path / "house")), wells)
    wells.write.parquet(str(tmp_path / "house/warehouse/profiles/other"))
    with pytest.raises(ValueError):
        load_profiles(str(tmp_path / "house"))
    with pytest.raises(FileNotFoundError):
        load_profiles(str(tmp_path / "none.csv"))
    (tmp_path / "p.csv").write_text("well_position,gene\nA01,x\n")
    assert load_platemap(str(tmp_path / "p.csv"), sep=",").columns == ["Metadata_well_position", "Metadata_gene"]
    assert is_anndata("x.h5ad") and not is_anndata("x.csv")


def test_writing(spark, wells, tmp_path):
    for kind in ("csv", "parquet"):
        path = normalize(wells, output_file=str(tmp_path / f"n.{kind}"), output_type=kind)
        back = spark.read.parquet(path) if kind == "parquet" else spark.read.csv(path, header=True, inferSchema=True)
        assert back.count() == 3
    path = write(wells, str(tmp_path / "f.csv.gz"), float_format="%.1f", single_file=True)
    assert [r.Nuclei_y for r in spark.read.csv(path, header=True).orderBy("Cells_x").collect()][2] in ("5.3", "5.2")
    with pytest.raises(ValueError):
        write(wells, str(tmp_path / "x"), "other")
    with pytest.raises(ValueError):
        write(wells, str(tmp_path / "x"), compression_options="zip")
    with pytest.raises(ImportError):
        write(wells, str(tmp_path / "x.h5ad"), "anndata_h5ad")


def test_gct(spark, wells, tmp_path):
    path = write_gct(wells.orderBy("Metadata_Well"), str(tmp_path / "a.gct"))
    lines = [x.split("\t") for x in open(path).read().splitlines()]
    assert lines[0] == ["#1.3"] and lines[1] == ["2", "3", "1", "1"] and lines[2] == ["id", "cp_feature_name", "SAMPLE_0", "SAMPLE_1", "SAMPLE_2"]
    assert lines[3] == ["Well", "", "A01", "A02", "B01"] and lines[4][:3] == ["Cells_x", "Cells_x", "1"]
    with pytest.raises(ValueError):
        write_gct(wells, path, feature_metadata={"a": {"Cells_x": "1"}})
    with pytest.raises(ValueError):
        write_gct(wells, path, version="#1.2")


def test_blocklist(spark, tmp_path):
    assert len(Blocklist(name="default")) == 55
    assert Blocklist(["a", "b", "a"]).add("c").to_list() == ["a", "b", "c"]
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, Nuclei_Granularity_16_RNA int")
    assert blocked(df) == ["Nuclei_Granularity_16_RNA"] and blocked(df, ["a", "z"]) == ["a"]
    (tmp_path / "b.txt").write_text("blocklist\nb\n")
    (tmp_path / "b.yaml").write_text("one: [a]\ntwo: [b]\n")
    assert blocked(df, blocklist_file=str(tmp_path / "b.txt")) == ["b"]
    assert blocked(df, blocklist_name="two", blocklist_file=str(tmp_path / "b.yaml")) == ["b"]
    with pytest.raises(ValueError):
        Blocklist(name="none")


@pytest.fixture(scope="module")
def single(spark, tmp_path_factory):
    """Two images of 50 objects in SQLite; cytoplasm numbers its parents in reverse."""
    path = str(tmp_path_factory.mktemp("sc") / "cells.sqlite")
    rng = np.random.default_rng(1)
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE image (TableNumber TEXT, ImageNumber TEXT, Metadata_Plate TEXT, Metadata_Well TEXT, Metadata_Site INTEGER, Count_Cells INTEGER, Granularity_1_Mito REAL)")
        db.executemany("INSERT INTO image VALUES (?,?,?,?,?,?,?)", [("x", "1", "plate", "A01", 1, 50, 3.0), ("y", "2", "plate", "A02", 2, 50, 4.0)])
        for t, extra in (("cells", ""), ("cytoplasm", ", Cytoplasm_Parent_Cells INTEGER, Cytoplasm_Parent_Nuclei INTEGER"), ("nuclei", "")):
            db.execute(f"CREATE TABLE {t} (TableNumber TEXT, ImageNumber TEXT, ObjectNumber INTEGER, {t.title()}_a REAL, {t.title()}_b INTEGER{extra})")
            for table, image in (("x", "1"), ("y", "2")):
                for i in range(1, 51):
                    row = [table, image, i, float(rng.integers(0, 100)), i]
                    db.execute(f"INSERT INTO {t} VALUES ({','.join('?' * (len(row) + 2 * (t == 'cytoplasm')))})", row + [51 - i, 51 - i] * (t == "cytoplasm"))
    return path


def test_sqlite(spark, single):
    assert sqlite_count(single, "cells") == 100
    df = read_sqlite(single, "cells", partitions=3)
    assert df.count() == 100 and dict(df.dtypes) == {"TableNumber": "string", "ImageNumber": "string", "ObjectNumber": "bigint", "Cells_a": "double", "Cells_b": "bigint"}
    assert read_sqlite(single, "cells", ["Cells_b"], where="ObjectNumber <= 2").count() == 4
    with pytest.raises(ValueError):
        read_sqlite(single, "none")


def test_single_cells(spark, single):
    sc = SingleCells(single)
    merged = sc.merge_single_cells()
    assert merged.count() == 100
    r = merged.filter("Cells_b = 3").first()
    assert r.Cytoplasm_b == 48 and r.Nuclei_b == 3 and r.Metadata_Plate == "plate"
    counts = {r.Metadata_Well: r.cell_count for r in sc.count_cells().collect()}
    assert counts == {"A01": 50, "A02": 50}
    out = sc.aggregate_profiles().orderBy("Metadata_Well").toPandas()
    raw = read_sqlite(single, "cells").toPandas().groupby("ImageNumber")["Cells_a"].median()
    assert list(out.Cells_a) == list(raw) and list(out.Metadata_Object_Count) == [50, 50] and list(out.Metadata_Site_Count) == [1, 1]
    assert SingleCells(single, subsample_frac=0.2, subsampling_random_state=1).subsample().count() == 20
    twice = SingleCells(single, subsample_n=7, subsampling_random_state=1).subsample()
    assert {r[1] for r in twice.groupBy("Metadata_Well").count().collect()} == {7}
    assert SingleCells(single, subsample_n=7, subsampling_random_state=1).merge_single_cells(compute_subsample=True).count() == 14
    assert SingleCells(single, fields_of_view=[1]).merge_single_cells().filter("Metadata_Well is not null").count() == 50
    with pytest.raises(ValueError):
        SingleCells(single, fields_of_view=[9])
    with pytest.raises(ValueError):
        SingleCells(single, subsample_frac=2)
    images = SingleCells(single, add_image_features=True, image_feature_categories=["Count", "Granularity"]).aggregate_profiles().orderBy("Metadata_Well").toPandas()
    assert list(images.Metadata_Count_Cells) == [50, 50] and list(images.Image_Granularity_1_Mito) == [3, 4]
    both = sc.merge_single_cells(single_cell_normalize=True)
    assert abs(both.agg(F.avg("Cells_a")).first()[0]) < 1e-9
    genes = spark.createDataFrame([("A01", "g")], "well string, gene string")
    assert sc.merge_single_cells(platemap=genes, annotate_args={"join_on": ["Metadata_well", "Metadata_Well"]}).filter("Metadata_gene = 'g'").count() == 50


def test_links():
    check_links()
    with pytest.raises(ValueError):
        check_links({"cells": {"cytoplasm": "ObjectNumber"}})
    with pytest.raises(ValueError):
        check_links({**LINKS, "other": {"cells": "x"}})
    with pytest.raises(ValueError):
        check_image_features(["Texture"], ["Granularity_1"])


def test_locations(spark, tmp_path):
    image = spark.createDataFrame([("p", "A01", "1", 1, 1), ("p", "A02", "1", 1, 2)], "Metadata_Plate string, Metadata_Well string, Metadata_Site string, TableNumber int, ImageNumber int")
    nuclei = spark.createDataFrame([(1, 1, 2, 3.0, 4.0), (1, 1, 1, 1.0, 2.0)], "TableNumber int, ImageNumber int, ObjectNumber int, Nuclei_Location_Center_X double, Nuclei_Location_Center_Y double")
    meta = image.select("Metadata_Plate", "Metadata_Well", "Metadata_Site")
    out = {r.Metadata_Well: r.CellCenters for r in add_cell_locations(meta, {"Image": image, "Nuclei": nuclei}, str(tmp_path / "o.parquet")).collect()}
    assert [tuple(c) for c in out["A01"]] == [(1, 1.0, 2.0), (2, 3.0, 4.0)] and out["A02"] is None
    assert add_cell_locations(meta, {}, str(tmp_path / "o.parquet")).count() == 2  # what is there is kept
    with pytest.raises(ValueError):
        add_cell_locations(meta.drop("Metadata_Site"), {"Image": image, "Nuclei": nuclei})


def _npz(path, features, locations, **metadata):
    path.parent.mkdir(parents=True, exist_ok=True)
    buffer = io.BytesIO()
    np.savez(buffer, features=features, locations=locations, metadata=np.array(metadata, dtype=object))
    path.write_bytes(buffer.getvalue())


def test_deep(spark, tmp_path):
    for w, k in (("A01", 1.0), ("A02", 2.0)):
        for s in ("1", "2"):
            _npz(tmp_path / f"P/{w}_{s}.npz", np.full((3, 2), k) * np.arange(1, 4)[:, None], np.arange(6).reshape(3, 2), Plate="P", Well=w, Site=s, Model="CNN", Batch="b")
    one = str(tmp_path / "P/A01_1.npz")
    assert load_npz_features(one).columns == ["Metadata_Plate", "Metadata_Well", "Metadata_Site", "Metadata_Model", "Metadata_Batch", "CNN_0", "CNN_1"]
    assert load_npz_features(str(tmp_path / "none.npz")).columns == [] and load_npz_locations(one).count() == 3
    with pytest.raises(IndexError):
        load_npz_locations(one, x_idx=5)
    index = spark.createDataFrame([("P", "A01", "1"), ("P", "A01", "2"), ("P", "A02", "1"), ("P", "A02", "2"), ("P", "A03", "1")], "Metadata_Plate string, Metadata_Well string, Metadata_Site string")
    deep = DeepProfiles(index, str(tmp_path))
    with pytest.warns(UserWarning):
        out = deep.aggregate().orderBy("Metadata_Well").toPandas()
    assert list(out.CNN_0) == [2, 4] and list(out.Metadata_Batch) == ["b", "b"] and "Metadata_Site" not in out.dropna(axis=1)
    with pytest.warns(UserWarning):
        cells = deep.normalize_single_cells()
    assert cells.count() == 12 and cells.columns[:2] == ["Location_Center_X", "Location_Center_Y"]


def test_archives_of_unequal_width(spark, tmp_path):
    """The columns are those of all archives together, whichever is read first."""
    _npz(tmp_path / "P/A01_1.npz", np.ones((2, 4)), np.zeros((2, 2)), Model="CNN", Batch="b")
    _npz(tmp_path / "P/A02_1.npz", np.full((3, 2), 2.0), np.zeros((3, 2)), Model="CNN", Compound="c")
    _npz(tmp_path / "P/A03_1.npz", np.full((1, 3), 3.0), np.zeros((1, 2)))
    _npz(tmp_path / "P/A04_1.npz", np.zeros((0, 9)), np.zeros((0, 2)), Model="Other")
    out = load_npz([str(tmp_path / f"P/A0{i}_1.npz") for i in range(1, 6)])
    assert set(out.columns) == {"_file", "Metadata_Model", "Metadata_Batch", "Metadata_Compound", *[f"CNN_{i}" for i in range(4)], *[f"DP_{i}" for i in range(3)]}
    rows = out.collect()
    assert len(rows) == 6 and sum(r.CNN_3 is None for r in rows) == 4 and sum(r.DP_2 == 3 for r in rows) == 1
    assert {r.Metadata_Compound for r in rows if r.CNN_0 == 2} == {"c"} and {r.Metadata_Batch for r in rows if r.CNN_0 == 1} == {"b"}


def test_collation(spark, tmp_path):
    """CSV files by site become one SQLite file with indexes; sites are numbered, repeated keys of different sites stay apart."""
    for site, k in (("s1", 1), ("s2", 2)):
        (tmp_path / "csv" / site).mkdir(parents=True)
        (tmp_path / f"csv/{site}/Image.csv").write_text(f"ImageNumber,Metadata_Well\n1,W{k}\n")
        (tmp_path / f"csv/{site}/Cells.csv").write_text("ObjectNumber,ImageNumber,Area\n" + "".join(f"{i},1,{10.5 * k + i}\n" for i in range(3)))
    path = main(["collate", str(tmp_path / "csv"), "plate", str(tmp_path / "out/plate.sqlite"), "--tables", "Image,Cells"])
    with sqlite3.connect(path) as db:
        assert db.execute("SELECT TableNumber, ImageNumber, Metadata_Well, Metadata_Plate FROM Image ORDER BY 1").fetchall() == [(1, 1, "W1", "plate"), (2, 1, "W2", "plate")]
        assert len(db.execute("SELECT name FROM sqlite_master WHERE type = 'index'").fetchall()) == 4
        assert "USING INDEX" in db.execute("EXPLAIN QUERY PLAN SELECT * FROM Cells WHERE TableNumber = 1 AND ImageNumber = 1").fetchall()[0][3]
    cells = SingleCells(path, compartments=["Cells"], compartment_linking_cols={}, image_table_name="Image", image_cols=["TableNumber", "ImageNumber"], aggregation_operation="mean").aggregate_compartment("Cells")
    assert {(r.Metadata_Well, r.Cells_Area) for r in cells.collect()} == {("W1", 11.5), ("W2", 22.0)}
    assert read_sqlite(f"file://{path}", "Cells").count() == 6 and fetched(f"file://{path}") == fetched(f"file://{path}") != path


def test_command_line(spark, wells, tmp_path, capsys):
    wells.write.parquet(str(tmp_path / "w.parquet"))
    path = main(["aggregate", str(tmp_path / "w.parquet"), str(tmp_path / "out"), "--strata", "Metadata_Well", "--output_type", "parquet", "--operation", "mean"])
    assert spark.read.parquet(path).count() == 3 and path in capsys.readouterr().out
    main(["normalize", str(tmp_path / "w.parquet"), str(tmp_path / "n.csv"), "--samples", "Metadata_Well != 'A01'", "--method", "robustize"])
    with pytest.raises(SystemExit):
        main(["annotate", str(tmp_path / "w.parquet"), str(tmp_path / "x"), "--platemap", "p.csv", "--join_on", "one"])
    assert listed("a, b") == ["a", "b"] and listed('["a"]') == ["a"]


def test_plans(spark, wells, tmp_path):
    wells.write.parquet(str(tmp_path / "w.parquet"))
    df = spark.read.parquet(str(tmp_path / "w.parquet"))
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    out = plan(aggregate(df.filter("Cells_x > 1"), strata=["Metadata_Well"], features=["Cells_x"], operation="mean"))
    assert "PushedFilters: [IsNotNull(Cells_x), GreaterThan(Cells_x,1)]" in out and "Nuclei_y" not in out.split("ReadSchema")[1]
    assert "BroadcastHashJoin" in plan(annotate(df, spark.createDataFrame([("A01", 1)], "Metadata_Well string, k int"), join_on="Metadata_Well"))


def test_stream(spark, wells, tmp_path):
    from phenolith.streaming.aggregate import aggregate_stream

    wells.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(wells.schema).parquet(str(tmp_path / "in"))
    q = aggregate_stream(stream, ["Metadata_Well"]).writeStream.outputMode("complete").format("memory").queryName("means").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("means").count() == 3


def test_sqlite_written_by_tasks(spark, tmp_path, monkeypatch):
    """Rows go into the file without passing through the driver, in the order of their partitions, and nothing else is left."""
    df = spark.range(0, 30_000, 1, 7).selectExpr("id", "id % 3 = 0 AS third", "if(id % 5 = 0, null, id / 2D) AS half", "if(id = 8, double('NaN'), 1D) AS one", "concat('ü;\"', id) AS text", "date_add(DATE '2020-01-01', int(id % 9)) AS day")
    kind, received = type(df), []
    collect = kind.collect
    monkeypatch.setattr(kind, "collect", lambda self: received.append(collect(self)) or received[-1])
    monkeypatch.setattr(kind, "toLocalIterator", lambda self, *_: pytest.fail("rows pass through the driver"))
    path = write_sqlite({"a": df, "none": df.limit(0)}, str(tmp_path / "out/x.sqlite"), [("a", ["id", "text"])])
    monkeypatch.undo()
    assert sum(map(len, received)) <= 20 and os.listdir(tmp_path / "out") == ["x.sqlite"]
    with sqlite3.connect(path) as db:
        assert db.execute("SELECT id, third, half, one, text, day FROM a ORDER BY rowid").fetchall() == [(i, int(i % 3 == 0), None if i % 5 == 0 else i / 2, None if i == 8 else 1.0, f'ü;"{i}', f"2020-01-0{i % 9 + 1}") for i in range(30_000)]
        assert db.execute("SELECT count(*) FROM none").fetchone() == (0,)
        assert db.execute("SELECT name FROM sqlite_master WHERE type = 'index'").fetchall() == [("a_index_0",)]
    assert write_sqlite({"a": df.limit(1)}, path) == path and sqlite_count(path, "a") == 1
