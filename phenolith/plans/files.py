"""Queries through sources and sinks: the driver's tables are written in a format and read back, or made into single
cells, plates and archives, and the library's verbs go over what was read."""

from __future__ import annotations

import io
import os
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phenolith.cli import main
from phenolith.operators.aggregate import aggregate
from phenolith.operators.annotate import annotate
from phenolith.operators.deep import DeepProfiles
from phenolith.operators.locations import add_cell_locations
from phenolith.operators.single_cell import SingleCells, sample_fraction
from phenolith.plans.catalogue import _ONE, FEATURES, LINES, STRATA, _each, cells, lines, query, read, rounded
from phenolith.sources.readers import collate, load_npz, load_platemap, load_profiles, load_warehouse, read_sqlite, write_sqlite
from phenolith.sources.sinks import write, write_gct
from phenolith.streaming.aggregate import aggregate_stream


def scratch(spark: SparkSession) -> str:
    """A new folder for what a query writes: in ``spark.checkpoint.dir`` where it is set, else, on local masters only, a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.gettempdir()
    if "://" in base.removeprefix("file://"):
        raise RuntimeError("single files are written here, which needs a file system that is mounted everywhere")
    path = f"{base.removeprefix('file://')}/phenolith-files/{uuid.uuid4().hex}"
    os.makedirs(path, exist_ok=True)
    return path


@query("source_parquet_folder", "SELECT * FROM supplier")
def _(spark, d):
    return load_profiles(write(read(spark, d, "supplier"), f"{scratch(spark)}/profiles", "parquet"))


@query("source_warehouse", "SELECT * FROM nation")
def _(spark, d):
    house = scratch(spark)
    write(read(spark, d, "nation"), f"{house}/warehouse/profiles/joined_profiles/data", "parquet")
    return load_warehouse(house)


@query("source_warehouse_resolved", "SELECT * FROM customer")
def _(spark, d):
    house = scratch(spark)
    write(read(spark, d, "customer"), f"{house}/profiles/only", "parquet")
    return load_profiles(house)


for _sep, _name in ((",", "comma"), ("\t", "tab"), (";", "semicolon")):

    @query(f"source_text_{_name}", "SELECT CAST(c_custkey AS INTEGER) AS c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
    def _(spark, d, sep=_sep):
        """Text with a sniffed delimiter, compressed; types are inferred anew."""
        return load_profiles(write(read(spark, d, "customer"), f"{scratch(spark)}/profiles.csv.gz", "csv", sep=sep))


@query("source_platemap", "SELECT p_partkey::INTEGER AS Metadata_p_partkey, p_brand AS Metadata_p_brand, p_size AS Metadata_p_size FROM part")
def _(spark, d):
    path = write(read(spark, d, "part").select("p_partkey", "p_brand", "p_size"), f"{scratch(spark)}/platemap.csv", "csv")
    return load_platemap(path, sep=",")


@query("sink_float_format", f"WITH {LINES} SELECT Metadata_flag, Metadata_status, {_each('printf(chr(37) || chr(46) || chr(51) || chr(102), avg({c}))')} FROM lines GROUP BY ALL")
def _(spark, d):
    """A verb's result written as text with three decimals."""
    path = aggregate(lines(spark, d), strata=STRATA, operation="mean", output_file=f"{scratch(spark)}/out.csv", float_format="%.3f")
    return spark.read.csv(path, header=True)


@query("sink_parquet", f"WITH {LINES} SELECT Metadata_flag, Metadata_status, {_each('round(avg({c}), 4)')} FROM lines GROUP BY ALL")
def _(spark, d):
    return rounded(spark.read.parquet(aggregate(lines(spark, d), strata=STRATA, operation="mean", output_file=f"{scratch(spark)}/out.parquet", output_type="parquet")))


@query("source_sqlite", "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders WHERE o_totalprice > 100000 AND o_orderstatus <> 'P'")
def _(spark, d):
    """Columns and a condition that SQLite evaluates, in ranges of row ids."""
    path = write_sqlite({"orders": read(spark, d, "orders")}, f"{scratch(spark)}/orders.sqlite", [("orders", ["o_orderkey"])])
    return read_sqlite(path, "orders", ["o_orderkey", "o_orderpriority", "o_totalprice"], "o_totalprice > 100000 AND o_orderstatus <> 'P'", partitions=5)


def _plate(spark: SparkSession, d: str) -> str:
    """CSV files of a plate by site: suppliers are images, parts the cells in them; the collated SQLite file."""
    folder = scratch(spark)
    image = read(spark, d, "supplier").selectExpr("s_suppkey AS ImageNumber", "concat('W', s_nationkey) AS Metadata_Well", "pmod(s_suppkey, 3) AS site").toPandas()
    part = read(spark, d, "part").selectExpr("p_partkey AS ObjectNumber", f"pmod(p_partkey, {len(image)}) AS ImageNumber", "p_size AS AreaShape_Area", "p_retailprice AS Intensity_Mean").toPandas()
    for site, rows in image.groupby("site"):
        os.makedirs(f"{folder}/csv/site{site}")
        rows.drop(columns="site").to_csv(f"{folder}/csv/site{site}/Image.csv", index=False)
        part[part.ImageNumber.isin(rows.ImageNumber)].to_csv(f"{folder}/csv/site{site}/Cells.csv", index=False)
    return collate(f"{folder}/csv", "plate", f"{folder}/plate.sqlite", ["Image", "Cells"])


_PLATE = "i AS (SELECT s_suppkey, 'W' || s_nationkey AS Metadata_Well, s_suppkey % 3 + 1 AS TableNumber FROM supplier), c AS (SELECT p_size, p_retailprice, Metadata_Well, TableNumber, s_suppkey FROM part JOIN i ON p_partkey % (SELECT count(*) FROM supplier) = s_suppkey)"


@query("collated_cells", f"WITH {_PLATE} SELECT p_size::DOUBLE AS Cells_AreaShape_Area, p_retailprice AS Cells_Intensity_Mean, TableNumber, s_suppkey AS ImageNumber FROM c")
def _(spark, d):
    return read_sqlite(_plate(spark, d), "Cells", ["Cells_AreaShape_Area", "Cells_Intensity_Mean", "TableNumber", "ImageNumber"]).withColumn("Cells_AreaShape_Area", F.col("Cells_AreaShape_Area").cast("double"))


@query("collated_profiles", f"WITH {_PLATE} SELECT 'plate' AS Metadata_Plate, Metadata_Well, round(avg(p_size), 4) AS Cells_AreaShape_Area, round(avg(p_retailprice), 4) AS Cells_Intensity_Mean FROM c GROUP BY Metadata_Well")
def _(spark, d):
    """Profiles of one compartment of the collated file."""
    one = SingleCells(_plate(spark, d), compartments=["Cells"], compartment_linking_cols={}, image_table_name="Image", image_cols=["TableNumber", "ImageNumber"], aggregation_operation="mean")
    return rounded(one.aggregate_compartment("Cells"))


@query("cell_locations", "SELECT n_name AS Metadata_Plate, 'W' || s_suppkey AS Metadata_Well, CAST(s_nationkey AS VARCHAR) AS Metadata_Site, n.centres FROM supplier JOIN nation ON s_nationkey = n_nationkey LEFT JOIN (SELECT l_suppkey, string_agg(printf('%d:%.2f:%.2f', l_linenumber, l_quantity, l_extendedprice), ';' ORDER BY l_linenumber, l_quantity, l_extendedprice) AS centres FROM lineitem GROUP BY ALL) n ON l_suppkey = s_suppkey")
def _(spark, d):
    """Suppliers are images, lines their cells; the table of images is text, the tables of cells are frames, the result is Parquet."""
    folder = scratch(spark)
    images = read(spark, d, "supplier").join(read(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("Metadata_Plate"), F.concat(F.lit("W"), "s_suppkey").alias("Metadata_Well"), F.col("s_nationkey").cast("string").alias("Metadata_Site"), "s_suppkey")
    write(images.drop("s_suppkey"), f"{folder}/images.csv")
    nuclei = read(spark, d, "lineitem").select(F.lit(1).alias("TableNumber"), F.col("l_suppkey").alias("ImageNumber"), F.col("l_linenumber").alias("ObjectNumber"), F.col("l_quantity").alias("Nuclei_Location_Center_X"), F.col("l_extendedprice").alias("Nuclei_Location_Center_Y"))
    out = add_cell_locations(f"{folder}/images.csv", {"Image": images.withColumn("TableNumber", F.lit(1)).withColumnRenamed("s_suppkey", "ImageNumber"), "Nuclei": nuclei}, f"{folder}/out.parquet")
    text = F.transform("CellCenters", lambda c: F.format_string("%d:%.2f:%.2f", c["ObjectNumber"], c["Nuclei_Location_Center_X"], c["Nuclei_Location_Center_Y"]))
    return out.select("Metadata_Plate", "Metadata_Well", "Metadata_Site", F.array_join(text, ";").alias("centres"))


def _archives(spark: SparkSession, d: str, width: int = 64) -> str:
    """An archive for each label and each of two sites; those of odd labels hold ``width`` features."""
    folder = scratch(spark)
    rows = read(spark, d, "embeddings").select("vec_id", "embedding", "label").toPandas()
    for (label, site), part in rows.groupby([rows.label, rows.vec_id % 2]):
        os.makedirs(f"{folder}/P", exist_ok=True)
        x = np.stack(part.embedding.to_list())[:, : width if label % 2 else 64]
        blob = io.BytesIO()
        np.savez(blob, features=x, locations=np.stack([part.vec_id, -part.vec_id], 1), metadata=np.array({"Model": "CNN", **({"Batch": "b"} if label % 2 else {})}, dtype=object))
        with open(f"{folder}/P/{label}_{site}.npz", "wb") as f:
            f.write(blob.getvalue())
    return folder


def _index(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "embeddings").select(F.lit("P").alias("Metadata_Plate"), F.col("label").cast("string").alias("Metadata_Well"), (F.col("vec_id") % 2).cast("string").alias("Metadata_Site"))


@query("deep_profiles", f"SELECT 'P' AS Metadata_Plate, CAST(label AS VARCHAR) AS Metadata_Well, {', '.join(f'round(avg(embedding[{i + 1}]::DOUBLE), 4) + 0.0 AS CNN_{i}' for i in range(64))} FROM embeddings GROUP BY label")
def _(spark, d):
    out = rounded(DeepProfiles(_index(spark, d), _archives(spark, d)).aggregate("mean", "well"))
    return out.select("Metadata_Plate", "Metadata_Well", *[f"CNN_{i}" for i in range(64)])


@query("deep_cells", f"SELECT vec_id::DOUBLE AS Location_Center_X, -vec_id::DOUBLE AS Location_Center_Y, 'P' AS Metadata_Plate, CAST(label AS VARCHAR) AS Metadata_Well, CAST(vec_id % 2 AS VARCHAR) AS Metadata_Site, 'CNN' AS Metadata_Model, CASE WHEN label % 2 = 1 THEN 'b' END AS Metadata_Batch, {', '.join(f'CASE WHEN label % 2 = 0 OR {i} < 20 THEN embedding[{i + 1}]::DOUBLE END AS CNN_{i}' for i in range(64))} FROM embeddings")
def _(spark, d):
    """Archives of unequal width and metadata: what one hasn't got is null."""
    return DeepProfiles(_index(spark, d), _archives(spark, d, 20)).single_cells()


_STANDARD = ", ".join(f"round((embedding[{i + 1}]::DOUBLE - m[{i + 1}]) / s[{i + 1}], 4) + 0.0 AS CNN_{i}" for i in range(64))


@query("deep_normalized", f"WITH e AS (SELECT [{', '.join(f'avg(embedding[{i + 1}]::DOUBLE)' for i in range(64))}] AS m, [{', '.join(f'stddev_pop(embedding[{i + 1}]::DOUBLE)' for i in range(64))}] AS s FROM embeddings) SELECT vec_id::DOUBLE AS Location_Center_X, CAST(label AS VARCHAR) AS Metadata_Well, {_STANDARD} FROM embeddings, e")
def _(spark, d):
    """All cells of all archives, standardized."""
    out = DeepProfiles(_index(spark, d), _archives(spark, d)).normalize_single_cells()
    return rounded(out.select("Location_Center_X", "Metadata_Well", *[f"CNN_{i}" for i in range(64)]))


@query("deep_profiles_by_folder", f"SELECT 'P' AS Metadata_Plate, CAST(label AS VARCHAR) AS Metadata_Well, CAST(vec_id % 2 AS VARCHAR) AS Metadata_Site, {', '.join(f'round(median(embedding[{i + 1}]::DOUBLE), 4) + 0.0 AS CNN_{i}' for i in range(64))} FROM embeddings GROUP BY label, vec_id % 2")
def _(spark, d):
    """The index is a text file, and each site's profile goes into a folder of its own."""
    folder = scratch(spark)
    write(_index(spark, d).distinct(), f"{folder}/index.csv")
    DeepProfiles(f"{folder}/index.csv", _archives(spark, d)).aggregate("median", "site", output_folder=f"{folder}/out")
    out = spark.read.csv(f"{folder}/out", header=True, inferSchema=True)
    return rounded(out.select(*[F.col(c).cast("string").alias(c) for c in ("Metadata_Plate", "Metadata_Well", "Metadata_Site")], *[f"CNN_{i}" for i in range(64)]))


@query("npz_locations", "SELECT vec_id::DOUBLE AS Location_Center_X, -vec_id::DOUBLE AS Location_Center_Y FROM embeddings WHERE label = 0 AND vec_id % 2 = 0")
def _(spark, d):
    """One archive's centres."""
    return load_npz(f"{_archives(spark, d)}/P/0_0.npz", locations=True).select("Location_Center_X", "Location_Center_Y")


@query("sink_gct", "SELECT CAST(s_suppkey AS VARCHAR) AS supplier, u.feature, u.value FROM supplier, LATERAL (SELECT 'Cells_balance' AS feature, CAST(s_acctbal AS VARCHAR) AS value UNION ALL SELECT 'Nuclei_nation', CAST(s_nationkey AS VARCHAR)) u")
def _(spark, d):
    """A GCT file read back: features are its rows, samples its columns."""
    profiles = read(spark, d, "supplier").select(F.col("s_suppkey").alias("Metadata_supplier"), F.col("s_acctbal").alias("Cells_balance"), F.col("s_nationkey").alias("Nuclei_nation"))
    path = write_gct(profiles, f"{scratch(spark)}/out.gct")
    rows = spark.read.text(path).select(F.split("value", "\t").alias("x"))
    part = lambda name: rows.filter(F.col("x")[0] == name).select(F.posexplode(F.slice("x", 3, 1 << 30)).alias("place", name))
    head = part("supplier")
    each = [head.join(part(c), "place").select("supplier", F.lit(c).alias("feature"), F.col(c).alias("value")) for c in ("Cells_balance", "Nuclei_nation")]
    return each[0].unionByName(each[1])


@query("command_line", f"WITH {LINES}, s AS (SELECT {', '.join(f'avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}' for c in FEATURES)} FROM lines WHERE Metadata_flag = 'A') SELECT Metadata_flag, {_each('round(avg((l.{c} - m_{c}) / s_{c}), 4) + 0.0')} FROM lines l, s GROUP BY Metadata_flag")
def _(spark, d):
    """Two verbs from a shell, one after the other."""
    folder = scratch(spark)
    write(lines(spark, d), f"{folder}/in.parquet", "parquet")
    main(["normalize", f"{folder}/in.parquet", f"{folder}/normal.parquet", "--samples", "Metadata_flag == 'A'", "--output_type", "parquet"])
    main(["consensus", f"{folder}/normal.parquet", f"{folder}/out.parquet", "--replicate_columns", "Metadata_flag", "--operation", "mean", "--output_type", "parquet"])
    return rounded(spark.read.parquet(f"{folder}/out.parquet"))


# single cells


@query("single_cells_fields", f"WITH {_ONE} SELECT o_orderstatus AS Metadata_Plate, o_orderpriority AS Metadata_Well, round(avg(q), 4) AS Cells_quantity FROM one JOIN orders ON l_orderkey = o_orderkey WHERE o_orderkey % 9 IN (1, 4) GROUP BY ALL")
def _(spark, d):
    """Two fields of view."""
    one = SingleCells(cells(spark, d).source, aggregation_operation="mean", fields_of_view=[1, 4])
    return rounded(one.aggregate_compartment("cells"))


@query("single_cells_counted", f"WITH {_ONE}, i AS (SELECT o_orderstatus AS Metadata_Plate, o_orderpriority AS Metadata_Well, sum(o_custkey)::BIGINT AS by_image FROM orders GROUP BY ALL), c AS (SELECT o_orderstatus AS Metadata_Plate, o_orderpriority AS Metadata_Well, CAST(round_even(count(*) * 0.5, 0) AS BIGINT) AS by_sample FROM one JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL) SELECT * FROM i JOIN c USING (Metadata_Plate, Metadata_Well)")
def _(spark, d):
    """Cells of each well by the image table's own counts, and in a sample."""
    source = cells(spark, d).source
    counted = source["image"].join(read(spark, d, "orders").select(F.col("o_orderkey").alias("ImageNumber"), F.col("o_custkey").alias("Count_Cells")), "ImageNumber")
    one = SingleCells(source | {"image": counted}, subsample_frac=0.5, subsampling_random_state=2)
    return one.count_cells().withColumnRenamed("cell_count", "by_image").join(one.count_cells(count_subset=True).withColumnRenamed("cell_count", "by_sample"), ["Metadata_Plate", "Metadata_Well"])


@query("single_cells_sampled", f"WITH {_ONE} SELECT o_orderstatus AS Metadata_Plate, o_orderpriority AS Metadata_Well, CAST(round_even(count(*) * 0.25, 0) AS BIGINT) AS n FROM one JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL")
def _(spark, d):
    """Merged cells of a quarter of each well."""
    one = SingleCells(cells(spark, d).source, subsample_frac=0.25, subsampling_random_state=5)
    return one.merge_single_cells(compute_subsample=True).groupBy("Metadata_Plate", "Metadata_Well").agg(F.count("*").alias("n"))


@query("single_cells_normalized", f"WITH {_ONE}, s AS (SELECT avg(q) AS mq, stddev_pop(q) AS sq, avg(p) AS mp, stddev_pop(p) AS sp, avg(t) AS mt, stddev_pop(t) AS st FROM one) SELECT l_orderkey AS Metadata_ImageNumber, l_linenumber AS Metadata_ObjectNumber_cells, round((q - mq) / sq, 4) + 0.0 AS Cells_quantity, round((p - mp) / sp, 4) + 0.0 AS Cytoplasm_price, round((t - mt) / st, 4) + 0.0 AS Nuclei_tax FROM one, s")
def _(spark, d):
    return rounded(cells(spark, d).merge_single_cells(single_cell_normalize=True).select("Metadata_ImageNumber", "Metadata_ObjectNumber_cells", "Cells_quantity", "Cytoplasm_price", "Nuclei_tax"))


@query("single_cells_prefixed", "SELECT s_suppkey AS Metadata_ImageNumber, 'p' || s_suppkey AS Metadata_Plate, s_nationkey AS Metadata_Well, 'm' AS Metadata_mark, s_acctbal AS Cells_balance FROM supplier")
def _(spark, d):
    """Names that image tables give to plate and well become metadata names."""
    profiles = read(spark, d, "supplier").select(F.col("s_suppkey").alias("Metadata_ImageNumber"), F.concat(F.lit("p"), "s_suppkey").alias("Image_Metadata_Plate"), F.col("s_nationkey").alias("Image_Metadata_Well"), F.col("s_acctbal").alias("Cells_balance"))
    return annotate(profiles, profiles.select("Metadata_ImageNumber", F.lit("m").alias("mark")), join_on="Metadata_ImageNumber")


@query("sample_repeated", "SELECT 0::BIGINT AS differing, count(*) AS drawn FROM (SELECT unnest(range(CAST(round_even(count(*) * 0.2, 0) AS BIGINT))) FROM events GROUP BY event_type)")
def _(spark, d):
    """Two draws with one seed over rows dealt differently: the rows that differ, and how many are drawn."""
    df = read(spark, d, "events")
    one, two = sample_fraction(df, ["event_type"], 0.2, 9), sample_fraction(df.repartition(7, "user_id"), ["event_type"], 0.2, 9)
    same = one.withColumn("side", F.lit(1)).unionByName(two.withColumn("side", F.lit(-1))).groupBy("event_id").agg(F.sum("side").alias("s"), F.sum(F.when(F.col("side") == 1, 1).otherwise(0)).alias("n"))
    return same.agg(F.sum(F.abs("s")).cast("long").alias("differing"), F.sum("n").cast("long").alias("drawn"))


@query("stream_means", "SELECT event_type AS Metadata_type, count(*) AS Metadata_Object_Count, round(avg(value), 4) AS Cells_value FROM events GROUP BY ALL")
def _(spark, d):
    """Means kept over a stream of the table's files, until all that is there is read."""
    static = read(spark, d, "events")
    stream = spark.readStream.schema(static.schema).option("pathGlobFilter", "events.parquet").parquet(d)
    name = f"means_{uuid.uuid4().hex}"
    means = aggregate_stream(stream.select(F.col("event_type").alias("Metadata_type"), F.col("value").alias("Cells_value")), ["Metadata_type"])
    means.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", f"{scratch(spark)}/stream").trigger(availableNow=True).start().awaitTermination()
    return rounded(spark.table(name))
