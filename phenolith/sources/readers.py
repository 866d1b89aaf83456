"""Profiles from Parquet files and folders, warehouses, delimited text, SQLite, NPZ and AnnData."""

from __future__ import annotations

import atexit
import contextlib
import csv
import io
import os
import shutil
import sqlite3
import tempfile
import uuid
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phenolith.functions.schema import METADATA

_SNIFF = 10_000


def session() -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()


def _fs(spark: SparkSession, path: str):
    """(Hadoop file system, path object) of any path that Spark can read."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def _children(spark: SparkSession, path: str) -> tuple[list[str], list[str]]:
    """(files, folders) directly under a folder; marker files such as _SUCCESS are left out."""
    fs, p = _fs(spark, path)
    if not fs.exists(p) or not fs.getFileStatus(p).isDirectory():
        return [], []
    found = [(s.getPath().getName(), s.isDirectory()) for s in fs.listStatus(p)]
    found = [(n, d) for n, d in sorted(found) if not n.startswith(("_", "."))]
    return [n for n, d in found if not d], [n for n, d in found if d]


def is_parquet_file(path: str) -> bool:
    return str(path).lower().endswith(".parquet")


def is_parquet_folder(spark: SparkSession, path: str) -> bool:
    """A folder whose own files are Parquet, all of them and at least one."""
    files, _ = _children(spark, path)
    return bool(files) and all(map(is_parquet_file, files))


def parquet_path(spark: SparkSession, path: str) -> str | None:
    """The Parquet file or folder that ``path``, or its folder ``data``, is."""
    path = str(path).rstrip("/")
    fs, p = _fs(spark, path)
    if fs.exists(p) and is_parquet_file(path) and not fs.getFileStatus(p).isDirectory():
        return path
    return next((x for x in (path, f"{path}/data") if is_parquet_folder(spark, x)), None)


def warehouse_tables(spark: SparkSession, path: str, namespace: str = "profiles") -> dict[str, str]:
    """Tables of a warehouse folder by name, with the folder of their Parquet files."""
    path, out = str(path).rstrip("/"), {}
    for root in (f"{path}/{namespace}", f"{path}/warehouse/{namespace}"):
        for name in _children(spark, root)[1]:
            if (found := parquet_path(spark, f"{root}/{name}")) and name not in out:
                out[name] = found
    return out


def resolve_warehouse(spark: SparkSession, path: str) -> str | None:
    """The one profile table of a warehouse; None if ``path`` is none, an error if there are several."""
    tables = warehouse_tables(spark, path)
    if len(tables) > 1:
        raise ValueError(f"several profile tables in {path}: {sorted(tables)}; name one")
    return next(iter(tables.values()), None)


def load_warehouse(path: str, table_name: str = "joined_profiles", namespace: str = "profiles") -> DataFrame:
    spark = session()
    tables = warehouse_tables(spark, path, namespace)
    if table_name not in tables:
        raise FileNotFoundError(f"no table {namespace}.{table_name} in {path}; found {sorted(tables)}")
    return spark.read.parquet(tables[table_name])


def infer_delimiter(path: str) -> str:
    """The delimiter of a text file, compressed or not, from its first characters."""
    rows = session().read.option("wholetext", False).text(str(path)).limit(50).collect()
    text = "\n".join(r[0] for r in rows)[:_SNIFF].removeprefix("﻿")
    try:
        found = csv.Sniffer().sniff(text).delimiter
    except csv.Error:
        found = ""
    if not found or found.isalnum():
        raise ValueError(f"no delimiter found in {path}")
    return found


def _text(path: str, sep: str | None) -> DataFrame:
    return session().read.csv(str(path), sep=sep or infer_delimiter(path), header=True, inferSchema=True, enforceSchema=False)


def load_profiles(profiles: object) -> DataFrame:
    """A DataFrame as it is; a path as Parquet, a warehouse, AnnData or delimited text, whichever it is."""
    if isinstance(profiles, DataFrame):
        return profiles
    from phenolith.sources.anndata import is_anndata, read_anndata

    spark = session()
    if hasattr(profiles, "obs") and is_anndata(profiles):
        return read_anndata(spark, profiles)
    path = str(profiles)
    if not exists(spark, path):
        raise FileNotFoundError(f"{path} does not exist")
    if found := parquet_path(spark, path) or resolve_warehouse(spark, path):
        return spark.read.parquet(found)
    return read_anndata(spark, path) if is_anndata(path) else _text(path, None)


def load_platemap(platemap: str | DataFrame, add_metadata_id: bool = True, sep: str | None = None) -> DataFrame:
    """A plate map, its columns prefixed on demand; ``sep`` spares the look at the text."""
    df = platemap if isinstance(platemap, DataFrame) else _text(platemap, sep) if sep else load_profiles(platemap)
    return df.toDF(*[c if c.startswith(METADATA) else METADATA + c for c in df.columns]) if add_metadata_id else df


# NPZ: one archive a file, read on the executors


def _npz(blob: bytes) -> tuple[np.ndarray, dict[str, str], np.ndarray | None]:
    with np.load(io.BytesIO(blob), allow_pickle=False) as z:
        names = set(z.files)
        features = z["features"] if "features" in names else np.zeros((0, 0))
        locations = z["locations"] if "locations" in names else None
        meta: dict[str, str] = {}
    if "metadata" in names:
        with np.load(io.BytesIO(blob), allow_pickle=True) as z:  # a dict is stored as an object
            meta = {str(k): str(v) for k, v in dict(z["metadata"].item()).items()}
    return features, meta, locations


def _files(paths: Sequence[str]) -> DataFrame | None:
    spark = session()
    there = [p for p in paths if exists(spark, p)]
    return spark.read.format("binaryFile").load(there).select("path", "content") if there else None


def _shapes(files: DataFrame, fallback: str) -> list:
    """The distinct (prefix, width, metadata names, columns of locations) of all archives; archives without rows don't count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = set()
            for blob in b.column(1):
                x, meta, at = _npz(blob.as_py())
                if len(x):
                    found.add((_prefix(meta, fallback), x.shape[1], "\n".join(meta), -1 if at is None else at.shape[1]))
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.string(), pa.int32(), pa.string(), pa.int32()))], names=["prefix", "width", "meta", "centres"])

    return files.mapInArrow(run, "prefix string, width int, meta string, centres int").distinct().orderBy("prefix", "width", "meta").collect()


def _prefix(meta: dict[str, str], fallback: str) -> str:
    return meta.get("Model") or meta.get(f"{METADATA}Model") or fallback


def load_npz(paths: str | Sequence[str], fallback_feature_prefix: str = "DP", metadata: bool = True, locations: bool = False, x_idx: int = 0, y_idx: int = 1) -> DataFrame:
    """Rows of NPZ archives: ``Metadata_*`` strings, cell centres on demand, then features.

    Features are named by the archive's ``Metadata_Model``, else by the fallback
    prefix.  Missing files give no rows.  The columns are those of all archives together,
    found in a pass of its own; what an archive hasn't got is null.
    Archives are read one at a time in as many tasks as there are files.
    """
    spark = session()
    files = _files([paths] if isinstance(paths, str) else list(paths))
    shapes = _shapes(files, fallback_feature_prefix) if files is not None else []
    if not shapes:
        return spark.createDataFrame([], T.StructType([]))
    if locations and (narrow := [s.centres for s in shapes if 0 <= s.centres <= max(x_idx, y_idx)]):
        raise IndexError(f"locations have {min(narrow)} columns")
    meta_names = list(dict.fromkeys(f"{METADATA}{k}" for s in shapes for k in s.meta.split("\n") if k)) if metadata else []
    widths: dict[str, int] = {}
    for s in shapes:
        widths[s.prefix] = max(widths.get(s.prefix, 0), s.width)
    names = [f"{p}_{i}" for p, w in widths.items() for i in range(w)]
    centre_names = ["Location_Center_X", "Location_Center_Y"] if locations else []
    schema = T.StructType([T.StructField("_file", T.StringType())] + [T.StructField(c, T.StringType()) for c in meta_names] + [T.StructField(c, T.DoubleType()) for c in [*centre_names, *names]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, blob in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                x, own, at = _npz(blob.as_py())
                n = len(x)
                if not n:
                    continue
                cols = [pa.array([path] * n), *[pa.array([own.get(c.removeprefix(METADATA))] * n, pa.string()) for c in meta_names]]
                if locations:
                    cols += [pa.array(np.full(n, np.nan) if at is None else np.asarray(at[:, i], float)) for i in (x_idx, y_idx)]
                prefix = _prefix(own, fallback_feature_prefix)
                cols += [pa.array(np.ascontiguousarray(x[:, j], dtype=float)) if p == prefix and j < x.shape[1] else pa.nulls(n, pa.float64()) for p, w in widths.items() for j in range(w)]
                yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in schema])

    return files.mapInArrow(run, schema)


def load_npz_features(path: str, fallback_feature_prefix: str = "DP", metadata: bool = True) -> DataFrame:
    return load_npz(path, fallback_feature_prefix, metadata).drop("_file")


def load_npz_locations(path: str, x_idx: int = 0, y_idx: int = 1) -> DataFrame:
    df = load_npz(path, locations=True, x_idx=x_idx, y_idx=y_idx)
    return df.select("Location_Center_X", "Location_Center_Y") if df.columns else df


# SQLite: tables of single cells


_KINDS = {"INTEGER": T.LongType(), "REAL": T.DoubleType(), "TEXT": T.StringType(), "BLOB": T.BinaryType()}


_FETCHED: dict[str, str] = {}


def fetched(path: str) -> str:
    """A local path of a file: itself, or a copy that this process makes once of a file in a store (``s3://`` without
    credentials, or any that Arrow opens).  SQLite reads by position, so it needs one."""
    if "://" not in path:
        return path
    if path not in _FETCHED:
        store, inner = (pafs.S3FileSystem(anonymous=True), path.split("://", 1)[1]) if path.startswith(("s3://", "s3a://")) else pafs.FileSystem.from_uri(path)
        with store.open_input_stream(inner) as source, tempfile.NamedTemporaryFile(prefix="phenolith-", suffix=".sqlite", delete=False) as out:
            while part := source.read(1 << 24):
                out.write(part)
        _FETCHED[path] = out.name
        atexit.register(lambda: os.path.exists(out.name) and os.unlink(out.name))
    return _FETCHED[path]


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{fetched(path)}?mode=ro", uri=True)


def sqlite_columns(path: str, table: str) -> dict[str, T.DataType]:
    """Columns of a table with the widest type that its declaration, or else its values, show."""
    with _open(path) as db:
        out: dict[str, T.DataType] = {}
        for _, name, declared, *_ in db.execute(f'PRAGMA table_info("{table}")').fetchall():
            kind = (declared or "").upper()
            kinds = {"INTEGER"} if "INT" in kind else {"REAL"} if any(x in kind for x in ("REAL", "FLOA", "DOUB", "NUM")) else {"TEXT"} if any(x in kind for x in ("CHAR", "TEXT", "CLOB")) else {r[0].upper() for r in db.execute(f'SELECT DISTINCT typeof("{name}") FROM "{table}"')} - {"NULL"}
            out[name] = T.StringType() if "TEXT" in kinds or not kinds else T.DoubleType() if "REAL" in kinds else _KINDS[min(kinds)]
    if not out:
        raise ValueError(f"no table {table} in {path}")
    return out


def sqlite_count(path: str, table: str) -> int:
    with _open(path) as db:
        return db.execute(f'SELECT count(*) FROM "{table}"').fetchone()[0]


def read_sqlite(path: str, table: str, columns: Sequence[str] | None = None, where: str | None = None, partitions: int | None = None) -> DataFrame:
    """A table of a SQLite file that all executors can open or fetch from a store, read in ranges of its row ids.

    ``columns`` and ``where`` (SQL) are evaluated by SQLite.
    """
    spark = session()
    kinds = sqlite_columns(path, table)
    names = list(kinds) if columns is None else list(columns)
    if missing := [c for c in names if c not in kinds]:
        raise ValueError(f"no columns {missing} in {table}")
    schema = T.StructType([T.StructField(c, kinds[c]) for c in names])
    with _open(path) as db:
        lo, hi = db.execute(f'SELECT min(rowid), max(rowid) FROM "{table}"').fetchone()
    if lo is None:
        return spark.createDataFrame([], schema)
    parts = partitions or max(1, min(spark.sparkContext.defaultParallelism, (hi - lo + 1) // 20_000 + 1))
    query = "SELECT {} FROM \"{}\" WHERE rowid >= ? AND rowid < ?{}".format(", ".join(f'"{c}"' for c in names), table, f" AND ({where})" if where else "")
    arrow = {T.LongType(): pa.int64(), T.DoubleType(): pa.float64(), T.StringType(): pa.string(), T.BinaryType(): pa.binary()}
    step = (hi - lo + parts) // parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in b.column(0).to_pylist():
                with _open(path) as db:
                    cursor = db.execute(query, (lo + i * step, lo + (i + 1) * step))
                    while rows := cursor.fetchmany(5000):
                        cols = []
                        for values, f in zip(zip(*rows, strict=True), schema, strict=True):
                            if isinstance(f.dataType, T.StringType):
                                values = [None if v is None else str(v) for v in values]
                            elif isinstance(f.dataType, T.DoubleType):
                                values = [None if v is None or v == "" else float(v) for v in values]
                            cols.append(pa.array(values, arrow[f.dataType]))
                        yield pa.RecordBatch.from_arrays(cols, names=names)

    return spark.range(0, parts, 1, parts).mapInArrow(run, schema)


def load_index(path: str) -> DataFrame:
    """A delimited index file, all columns as text."""
    return session().read.csv(str(path), header=True)


def load_location_metadata(source: str | DataFrame, image_key: Sequence[str]) -> DataFrame:
    """A table of images as text columns; a path must end in .csv or .parquet."""
    if str(source).startswith("s3a://"):
        anonymous_s3(session())
    if isinstance(source, DataFrame):
        df = source
    elif str(source).endswith(".csv"):
        df = session().read.csv(str(source), header=True)
    elif is_parquet_file(str(source)):
        df = session().read.parquet(str(source))
    else:
        raise ValueError("metadata must be a .csv or .parquet path or a DataFrame")
    if missing := [c for c in image_key if c not in df.columns]:
        raise ValueError(f"image key columns {missing} are not in the metadata")
    return df.select(*[F.col(c).cast("string") for c in df.columns])


def anonymous_s3(spark: SparkSession) -> None:
    """Let s3a:// paths of public buckets be read without credentials."""
    spark._jsc.hadoopConfiguration().set("fs.s3a.aws.credentials.provider", "org.apache.hadoop.fs.s3a.AnonymousAWSCredentialsProvider")


def collated(folder: str, plate: str, tables: Sequence[str] = ("Image", "Cells", "Cytoplasm", "Nuclei")) -> dict[str, DataFrame]:
    """Tables of a plate from ``folder``/<site>/<table>.csv, columns but keys prefixed by their
    compartment, with the plate's name; TableNumber is the site's place in the sorted folder."""
    spark, out = session(), {}
    sites = _children(spark, folder)[1]
    number = F.element_at(F.create_map(*[x for i, s in enumerate(sites) for x in (F.lit(s), F.lit(i + 1).cast("long"))]), F.element_at(F.split(F.input_file_name(), "/"), -2))
    for t in tables:
        df = spark.read.csv(f"{folder}/*/{t}.csv", header=True, inferSchema=True, enforceSchema=False)
        df = df.withColumn("TableNumber", number)
        keys = {"ImageNumber", "ObjectNumber", "TableNumber"}
        if t.lower() == "image":
            df = df.withColumn(f"{METADATA}Plate", F.lit(plate))
        else:
            df = df.toDF(*[c if c in keys or c.startswith(f"{t}_") else f"{t}_{c}" for c in df.columns])
        out[t.lower()] = df
    return out


_DECLARED = {T.LongType: "INTEGER", T.IntegerType: "INTEGER", T.ShortType: "INTEGER", T.ByteType: "INTEGER", T.BooleanType: "INTEGER", T.DoubleType: "REAL", T.FloatType: "REAL"}


def _sqlite(path: str) -> sqlite3.Connection:
    """A new file that one task writes; it is put in place, or read, only when it is whole, so it needs no journal."""
    db = sqlite3.connect(path, isolation_level=None)
    for setting in ("journal_mode = OFF", "synchronous = OFF", "locking_mode = EXCLUSIVE"):
        db.execute(f"PRAGMA {setting}")
    return db


def write_sqlite(tables: Mapping[str, DataFrame], output_file: str, indexes: Sequence[tuple[str, Sequence[str]]] = ()) -> str:
    """A SQLite file of the tables, with an index for each (table, columns), in a folder that driver and executors share.

    Each task writes its rows into a file of its own; one task copies these files' tables, in order of their partitions, into
    one file, indexes it and puts it in place when it is whole.  The driver receives the names of files only.
    """
    output_file = os.path.abspath(output_file)
    folder = f"{output_file}.{uuid.uuid4().hex}"
    os.makedirs(folder)
    made: list[tuple[str, str, list[str]]] = []

    def pieces(create: str, insert: str):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            task = TaskContext.get()
            file = f"{folder}/{task.partitionId():06d}-{task.taskAttemptId()}"
            db = None
            for b in batches:
                if b.num_rows:
                    if db is None:
                        db = _sqlite(file)
                        db.execute(create)
                        db.execute("BEGIN")
                    db.executemany(insert, zip(*(c.to_pylist() for c in b.columns), strict=True))
            if db is not None:
                db.execute("COMMIT")
                db.close()
                yield pa.RecordBatch.from_arrays([pa.array([file])], names=["file"])

        return run

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part = f"{folder}/whole-{TaskContext.get().taskAttemptId()}"
            with contextlib.closing(_sqlite(part)) as db:
                for name, create, files in made:
                    db.execute(create)
                    for file in files:
                        db.execute("ATTACH ? AS piece", (file,))
                        db.execute(f'INSERT INTO main."{name}" SELECT * FROM piece."{name}"')
                        db.execute("DETACH piece")
                for i, (name, columns) in enumerate(indexes):
                    listed = ", ".join(f'"{c}"' for c in columns)
                    db.execute(f'CREATE INDEX "{name}_index_{i}" ON "{name}" ({listed})')
            os.replace(part, output_file)
            yield b

    try:
        for name, df in tables.items():
            plain = df.select(*[F.col(f"`{f.name}`") if type(f.dataType) in _DECLARED else F.col(f"`{f.name}`").cast("string").alias(f.name) for f in df.schema])
            columns = ", ".join(f'"{f.name}" {_DECLARED.get(type(f.dataType), "TEXT")}' for f in df.schema)
            create = f'CREATE TABLE "{name}" ({columns})'
            files = plain.mapInArrow(pieces(create, f'INSERT INTO "{name}" VALUES ({", ".join("?" * len(df.columns))})'), "file string").collect()
            made.append((name, create, sorted(r.file for r in files)))
        session().range(0, 1, 1, 1).mapInArrow(whole, "id long").collect()
    finally:
        shutil.rmtree(folder, ignore_errors=True)
    if not os.path.exists(output_file):
        raise RuntimeError(f"{output_file} isn't in a folder that driver and executors share")
    return output_file


def collate(folder: str, plate: str, output_file: str, tables: Sequence[str] = ("Image", "Cells", "Cytoplasm", "Nuclei")) -> str:
    """The SQLite file of a plate, with indexes on the keys that compartments are joined by."""
    frames = {t.title(): df for t, df in collated(folder, plate, tables).items()}
    image = [("Image", ["TableNumber", "ImageNumber"]), ("Image", [f"{METADATA}Plate", f"{METADATA}Well"])]
    indexes = [(t, c) for t, c in image if t in frames and set(c) <= set(frames[t].columns)]
    indexes += [(t, c) for t in frames if t != "Image" for c in (["TableNumber", "ImageNumber"], ["TableNumber", "ImageNumber", "ObjectNumber"])]
    return write_sqlite(frames, output_file, indexes)
