"""Session-level helpers shared by the operators: shared storage and tables."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema

from phenolith.llm.kernel import release

#: Bytes of rows that a task holds before it writes them as a row group.
GROUP = 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Where the session names none, a temporary folder is set, on local masters only.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="phenolith-")
        spark.sparkContext.setCheckpointDir(path)
        path = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return path


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


#: Lets Spark delete a plan's shuffle files as soon as it has run.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def _cleaned(spark: SparkSession):
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEAN, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder with Spark's writer and read it back."""
    path = f"{shared_dir(df.sparkSession)}/phenolith/{name}-{uuid.uuid4().hex}"
    with _cleaned(df.sparkSession):
        df.write.parquet(path)
    return _noted(df.sparkSession.read.schema(df.schema).parquet(path), path)


Batches = Iterator[pa.RecordBatch]


def stored(df: DataFrame, name: str, run: Callable[[Batches], Batches] | None = None, schema: str | None = None) -> DataFrame:
    """Write ``df``, or what ``run`` makes of it (as ``mapInArrow``), as Parquet into the shared folder and read
    it back: lineage is cut, a lost executor costs a re-read instead of a recomputation, and shuffle files of
    the plan go once it is written.

    On a ``file:`` folder Hadoop's writer starts a process for every file to set its
    mode, and holds row groups of 128 MB on the heap.  There, tasks write their rows
    themselves, under hidden names, in the Python process that makes them; the driver shows the files of the
    attempts that succeeded.  Other file systems get Spark's own writer.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/phenolith/{name}-{uuid.uuid4().hex}"
    fs, folder = _hadoop(spark, path)
    if fs.getScheme() != "file":
        return written(df if run is None else df.mapInArrow(run, schema), name)
    fs.mkdirs(folder)
    local = folder.toUri().getPath()
    kind = df.schema if run is None else spark.createDataFrame([], schema).schema
    arrow = None if run is None else to_arrow_schema(kind)

    def write(batches: Batches) -> Batches:
        task = TaskContext.get()
        file = f"part-{task.partitionId():06d}-{task.taskAttemptId()}.parquet"
        held: list[pa.RecordBatch] = []
        writer, size = None, 0

        def flush() -> None:
            rows = pa.Table.from_batches(held)
            writer.write_table(rows if arrow is None else rows.cast(arrow))
            held.clear()

        for b in batches if run is None else run(batches):
            if not b.num_rows:
                continue
            held.append(b)
            size += b.nbytes
            if writer is None:
                writer = pq.ParquetWriter(f"{local}/_{file}", arrow or b.schema, filesystem=pafs.LocalFileSystem(), compression="zstd", use_dictionary=False)
            if size > GROUP:
                flush()
                size = 0
        if writer is not None:
            if held:
                flush()
            writer.close()
        release()
        if writer is not None:
            yield pa.RecordBatch.from_arrays([pa.array([file])], names=["file"])

    with _cleaned(spark):
        done = [r.file for r in df.mapInArrow(write, "file string").collect()]  # a name for each task
    for file in done:
        fs.rename(spark._jvm.org.apache.hadoop.fs.Path(folder, f"_{file}"), spark._jvm.org.apache.hadoop.fs.Path(folder, file))
    return _noted(spark.read.schema(kind).parquet(path), path)


def _noted(df: DataFrame, path: str) -> DataFrame:
    df._stored_at = path
    return df


def forget(*tables: DataFrame) -> None:
    """Delete tables of ``stored`` that nothing reads any more."""
    for df in tables:
        if path := getattr(df, "_stored_at", None):
            fs, folder = _hadoop(df.sparkSession, path)
            fs.delete(folder, True)


#: Bytes of a source that a task reads and a file holds, at least, while every core has some tasks.
FILE, TASKS = 64 << 20, 2


#: Settings for rows that hold whole texts, with Spark's defaults, which are meant for rows of some bytes:
#: 64 MB of a batch in flight to each Python worker, 4,096 texts in a reader's batch, 128 MB of a row group on a writer's heap.
_TEXTS = {"spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "4194304b"), "spark.sql.parquet.columnarReaderBatchSize": ("4096", "512"), "parquet.block.size": ("134217728", "33554432")}


def tuned(spark: SparkSession) -> SparkSession:
    """The session, with settings for texts where it has Spark's defaults."""
    for key, (default, value) in _TEXTS.items():
        if spark.conf.get(key, default) == default:
            spark.conf.set(key, value)
    return spark


def merged(df: DataFrame, source: DataFrame | None = None) -> DataFrame:
    """``df`` without partitions that are small beside its source (by default itself): each starts a
    Python task, with models and indexes of its own, and makes a file.  No shuffle."""
    tuned(df.sparkSession)
    size = int((df if source is None else source)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.coalesce(max(min(-(-size // FILE), 1 << 30), TASKS * df.sparkSession.sparkContext.defaultParallelism))  # an unknown size is very large


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tuned(spark).read.parquet(f"{sf_dir}/{name}.parquet")
