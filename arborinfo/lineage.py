"""Cutting lineage through a shared folder, small driver-made tables, shipping our code."""

from __future__ import annotations

import atexit
import logging
import tempfile
import uuid
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


_local_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: ``spark.checkpoint.dir`` of the session.

    Only a local master may run without that setting; a machine-local folder would not be
    readable from other executors.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can read")
    application = spark.sparkContext.applicationId
    if application not in _local_dirs:
        _local_dirs[application] = tempfile.mkdtemp(prefix="arborinfo-")
    return _local_dirs[application]


_written: list[str] = []


def remove_written(spark: SparkSession) -> None:
    """Delete the tables that ``materialize`` wrote, as the application ends."""
    try:
        configuration = spark.sparkContext._jsc.hadoopConfiguration()
        for name in _written:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(configuration).delete(path, True)
    except Exception as error:  # the JVM may have gone before; the folder is then left to its owner
        logging.getLogger("arborinfo").debug("intermediate tables stay: %s", error)
    _written.clear()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder, deleted as the application ends."""
    path = f"{shared_dir(spark).rstrip('/')}/arborinfo/{name}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(remove_written, spark)
    _written.append(path)
    return path


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The result has no lineage (a lost executor re-reads files instead of recomputing), and
    its size is known to the optimizer, so joins against it are planned by real size.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


# Rows up to which a derived table is held as a local relation instead of files.
SMALL_ROWS = 20_000


def settle(df: DataFrame, name: str = "stage", rows: int = SMALL_ROWS) -> DataFrame:
    """Cut the lineage of a table that is cheap to compute and usually small.

    Tables about variables, components or their states mostly have a few rows; up to ``rows``
    they become local relations, beyond they are written like any other. Not for results of a
    pass over the data: a table that turns out large is computed a second time.
    """
    head = df.limit(rows + 1).toArrow()
    if head.num_rows <= rows:
        return df.sparkSession.createDataFrame(head, schema=df.schema)
    return materialize(df, name)


def local_table(spark: SparkSession, rows: list[dict], schema: pa.Schema) -> DataFrame:
    """A small driver-made table as a local relation (Arrow, no Python job)."""
    return spark.createDataFrame(pa.Table.from_pylist(rows, schema=schema))


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python tasks, once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="arborinfo-code-")) / f"{root.name}.zip"
    with zipfile.ZipFile(target, "w") as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, source.relative_to(root.parent))
    # Spark hands the file to every executor.
    context.addPyFile(str(target))
    _shipped.add(context.applicationId)


def broadcast(spark: SparkSession, value):
    """A broadcast variable for Python tasks that may hold objects of this package."""
    ship_package(spark)
    return spark.sparkContext.broadcast(value)
