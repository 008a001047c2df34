"""Small helpers that the corpus operators share: written intermediate tables and stable row hashes."""

from __future__ import annotations

import atexit
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word characters end at these; the same class in Java, Python and RE2.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"

_written: list[tuple[SparkSession, str]] = []
_scopes = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, or a temporary one where that is unset (local mode, tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.gettempdir() + "/tenderspring-checkpoints"
    return where.rstrip("/")


def new_path(spark: SparkSession, name: str, outer: bool = False) -> str:
    """A fresh path in the shared folder. What is written there goes when the innermost scratch() ends (outer:
    the one around it), or when the driver's Python ends if there is none."""
    path = f"{shared_dir(spark)}/tenderspring/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    scopes = getattr(_scopes, "open", [])[: -1 if outer else None]
    (scopes[-1] if scopes else _written).append((spark, path))
    return path


@contextmanager
def scratch() -> Iterator[None]:
    """Tables settled within go at its end, but for those settled with outer=True. So an operator leaves its
    result alone on disk, however many intermediate tables it takes."""
    _scopes.open = [*getattr(_scopes, "open", []), []]
    try:
        yield
    finally:
        *_scopes.open, mine = _scopes.open
        for spark, path in mine:
            drop_path(spark, path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes a path that new_path gave, with the Hadoop file system of that path."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def collected(spark: SparkSession) -> None:
    """Has the driver's JVM collect its garbage. Spark deletes the shuffle files and broadcasts of a finished query when
    its plan is collected, by itself every half an hour or when the heap is full: much later than they are done with."""
    spark.sparkContext._jvm.System.gc()


def _drop_all() -> None:
    for spark, path in _written:
        try:
            drop_path(spark, path)
        except Exception:  # noqa: BLE001 - the JVM may be gone by now; the folder is then left to its owner
            return


atexit.register(_drop_all)


def settle(df: DataFrame, name: str = "table", batch_rows: int | None = None, outer: bool = False) -> DataFrame:
    """Writes df to the shared folder and reads it back, so that later steps neither recompute it nor
    depend on executors that may be lost. batch_rows: of Arrow batches meanwhile, for columns of long texts.
    outer: the table outlives the innermost scratch()."""
    spark, path, setting = df.sparkSession, new_path(df.sparkSession, name, outer), "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    if batch_rows:
        spark.conf.set(setting, str(min(batch_rows, int(before)) if int(before) > 0 else batch_rows))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(setting, before)
    collected(spark)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """Rows kept from learning: crc32 of the id as text leaves 2 when divided by 4. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def free_name(name: str, df: DataFrame) -> str:
    """The name, with as many underscores before it as keep it from being one of df's columns."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = "_" + name
    return name
