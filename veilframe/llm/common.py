"""Session helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space of the query contracts: blank and U+0009 to U+000D.
WS = "\t\n\x0b\x0c\r "
WS_CLASS = r"[\x20\x09-\x0D]"
_made: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows that a Python worker gets at a time, unless the session says another number: texts may be long.
ROWS_IN_BATCH = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package on every executor, once per application, and bound what they hold."""
    sc = spark.sparkContext
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, str(ROWS_IN_BATCH))
    if getattr(sc, "_veilframe_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp()) / "veilframe_code.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent).as_posix())
    sc.addPyFile(str(target))
    sc._veilframe_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only where none is set, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='veilframe_ck_')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Spark drops the shuffle files of a write as soon as it has ended; nothing else reads them.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write to the shared folder as Parquet and read it again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}_{uuid.uuid4().hex}"
    with _shuffles_dropped(spark):
        df.write.option("compression", "zstd").parquet(path)
    _made.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._veilframe_path = path
    return out


def release(spark: SparkSession, *done: DataFrame) -> None:
    """Delete materialized tables that nothing reads any more; other tables stay as they are."""
    paths = {getattr(df, "_veilframe_path", None) for df in done}
    for found in [x for x in _made if x[1] in paths]:
        _made.remove(found)
        _delete(*found)


#: Row keys that may be broadcast (16 bytes each); beyond, joins shuffle.
BROADCAST_IDS = 1_000_000


def keyed(docs: DataFrame) -> list[Column]:
    """doc_id, and th, which tells texts of one doc_id apart."""
    return [docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(docs["text"].cast("string")).alias("th")]


def fresh(name: str, *frames: DataFrame) -> str:
    """A column name that none of the frames has, in any case of letters."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def drop_materialized() -> None:
    """Remove what materialize() wrote; called at exit, or by a caller once results are written."""
    while _made:
        spark, path = _made.pop()
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session has ended; the folder's owner cleans up
            return


atexit.register(drop_materialized)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_of(docs: DataFrame, column: str = "text") -> Column:
    return F.coalesce(docs[column].cast("string"), F.lit(""))


def env_int(name: str, default: int) -> int:
    return int(os.environ.get(name, default))
