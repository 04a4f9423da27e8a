"""Where tables come from. Schemas are declared or stored with the data, never inferred."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from ..plans.registry import GateError

#: JDBC options that would let a server run more than the engine's own queries, or read local files.
UNSAFE_JDBC = frozenset({"allowmultiqueries", "allowloadlocalinfile", "allowurlinlocalinfile", "autodeserialize", "allowcleartextpasswords", "sessioninitstatement", "preparequery"})


def parquet(spark: SparkSession, folder: str, table: str, allowed: tuple[str, ...] | None = None) -> DataFrame:
    if "\0" in table or not table or allowed is not None and table not in allowed:
        raise GateError("unsupported: table out of scope")
    return spark.read.parquet(f"{folder.rstrip('/')}/{table}.parquet")


def tables(spark: SparkSession, folder: str, allowed: tuple[str, ...]) -> list[str]:
    """The allowed tables that are there, by name."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(folder)
    names = {s.getPath().getName() for s in p.getFileSystem(conf).listStatus(p)}
    return sorted(t for t in allowed if f"{t}.parquet" in names)


def text_file(spark: SparkSession, path: str, schema: str, kind: str) -> DataFrame:
    """CSV, JSON or ORC with a declared schema; broken rows stop the read."""
    if kind == "orc":
        return spark.read.schema(schema).orc(path)
    r = spark.read.schema(schema).option("mode", "FAILFAST")
    return r.csv(path, header=True) if kind == "csv" else r.json(path)


def jdbc(spark: SparkSession, url: str, table: str, options: dict[str, str], key: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 1) -> DataFrame:
    """A read-only JDBC read, in parallel ranges of an integer key; needs the database's driver on the class path."""
    if any(k.lower() in UNSAFE_JDBC for k in options) or any(u in url.lower() for u in UNSAFE_JDBC):
        raise GateError("unsafe: jdbc option")
    r = spark.read.format("jdbc").option("url", url).option("dbtable", table).option("fetchsize", "10000").options(**options)
    if key and bounds:
        r = r.option("partitionColumn", key).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", parts)
    return r.load()


def sqlite_url(path: str, read_only: bool = True) -> str:
    """A checked SQLite path as a JDBC URL."""
    if not os.path.isabs(path) or not os.path.isfile(path) or "?" in path:
        raise GateError("invalid: sqlite path")
    return f"jdbc:sqlite:file:{path}?mode={'ro' if read_only else 'rw'}"


def key_from_file(path: str) -> bytes:
    raw = open(path, "rb").read(4097) if os.path.isfile(path) else b""
    if not 32 <= len(raw) <= 4096:
        raise GateError("invalid: key file")
    return raw
