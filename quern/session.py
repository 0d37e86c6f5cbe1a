"""Session-level services: shared scratch space, code shipping, size-checked joins."""

from __future__ import annotations

import atexit
import contextlib
import io
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_own_scratch: dict[str, str] = {}
_shipped: set[str] = set()
_written: dict[str, list[str]] = {}
_owner: list[str] = []

#: A side of at most so many rows and bytes may be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 48_000_000


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share, taken from ``spark.checkpoint.dir``.

    Where the setting is absent and the master is local (tests), a temporary
    folder is made once per application and removed at exit. On a cluster an
    absent setting is an error: a machine-local folder would not survive the
    loss of an executor.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if root:
        return root
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = sc.applicationId
    if app not in _own_scratch:
        _own_scratch[app] = tempfile.mkdtemp(prefix="quern-scratch-")
        atexit.register(shutil.rmtree, _own_scratch[app], ignore_errors=True)
        sc.setCheckpointDir(_own_scratch[app])
    return _own_scratch[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder, in this application's own part."""
    return f"{scratch_root(spark).rstrip('/')}/quern/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    This cuts lineage durably: a lost executor costs nothing that was written.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    _written.setdefault(_owner[-1] if _owner else "", []).append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scratch_of(spark: SparkSession, owner: str):
    """Tables that ``materialize`` writes inside belong to ``owner``; those that
    it had before are deleted. For steps whose results are written by the
    caller before the next step of the same owner begins."""
    for path in _written.pop(owner, []):
        fs, p = filesystem(spark, path)
        fs.delete(p, True)
    _owner.append(owner)
    try:
        yield
    finally:
        _owner.pop()


def clear_scratch(spark: SparkSession) -> None:
    """Delete every table that this application wrote under the shared folder;
    DataFrames that still read them are of no use afterwards."""
    _written.clear()
    fs, p = filesystem(spark, f"{scratch_root(spark).rstrip('/')}/quern/{spark.sparkContext.applicationId}")
    fs.delete(p, True)


def filesystem(spark: SparkSession, path: str):
    """The Hadoop FileSystem and Path objects of ``path``."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = filesystem(spark, path)
    return fs.exists(p)


def ship_code(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    here = str(Path(__file__).resolve().parent)
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(here):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.join("quern", os.path.relpath(full, here)))
    fs, at = filesystem(spark, f"{scratch_path(spark, 'code')}/quern_{app.replace('-', '_')}.zip")
    out = fs.create(at, True)
    out.write(buf.getvalue())
    out.close()
    spark.sparkContext.addPyFile(fs.makeQualified(at).toString())
    _shipped.add(app)
    # whole texts are long: smaller Arrow batches, unless the session sets its own
    if "spark.sql.execution.arrow.maxRecordsPerBatch" not in dict(spark.conf.getAll):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def spread(scan: DataFrame) -> DataFrame:
    """A table scan over all cores, for tables of fewer splits than cores (one
    small file is one task). Larger tables stay as they are: no shuffle."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def _width(df: DataFrame) -> Column:
    """About how many bytes a row has in memory."""
    total = F.lit(8 * (len(df.columns) + 1))
    for f in df.schema:
        kind = f.dataType
        if isinstance(kind, (T.StringType, T.BinaryType)):
            total = total + F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0))
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.NumericType):
            total = total + F.coalesce(F.greatest(F.size(F.col(f"`{f.name}`")), F.lit(0)) * 8, F.lit(0))
        elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
            total = total + F.coalesce(F.length(F.to_json(F.struct(F.col(f"`{f.name}`")))), F.lit(0))
    return total.cast("long")


def fits_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` has at most so many rows and bytes. Give it a written
    table: the plan runs for this."""
    found = df.agg(F.count("*").alias("rows"), F.sum(_width(df)).alias("size")).first()
    return found["rows"] <= rows and (found["size"] or 0) <= size


def checked_join(big: DataFrame, small: DataFrame, on, how: str = "inner", rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join that broadcasts ``small`` only after measuring it, else shuffles both."""
    return big.join(F.broadcast(small) if fits_broadcast(small, rows) else small, on, how)


def fresh_name(df: DataFrame, base: str) -> str:
    """A column name that no column of ``df`` has, whatever the case."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name = "_" + name
    return name
