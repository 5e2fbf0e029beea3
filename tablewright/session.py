"""Session helpers and the one place where intermediate tables are kept."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Collection, Iterator, Mapping
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "tablewright", master: str | None = None, **conf) -> SparkSession:
    """A session with adaptive execution on and UTC timestamps.

    ``conf`` keys use ``__`` for dots: ``spark__sql__shuffle__partitions=8``.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), str(value))
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Give the Python workers this package, once a session.

    Functions that run in tasks are sent by the name of their module, so a
    worker needs the package wherever the driver was started from.
    """
    if getattr(spark.sparkContext, "_tablewright_shipped", False):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="tablewright-code-"), "tablewright_code.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        for folder, _, names in os.walk(package):
            for name in sorted(n for n in names if n.endswith(".py")):
                full = os.path.join(folder, name)
                archive.write(full, os.path.relpath(full, os.path.dirname(package)))
    spark.sparkContext.addPyFile(path)
    spark.sparkContext._tablewright_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder, reachable by all executors, that holds intermediate tables.

    It is the one the cluster names in ``spark.checkpoint.dir``. A folder of
    our own is made only in local mode, where driver and executors are one
    process.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tablewright-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


_STAGES: dict[str, list[str]] = {}


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _STAGES.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` as a URI of the file system that Spark takes it from."""
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(hadoop).toString()


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def remove_stages(spark: SparkSession, keep: Collection[str] = ()) -> int:
    """Delete the intermediate tables of this session, once their results are read.

    Only paths that :func:`fresh_path` gave out are touched. Returns how many.
    """
    mine = _STAGES.get(spark.sparkContext.applicationId, [])
    gone = [p for p in mine if p not in keep]
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in gone:
        hadoop = jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(conf).delete(hadoop, True)
        mine.remove(path)
    return len(gone)


@contextmanager
def stages(spark: SparkSession) -> Iterator[None]:
    """Remove what is stored inside the block when it ends; read the results in it."""
    before = set(_STAGES.get(spark.sparkContext.applicationId, []))
    try:
        yield
    finally:
        remove_stages(spark, before)


def plain_bytes(df: DataFrame) -> Column | None:
    """Aggregate for the size of ``df`` in memory; None where a type has no plain size."""
    kinds = dict(df.dtypes)
    if any(t.startswith(("map", "struct")) or (t.startswith("array") and ("<" in t[6:] or "string" in t)) for t in kinds.values()):
        return None
    wide = [F.coalesce(F.sum(F.octet_length(f"`{c}`")), F.lit(0)) for c, t in kinds.items() if t in ("string", "binary")]
    listed = [F.coalesce(F.sum(F.size(f"`{c}`")), F.lit(0)) * 8 for c, t in kinds.items() if t.startswith("array")]
    fixed = F.count(F.lit(1)) * (16 + 8 * len(kinds))
    return reduce(lambda a, b: a + b, [fixed, *wide, *listed]).cast("long")


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage, survives lost executors, and freezes values such as row
    numbers that must not change when a task is run again. The size is
    measured while the table is written and kept with the result.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    size = plain_bytes(df)
    measured = Observation()
    watched = df if size is None else df.observe(measured, size.alias("bytes"))
    watched.write.mode("errorifexists").option("compression", "zstd").parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored._stored_bytes = None if size is None else measured.get["bytes"]
    stored._stored_path = path
    return stored


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more."""
    for df in tables:
        mine = _STAGES.get(df.sparkSession.sparkContext.applicationId, [])
        remove_stages(df.sparkSession, [p for p in mine if p != df._stored_path])


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of plans that nothing refers to any more; else they wait for the driver's next collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def materialize_all(tables: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Store several independent tables; their jobs share the cluster."""
    if not tables:
        return {}
    spark = next(iter(tables.values())).sparkSession
    # Job group, pool and other local properties of the caller hold in the threads too.
    store = inheritable_thread_target(spark)(lambda item: materialize(item[1], item[0]))
    with ThreadPoolExecutor(max_workers=min(8, len(tables))) as pool:
        stored = pool.map(store, tables.items())
        return dict(zip(tables, stored, strict=True))
