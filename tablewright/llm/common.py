"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession

from tablewright.session import materialize, ship_package

#: Rows of an Arrow batch sent to a Python worker. Texts are long, so the
#: default of 10,000 rows could be a gigabyte; a batch only sets the memory used.
BATCH_ROWS = 500


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound the memory of Python workers, a smaller setting is left alone, and give them this package."""
    ship_package(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder, read it back, and let go of what it was made of.

    Shuffle files live until the driver collects the plan that wrote them,
    which by default may take half an hour; a stored table needs none of them.
    """
    stored = materialize(df, name)
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return stored


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, in any letter case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def words_of(data: bytes) -> list[bytes]:
    """Runs of anything but space and \\t \\n \\v \\f \\r: what ``bytes.split`` takes as white space."""
    return data.split()
