"""Image files in and out, and the keys that link them to items."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.session import qualified


def image_key(c, extension: str = ".jpg") -> Column:
    """Last path segment without query, fragment and file extension."""
    c = F.col(c) if isinstance(c, str) else c
    base = F.regexp_replace(c, r"[?#].*$", "")
    last = F.element_at(F.split(base, "/"), -1)
    return F.regexp_replace(last, r"\Q" + extension + r"\E$", "")


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """All images of a folder as (image, height, width, nChannels, mode, data).

    A file that cannot be decoded keeps its key with null pixels. ``data``
    holds rows of B, G, R bytes.
    """
    raw = spark.read.format("image").option("dropInvalid", False).load(path)
    name = F.element_at(F.split(F.col("image.origin"), "/"), -1)
    ok = F.col("image.height") > 0
    fields = [
        F.when(ok, F.col(f"image.{f}")).alias(f)
        for f in ("height", "width", "nChannels", "mode", "data")
    ]
    return raw.select(F.regexp_replace(name, r"\.[A-Za-z]+$", "").alias("image"), *fields)


def write_images(df: DataFrame, path: str) -> DataFrame:
    """Write (image, data) rows, encoded pictures, as files from the tasks.

    ``path`` is taken as Spark takes it, from the default file system unless it
    names one. Files are written under a name of their own and renamed when
    they are whole, so a task that runs twice replaces its files. Returns a one-row
    DataFrame with the number of files.
    """
    target = qualified(df.sparkSession, path)

    def save(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        # Hadoop writes a local path with one slash.
        uri = target if "://" in target else target.replace("file:/", "file:///", 1)
        system, folder = fs.FileSystem.from_uri(uri)
        system.create_dir(folder, recursive=True)
        n = 0
        for batch in batches:
            for row in batch.itertuples(index=False):
                part = f"{folder}/.{row.image}.{uuid.uuid4().hex}"
                with system.open_output_stream(part) as out:
                    out.write(row.data)
                system.move(part, f"{folder}/{row.image}.png")
                n += 1
        yield pd.DataFrame({"n": [n]})

    files = df.select("image", "data").mapInPandas(save, "n long")
    return files.agg(F.sum("n").alias("n_files"))
