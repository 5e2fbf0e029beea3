"""CSV whose quoted fields hold line breaks, read in byte ranges of a file rather than a file to a task.

Whether a line break ends a record depends on the quotes before it. A first
scan counts the quotes of every range; the running parity over the ranges of a
file tells which of them begin inside quotes. A second scan then cuts each range
into records on its own. What a range cannot finish, the end of it and the
lines up to its first record, are fragments, at most two a range, and are put
together in order.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.operators.joins import fits_broadcast
from tablewright.session import materialize, ship_package
from tablewright.sources.tables import CORRUPT

WHOLE, OPENING, GOING_ON = 0, 1, 2


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """file, start (of the byte range), mid (place) and value of every line."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("mid"), "value",
    )


def _quotes(value) -> F.Column:
    return F.length(value) - F.length(F.replace(value, F.lit('"'), F.lit("")))


def starts_inside(lines: DataFrame) -> DataFrame:
    """file, start, inside: whether a byte range begins within quotes, and windows: whether the first line of the file ends in \\r."""
    parity = lines.groupBy("file", "start").agg(
        (F.sum(_quotes(F.col("value"))) % 2).alias("odd"), F.min_by(F.endswith("value", F.lit("\r")), "mid").alias("first")
    )
    # A row for each range of a file.
    file = Window.partitionBy("file").orderBy("start")
    odd = F.coalesce(F.sum("odd").over(file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) % 2
    return parity.select("file", "start", (odd == 1).alias("inside"), F.first("first").over(file).alias("windows"))


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Records and fragments of the ranges of a task, whose lines come in order."""
    now, held, inside, going_on, at = None, [], False, False, 0

    def row(kind: int) -> tuple:
        return (*now, at, kind, "\n".join(held))

    for batch in batches:
        out = []
        quotes = batch["value"].str.count('"')
        columns = [batch[c] for c in ("file", "start", "inside", "windows", "value")]
        for file, start, begins, windows, value, n in zip(*columns, quotes, strict=True):
            if (file, start) != now:
                if held:
                    out.append(row(GOING_ON if going_on else OPENING))
                now, held, inside, going_on, at = (file, start), [], begins, begins, 0
            # Breaks of such a file read as \n, inside quotes too, as in Spark's own reader.
            held.append(value.removesuffix("\r") if windows else value)
            inside ^= bool(n % 2)
            if not inside:
                out.append(row(GOING_ON if going_on else WHOLE))
                held, going_on, at = [], False, at + 1
        yield pd.DataFrame(out, columns=["file", "start", "at", "kind", "text"])
    if held:
        yield pd.DataFrame([row(GOING_ON if going_on else OPENING)], columns=["file", "start", "at", "kind", "text"])


def records(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """file, start, at and text of every record that is not blank; without the first of each file if it is a header."""
    ship_package(spark)
    lines = _lines(spark, path)
    starts = materialize(starts_inside(lines), "ranges")
    if fits_broadcast(starts):
        known = lines.join(F.broadcast(starts), ["file", "start"])
    else:
        known = lines.join(starts, ["file", "start"]).sortWithinPartitions("file", "start", "mid")
    schema = "file string, start long, at long, kind int, text string"
    pieces = materialize(known.select("file", "start", "inside", "windows", "value").mapInPandas(_cut, schema), "records")
    order = Window.partitionBy("file").orderBy("start", "at")
    # At most two fragments a range; one that opens a record begins a group.
    parts = pieces.where(F.col("kind") != WHOLE).withColumn("group", F.sum((F.col("kind") == OPENING).cast("int")).over(order))
    joined = parts.groupBy("file", "group").agg(F.sort_array(F.collect_list(F.struct("start", "at", "text"))).alias("p"))
    stitched = joined.select("file", F.col("p")[0]["start"].alias("start"), F.col("p")[0]["at"].alias("at"), F.array_join(F.col("p.text"), "\n").alias("text"))
    every = pieces.where(F.col("kind") == WHOLE).select("file", "start", "at", "text").unionByName(stitched)
    every = every.where("text <> ''")
    return every.where(~((F.col("start") == 0) & (F.col("at") == 0))) if header else every


def read_records(
    spark: SparkSession, path: str, schema: T.StructType, columns: Sequence[str] | None = None, null_value: str = "",
    keep_malformed: bool = False, header: bool = True, date_format: str = "yyyy-MM-dd",
) -> DataFrame:
    """The rows that :func:`read_items` gives with ``multiline``, from any number of tasks a file.

    A quote inside an unquoted field is not CSV and shifts the parity of all
    that follows; such files need ``read_items``.
    """
    if keep_malformed:
        schema = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    options = {
        "quote": '"', "escape": '"', "nullValue": null_value, "emptyValue": "", "dateFormat": date_format, "mode": "PERMISSIVE",
        "columnNameOfCorruptRecord": CORRUPT,
    }
    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    rows = records(spark, path, header).select(F.from_csv("text", names, options).alias("r")).select("r.*")
    return rows.select(*columns, *([CORRUPT] if keep_malformed else [])) if columns else rows
