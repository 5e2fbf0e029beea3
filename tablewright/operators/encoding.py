"""Categorical encoding: dictionaries, dense ids, one-hot columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.operators.joins import attach, fits_broadcast
from tablewright.operators.ordering import global_index
from tablewright.session import materialize

MISSING = "nan"
MAX_CARDINALITY = 3000


def _text(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(MISSING))


def string_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [c for c, t in df.dtypes if t == "string" and c not in exclude]


def encodable(dfs: Sequence[DataFrame], max_card: int = MAX_CARDINALITY, exclude: Sequence[str] = ()) -> list[str]:
    """String columns with fewer than ``max_card`` distinct non-null values.

    One pass of sketches settles nearly every column; only those within a
    factor of two of the limit are counted exactly.
    """
    both = _stack(dfs)
    names = string_columns(both, exclude)
    if not names:
        return []
    rough = both.agg(*[F.approx_count_distinct(c, 0.02).alias(c) for c in names]).first()
    unsure = [c for c in names if max_card / 2 <= rough[c] <= max_card * 2]
    counts = dict(zip(names, rough, strict=True))
    for c in unsure:
        counts[c] = both.select(F.count_distinct(c)).first()[0]
    return [c for c in names if counts[c] < max_card]


def _stack(dfs: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def label_dictionary(dfs: Sequence[DataFrame], columns: Sequence[str], code_type: str = "int") -> DataFrame:
    """(column, value, code): codes 0..k-1 in code-point order of the values.

    Null is the value ``"nan"``. One aggregate covers all columns, and the
    values are ranked by ranges, so a column may have any number of them.
    A code that ``code_type`` cannot hold fails the job.
    """
    both = _stack(dfs).select(*columns)
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), _text(c).alias("value")) for c in columns])
    placed = global_index(both.select(F.inline(pairs)).distinct(), ["column", "value"], "_at")
    # As many rows as there are columns to code.
    first = placed.groupBy("column").agg(F.min("_at").alias("_first"))
    ranked = placed.join(F.broadcast(first), "column")
    return ranked.select("column", "value", (F.col("_at") - F.col("_first")).cast(code_type).alias("code"))


def extend_dictionary(dictionary: DataFrame, dfs: Sequence[DataFrame], columns: Sequence[str]) -> DataFrame:
    """A later version of a dictionary: known values keep their codes, new ones follow.

    The new values of a column are ranked in code-point order behind its highest
    code, by ranges, so there may be any number of them. Values that the tables
    no longer hold stay. Versions join by value, and equal codes mean the same.
    """
    both = _stack(dfs).select(*columns)
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), _text(c).alias("value")) for c in columns])
    seen = both.select(F.inline(pairs)).distinct()
    new = seen.join(dictionary.select("column", "value"), ["column", "value"], "left_anti")
    placed = global_index(new, ["column", "value"], "_at")
    # As many rows as there are columns to code.
    first = placed.groupBy("column").agg(F.min("_at").alias("_first"))
    top = dictionary.groupBy("column").agg((F.max("code") + 1).alias("_next"))
    ranked = placed.join(F.broadcast(first), "column").join(F.broadcast(top), "column", "left")
    code = F.coalesce("_next", F.lit(0)) + F.col("_at") - F.col("_first")
    added = ranked.select("column", "value", code.cast(dict(dictionary.dtypes)["code"]).alias("code"))
    return dictionary.select("column", "value", "code").unionByName(added)


def apply_dictionary(df: DataFrame, dictionary: DataFrame, columns: Sequence[str], unseen: int | None = None) -> DataFrame:
    """Replace values by codes; a value the dictionary lacks gets ``unseen``.

    A dictionary that is small enough as a whole is broadcast, so the table is
    not shuffled; otherwise each column is joined by its own size.
    """
    small = fits_broadcast(dictionary)
    out = df
    for c in columns:
        codes = dictionary.where(F.col("column") == c).select(
            F.col("value").alias(f"_v_{c}"), F.col("code").alias(f"_c_{c}")
        )
        if small:
            out = out.join(F.broadcast(codes), _text(c) == F.col(f"_v_{c}"), "left")
        else:
            out = attach(out.withColumn(f"_v_{c}", _text(c)), codes, f"_v_{c}")
    coded = {c: F.coalesce(F.col(f"_c_{c}"), F.lit(unseen)) if unseen is not None else F.col(f"_c_{c}") for c in columns}
    return out.select(*[coded[c].alias(c) if c in coded else F.col(c) for c in df.columns])


def label_encode(
    dfs: Mapping[str, DataFrame], columns: Sequence[str] | str | None = None,
    max_card: int = MAX_CARDINALITY, exclude: Sequence[str] = (),
) -> tuple[dict[str, DataFrame], DataFrame, list[str]]:
    """Encode several tables with one dictionary fitted on all of them.

    Returns the encoded tables, the dictionary and the encoded column names.
    Without ``columns`` those string columns are taken that have fewer than
    ``max_card`` values. ``columns="strings"`` takes every string column; its
    codes are ``bigint``, however many values there are.
    """
    tables = list(dfs.values())
    if columns == "strings":
        names, code_type = string_columns(_stack(tables), exclude), "bigint"
    else:
        names, code_type = encodable(tables, max_card, exclude) if columns is None else list(columns), "int"
    dictionary = materialize(label_dictionary(tables, names, code_type), "codes")
    coded = {
        tag: apply_dictionary(df, dictionary, [c for c in names if c in df.columns]) for tag, df in dfs.items()
    }
    return coded, dictionary, names


def dense_id_dictionary(dfs: Sequence[DataFrame], column: str, weight: str = "_weight") -> DataFrame:
    """(value, code, weight) for an id with any number of values.

    The distinct values are range-sorted and numbered partition by partition.
    """
    both = _stack([df.select(column) for df in dfs])
    values = both.groupBy(_text(column).alias("value")).agg(F.count(F.lit(1)).alias(weight))
    return global_index(values, ["value"], "code")


def dense_id(dfs: Mapping[str, DataFrame], column: str, name: str | None = None) -> dict[str, DataFrame]:
    """Replace an id by its rank among all ids of all tables, as text."""
    codes = dense_id_dictionary(list(dfs.values()), column)
    return {tag: _apply_ids(df, codes, column, name or column) for tag, df in dfs.items()}


def _apply_ids(df: DataFrame, codes: DataFrame, column: str, name: str) -> DataFrame:
    codes = codes.withColumnsRenamed({"value": "_value", "code": "_code"})
    joined = attach(df.withColumn("_value", _text(column)), codes, "_value", weight="_weight")
    kept = [F.col(c) for c in df.columns if c != name]
    return joined.select(*kept, F.col("_code").alias(name))


def one_hot(df: DataFrame, columns: Sequence[str], values: Mapping[str, Sequence[str]]) -> DataFrame:
    """Replace string columns by 0/1 columns ``<column>_<value>`` for the given values.

    Null has no column of its own. The values become column names, so they are
    the caller's to choose; :func:`one_hot_sparse` takes any number of them.
    """
    rest = [F.col(c) for c in df.columns if c not in columns]
    flags = [
        F.coalesce((F.col(c) == F.lit(v)).cast("int"), F.lit(0)).alias(f"{c}_{v}") for c in columns for v in values[c]
    ]
    return df.select(*rest, *flags)


def dictionary_values(dictionary: DataFrame, columns: Sequence[str]) -> dict[str, list[str]]:
    """Values by column of a dictionary that is meant to become columns; null's has none."""
    found = dictionary.where(F.col("column").isin(list(columns)) & (F.col("value") != MISSING)).orderBy("column", "code").collect()
    return {c: [r.value for r in found if r.column == c] for c in columns}


def one_hot_sparse(df: DataFrame, columns: Sequence[str], dictionary: DataFrame, name: str = "active") -> DataFrame:
    """Replace string columns by the sorted positions of their ones.

    The dictionaries of the columns stand one behind the other; null and
    values the dictionary lacks have no position.
    """
    sizes = dictionary.groupBy("column").agg(F.max("code").cast("long").alias("_last"))
    last = {r["column"]: r["_last"] for r in sizes.collect()}  # a row for each column
    coded = apply_dictionary(df.select("*", *[F.col(c).alias(f"_hot_{c}") for c in columns]), _renamed(dictionary, columns), [f"_hot_{c}" for c in columns])
    start, places = 0, []
    for c in columns:
        places.append(F.when(F.col(c).isNotNull(), F.col(f"_hot_{c}").cast("long") + F.lit(start)))
        start += last.get(c, -1) + 1
    active = F.array_compact(F.array(*places))
    return coded.select(*[F.col(c) for c in df.columns if c not in columns], active.alias(name))


def _renamed(dictionary: DataFrame, columns: Sequence[str]) -> DataFrame:
    return materialize(
        dictionary.where(F.col("column").isin(list(columns))).withColumn("column", F.concat(F.lit("_hot_"), F.col("column"))), "codes"
    )
