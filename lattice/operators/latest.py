"""Latest row per key, keyed upserts and guarded deletes on plain tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key: the first in ``order``. An aggregate of one struct would lose descending text; a ranked window keeps any order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], keep_old_when_null: Sequence[str] = ()) -> DataFrame:
    """Rows of both sides by key; the new row wins, but for columns that keep the old value where the new one is null."""
    o, n = old.alias("o"), new.withColumn("_new", F.lit(True)).alias("n")
    joined = o.join(n, [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys], "full_outer")
    out = []
    for c in old.columns:
        if c in keys:
            out.append(F.coalesce(f"n.{c}", f"o.{c}").alias(c))
        elif c in keep_old_when_null:
            out.append(F.coalesce(f"n.{c}", f"o.{c}").alias(c))
        else:
            out.append(F.when(F.col("n._new"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c))
    return joined.select(*out)


def insert_if_absent(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Old rows, and new ones whose key is not there yet."""
    return old.unionByName(new.join(old.select(*keys).distinct(), list(keys), "left_anti").select(old.columns))


def replace_owned(old: DataFrame, new: DataFrame, owned: Column) -> DataFrame:
    """Drop the rows a worker owns and append its new ones."""
    return old.where(~F.coalesce(owned, F.lit(False))).unionByName(new)


def delete_unreferenced(rows: DataFrame, references: DataFrame, key: str) -> DataFrame:
    """The rows that a guarded delete would remove: those that no reference names."""
    return rows.join(references.select(key), key, "left_anti")
