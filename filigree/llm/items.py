"""Items, attributes and requests as their standing rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MISSING = -999.0


def standing(rows: DataFrame, keys: list[str], order: str = "loaded_at") -> DataFrame:
    """The row with the latest `order` for each key. Rows with a null key are dropped; a null `order` is the oldest;
    rows that tie give the greatest of the remaining columns in their order, so the result is the same each time."""
    rest = [c for c in rows.columns if c not in {*keys, order}]
    known = rows.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))
    last = known.groupBy(*keys).agg(F.max(F.struct(order, *rest)).alias("_last"))
    return last.select(*keys, F.col(f"_last.{order}").alias(order), *(F.col("_last")[c].alias(c) for c in rest))


def is_clean(features: Column, length: Column) -> Column:
    """No fault of length, null, NaN, infinity, missing mark or blankness."""
    bad = F.exists(
        features,
        lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")) | (v == MISSING),
    )
    return features.isNotNull() & (F.size(features) == length) & (F.size(features) > 0) & ~bad & F.exists(features, lambda v: v != 0)


def clean_rows(rows: DataFrame, datasets: DataFrame) -> DataFrame:
    """rows of items that have a known data set and no fault. Data sets whose n_features is null have none; datasets
    may repeat rows."""
    sizes = datasets.where("dataset_id IS NOT NULL AND n_features IS NOT NULL").groupBy("dataset_id").agg(F.max("n_features").alias("_k"))
    return rows.join(sizes, "dataset_id").where(is_clean(F.col("features"), F.col("_k"))).select(*rows.columns)


def usable_items(items: DataFrame, datasets: DataFrame) -> DataFrame:
    """(dataset_id, id, features) of the standing rows that are clean."""
    last = standing(items.select("id", "dataset_id", "features", "loaded_at"), ["id"])
    return clean_rows(last.select("dataset_id", "id", "features"), datasets)


def category(value: Column) -> Column:
    """Two values are the same category iff this is equal: lower case, trimmed, any run of blanks, tabs, hyphens
    or underscores between words as one blank."""
    return F.lower(F.regexp_replace(F.regexp_replace(value, r"^\s+|\s+$", ""), r"[ \t_-]+", " "))
