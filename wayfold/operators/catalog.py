"""Catalog of places: modal category, median coordinates, category tree checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def modal(df: DataFrame, key: str, values: list[str]) -> DataFrame:
    """The commonest values of each key; ties go to the smallest."""
    counts = df.groupBy(key, *values).count()
    best = counts.groupBy(key).agg(F.min(F.struct((-F.col("count")).alias("n"), *values)).alias("best"))
    return best.select(key, *[F.col(f"best.{v}").alias(v) for v in values])


def medians(df: DataFrame, key: str, values: list[str], exact: bool = True) -> DataFrame:
    one = (lambda c: F.median(c)) if exact else (lambda c: F.percentile_approx(c, 0.5, 10000))
    return df.groupBy(key).agg(*[one(v).alias(v) for v in values])


def conflicting_parents(df: DataFrame, child: str = "l2", parent: str = "l1") -> DataFrame:
    """Children with more than one parent."""
    return df.groupBy(child).agg(F.count_distinct(parent).alias("parents")).where("parents > 1")


def catalog(visits: DataFrame, train_places: DataFrame) -> DataFrame:
    """p, lat, lon, l1, l2 of the places of the train period, from visits of all periods."""
    own = visits.join(train_places, "p", "left_semi")
    return medians(own, "p", ["lat", "lon"]).join(modal(own, "p", ["l1", "l2"]), "p")
