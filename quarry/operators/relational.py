"""Relational building blocks that several queries share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def anti_join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of left without a partner in right."""
    return left.join(right.select(*keys).distinct(), list(keys), "left_anti")


def semi_join_any(parent: DataFrame, child: DataFrame, parent_key: str, child_key: str) -> DataFrame:
    """Parents with any child; children are reduced to their keys before the shuffle."""
    keys = child.select(F.col(child_key).alias(parent_key)).distinct()
    return parent.join(keys, parent_key, "left_semi")


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row with the greatest order columns of each key, as an aggregate: partial maxima come before the shuffle, so a hot key costs one row for each task."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), F.struct(*order)).alias("_row")).select("_row.*")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row with the least order columns of each key: first seen wins."""
    return df.groupBy(*keys).agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("_row")).select("_row.*")


def rank_within(df: DataFrame, keys: Sequence[str], order: Sequence[Column], most: int | None = None) -> DataFrame:
    """Adds rn, the place inside the key from 1; at most `most` rows of each key (Spark then keeps only those in each task before the shuffle)."""
    ranked = df.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked if most is None else ranked.where(F.col("rn") <= most)


def first_with_one(df: DataFrame, keys: Sequence[str], order: Sequence[Column], wanted: Column, most: int = 3) -> DataFrame:
    """The first `most` rows of each key with their place rn; where none of them is wanted, the first wanted row of the key takes the last place.

    Both rankings keep a few rows of each key in each task before the shuffle, so the window that joins them sees at most `most` + 1 rows of a key,
    whatever the key holds. The order must end in a unique column. A null wish counts as no.
    """
    yes = F.coalesce(wanted, F.lit(False))
    first = rank_within(df, keys, order, most).withColumns({"_put": F.lit(False), "_yes": yes})
    best = rank_within(df.where(yes), keys, order, 1).withColumns({"rn": F.lit(most), "_put": F.lit(True), "_yes": F.lit(True)})
    key = Window.partitionBy(*keys)
    held, put = F.bool_or(F.col("_yes") & ~F.col("_put")).over(key), F.bool_or("_put").over(key)
    both = first.unionByName(best).withColumns({"_held": held, "_any": put})
    stays = F.when(F.col("_put"), ~F.col("_held")).otherwise(F.col("_held") | ~F.col("_any") | (F.col("rn") < most))
    return both.where(stays).drop("_put", "_yes", "_held", "_any")


def paged(df: DataFrame, order: Sequence[str], page: int = 1, size: int = 10, largest: int = 50) -> DataFrame:
    """One page; page numbers start at 1 and sizes are held between 1 and `largest`. The order must end in a unique column."""
    size = min(max(size, 1), largest)
    return df.orderBy(*order).offset((max(page, 1) - 1) * size).limit(size)


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """old with new's rows put over it by key, and the outcome of each key: created, updated or kept."""
    values = [c for c in new.columns if c not in keys]
    o = old.select(*keys, F.struct(*old.columns).alias("_old"))
    n = new.select(*keys, F.struct(*new.columns).alias("_new"))
    both = o.join(n, list(keys), "full_outer")
    outcome = F.when(F.col("_old").isNull(), "created").when(F.col("_new").isNull(), "kept").otherwise("updated")
    return both.select(*keys, *[F.coalesce(F.col(f"_new.{c}"), F.col(f"_old.{c}")).alias(c) for c in values], outcome.alias("outcome"))
