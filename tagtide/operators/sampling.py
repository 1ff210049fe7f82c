"""Reproducible samples: exact sizes by hash order, Bernoulli by hash threshold, one per key.

Hash orders depend on the seed and the key only, so a sample is the same on any cluster and in any plan,
and an iteration's number is part of its seed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagtide.functions.scalars import hash_order


def exactly(df: DataFrame, n: int, seed, *keys: str) -> DataFrame:
    """n rows (all, if fewer): TakeOrderedAndProject, no full sort."""
    return df.orderBy(hash_order(seed, *keys), *keys).limit(n)


def exactly_per(df: DataFrame, n: Column, partition: list[str], seed, *keys: str) -> DataFrame:
    """The first n rows of each group in hash order; n may be a column of the group."""
    w = Window.partitionBy(*partition).orderBy(hash_order(seed, *partition, *keys), *keys)
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def bernoulli(df: DataFrame, share: float, seed, *keys: str) -> DataFrame:
    """About that share of the rows: hash order below a threshold. A filter, no shuffle."""
    return df.filter(hash_order(seed, *keys) < f"{int(share * 2**32):08x}")


def one_per_key(edges: DataFrame, key: str, value: str, seed) -> DataFrame:
    """One random value per key, by map-side aggregation."""
    pick = F.min(F.struct(hash_order(seed, key, value).alias("r"), F.col(value).alias("v")))
    return edges.groupBy(key).agg(pick.alias("p")).select(key, F.col("p.v").alias(value))


def random_item(items: Column, seed, key: str) -> Column:
    """A random element of an array, by the key's hash."""
    r = F.conv(F.substring(hash_order(seed, key), 1, 8), 16, 10).cast("long")
    return F.when(F.size(items) > 0, F.element_at(items, (r % F.size(items) + 1).cast("int")))


def unique_by(df: DataFrame, *keys: str) -> DataFrame:
    """Rows whose key occurs once."""
    once = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n = 1").drop("_n")
    return df.join(once, list(keys), "left_semi")


def keep_one(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the first in order."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    return df.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("_s")).select(*keys, "_s.*")


def negatives(df: DataFrame, label: str, ratio: int, seed, key: str) -> DataFrame:
    """All positives and `ratio` negatives for each, in hash order (all negatives, if fewer).

    The negatives' cut is the hash below which there are enough: found by counts of hash prefixes, so no
    task sees all negatives in order.
    """
    wanted = df.filter(F.col(label) == 1).count() * ratio
    neg = df.filter(F.col(label) == 0).withColumn("_h", hash_order(seed, key))
    bins = neg.groupBy(F.substring("_h", 1, 3).alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    room = bins.withColumn("_room", F.lit(wanted) - F.coalesce(F.sum("_n").over(upto), F.lit(0))).filter("_room > 0").select("_b", "_room")
    inside = neg.withColumn("_b", F.substring("_h", 1, 3)).join(F.broadcast(room), "_b")
    ranked = inside.withColumn("_r", F.row_number().over(Window.partitionBy("_b").orderBy("_h", key))).filter("_r <= _room")
    return df.filter(F.col(label) == 1).unionByName(ranked.select(*df.columns))
