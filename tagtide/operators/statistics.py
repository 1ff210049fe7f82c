"""Statistics of columns and of attributes: deviations with zeros left out, bins, outliers, trends, correlation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagtide.functions.scalars import order_of_magnitude_bin
from tagtide.sources.posts import kept, sequential_ids


def column_deviations(nonzeros: DataFrame, n_rows: DataFrame, key: str = "feature_id", value: str = "value") -> DataFrame:
    """(key, nnz, mean, stdev): sample deviation over all rows, zeros counted in closed form. n_rows: one row (n)."""
    sums = nonzeros.groupBy(key).agg(F.count(F.lit(1)).alias("nnz"), F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("q"))
    n, mean = F.col("n"), F.col("s") / F.col("n")
    var = (F.col("q") - F.col("s") * F.col("s") / n) / (n - 1)
    return sums.join(F.broadcast(n_rows)).select(key, "nnz", mean.alias("mean"), F.sqrt(F.greatest(var, F.lit(0.0))).alias("stdev"))


def scaled(nonzeros: DataFrame, deviations: DataFrame, key: str = "feature_id", value: str = "value") -> DataFrame:
    """Values over the training deviation, not centred; a column without deviation becomes 0."""
    joined = nonzeros.join(deviations.select(key, "stdev"), key)
    return joined.withColumn(value, F.when(F.col("stdev") > 0, F.col(value) / F.col("stdev")).otherwise(0.0)).drop("stdev")


def quantiles(df: DataFrame, column: str, group: list[str], shares: list[float]) -> DataFrame:
    """(group, q array<double>): exact quantiles with linear interpolation; nulls take no part.

    Equal values are counted first. A range exchange by group and value then numbers the counts from partition to
    partition, so that no task holds a group; only the values around a quantile go on.
    """
    of = F.struct(*group) if group else F.struct(F.lit(0))
    counts = df.filter(F.col(column).isNotNull()).groupBy(of.alias("_g"), F.col(column).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    placed = kept(counts.repartitionByRange("_g", "_v").withColumn("_p", F.spark_partition_id()))
    parts = placed.groupBy("_p", "_g").agg(F.sum("_c").alias("_n"))
    every = Window.partitionBy("_g")
    offsets = parts.select("_p", "_g", F.coalesce(F.sum("_n").over(every.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_n").over(every).alias("_all"))
    joined = placed.join(F.broadcast(offsets), ["_p", "_g"])
    upto = F.col("_before") + F.sum("_c").over(Window.partitionBy("_p", "_g").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    # a value holds the places from _first to _last; a quantile lies at place share * (n - 1)
    spans = joined.withColumn("_last", upto - 1).withColumn("_first", F.col("_last") - F.col("_c") + 1)
    wanted = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), (F.lit(s) * (F.col("_all") - 1)).alias("at")) for i, s in enumerate(shares)]))
    at = F.col("_w.at")
    near = spans.withColumn("_w", wanted).withColumn("_lo", F.floor(at).between(F.col("_first"), F.col("_last"))).withColumn("_hi", F.ceil(at).between(F.col("_first"), F.col("_last"))).filter("_lo or _hi")
    both = near.groupBy("_g", F.col("_w.i").alias("_i"), at.alias("_at")).agg(F.max(F.when(F.col("_lo"), F.col("_v"))).alias("a"), F.max(F.when(F.col("_hi"), F.col("_v"))).alias("b"))
    value = F.col("a") + (F.col("b") - F.col("a")) * (F.col("_at") - F.floor("_at"))
    out = both.groupBy("_g").agg(F.array_sort(F.collect_list(F.struct("_i", value.alias("v")))).alias("_q"))
    return out.select(*([F.col(f"_g.{c}").alias(c) for c in group]), F.transform("_q", lambda x: x["v"]).alias("q"))


def quartiles(df: DataFrame, column: str, group: list[str] | None = None) -> DataFrame:
    """q1, median, q3 and iqr, exact, with linear interpolation."""
    q = quantiles(df, column, group or [], [0.25, 0.5, 0.75])
    return q.select(*(group or []), F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), (F.col("q")[2] - F.col("q")[0]).alias("iqr"))


def without_outliers(df: DataFrame, column: str, group: list[str], whisker: float = 1.5) -> DataFrame:
    """Rows inside [q1 - whisker iqr, q3 + whisker iqr] of their group. Groups are few, so limits are broadcast."""
    q = quartiles(df, column, group).select(*group, (F.col("q1") - whisker * F.col("iqr")).alias("_lo"), (F.col("q3") + whisker * F.col("iqr")).alias("_hi"))
    return (df.join(F.broadcast(q), group) if group else df.join(F.broadcast(q))).filter(F.col(column).between(F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")


def binned_distribution(df: DataFrame, attribute: str, value: str) -> DataFrame:
    """Per bin of an attribute's order of magnitude: rows and quartiles of a value, after dropping outliers of the
    value and then, among what is left, of the attribute."""
    binned = df.withColumn("bin", order_of_magnitude_bin(F.col(attribute))).filter("bin is not null")
    kept = without_outliers(without_outliers(binned, value, ["bin"]), attribute, ["bin"])
    n = kept.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    return n.join(quartiles(kept, value, ["bin"]), "bin")


def trend(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def kendall_tau(df: DataFrame, key: str, x: str, y: str, most: int = 5_000) -> DataFrame:
    """Rank correlation over all pairs of a small set, such as topics; more than `most` rows are an error."""
    n = df.count()
    if n > most:
        raise ValueError(f"{n} rows: correlation by pairs is for sets of {most} at most")
    a, b = (df.select(F.col(key).alias(f"k{i}"), F.col(x).alias(f"x{i}"), F.col(y).alias(f"y{i}")) for i in (1, 2))
    pairs = a.join(F.broadcast(b), F.col("k1") < F.col("k2"))
    return pairs.agg((F.sum(F.signum(F.col("x1") - F.col("x2")) * F.signum(F.col("y1") - F.col("y2"))) / F.count(F.lit(1))).alias("tau"))


def mean_with_interval(df: DataFrame, group: list[str], value: str, t: float = 2.262157) -> DataFrame:
    """Mean and half width of its interval: t times the standard error (default: 95 %, ten values)."""
    return df.groupBy(*group).agg(F.avg(value).alias("mean"), (t * F.stddev_samp(value) / F.sqrt(F.count(value))).alias("half_width"))


def usage(counts: DataFrame, group: str, name: str, n: str) -> DataFrame:
    """Greatest, mean and median use per family, and the most used name, ties to the least."""
    return counts.groupBy(group).agg(F.max(n).alias("most"), F.avg(n).alias("mean"), F.percentile(n, 0.5).alias("median"), F.min(F.struct((-F.col(n)).alias("o"), F.col(name).alias("v")))["v"].alias("top"))


def frequent(values: DataFrame, thresholds: dict[str, int]) -> DataFrame:
    """(family, value, n) of values that their family's threshold lets pass."""
    limit = None
    for family, least in thresholds.items():
        limit = (F if limit is None else limit).when(F.col("family") == family, least)
    return values.groupBy("family", "value").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= limit)


def every_nth(df: DataFrame, n: int, order: list) -> DataFrame:
    """Rows 1, n+1, 2n+1, ... of an order, numbered by ranges."""
    return sequential_ids(df, order, 0, "_r").filter(F.col("_r") % n == 0).drop("_r")


def numbered(df: DataFrame, order: list, name: str = "rank") -> DataFrame:
    """Consecutive numbers from 1, without a global sort in one task."""
    return sequential_ids(df, order, 1, name)
