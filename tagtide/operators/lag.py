"""Lag times: how long after a tag's first use anywhere a group first uses it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagtide.functions.scalars import MAX_LAG_MS


def targets(births: DataFrame, after_us: int = 0) -> DataFrame:
    """Tags whose first use anywhere is after a time."""
    return births.groupBy("h").agg(F.min("birthday").alias("birthday")).filter(F.col("birthday") > after_us)


def first_uses(group: DataFrame, per_user: DataFrame) -> DataFrame:
    """(iteration, group, h, first, total) of user groups, all groups and iterations in one aggregate.

    per_user: (u, h, birthday, nbr_tweets)."""
    return group.join(per_user, "u").groupBy("iteration", "group", "h").agg(F.min("birthday").alias("first"), F.sum("nbr_tweets").alias("total"))


def first_uses_of_posts(group: DataFrame, uses: DataFrame) -> DataFrame:
    """The same for groups of posts: (iteration, group, tid)."""
    return group.join(uses.select("tid", "h", "us"), "tid").groupBy("iteration", "group", "h").agg(F.min("us").alias("first"), F.count(F.lit(1)).alias("total"))


def lag_times(first: DataFrame, births: DataFrame, members: DataFrame, max_lag: int = MAX_LAG_MS) -> DataFrame:
    """(iteration, group, h, lag): milliseconds for every tag; max_lag where the group never uses it.

    births: (h, birthday) of the target tags; members: the (iteration, group) pairs to report. The skeleton of
    tags and groups is small against the uses and is broadcast on the groups' side.
    """
    every = births.select("h", "birthday").join(F.broadcast(members.select("iteration", "group").distinct()))
    joined = every.join(first.select("iteration", "group", "h", "first"), ["iteration", "group", "h"], "left")
    return joined.select("iteration", "group", "h", F.coalesce(F.expr("(first - birthday) div 1000"), F.lit(max_lag)).alias("lag"))


def lag_cube(lags: DataFrame, groups: list[str]) -> DataFrame:
    """One row per (iteration, h), one column lag_time<group> per group."""
    wide = lags.groupBy("iteration", "h").pivot("group", groups).agg(F.min("lag"))
    return wide.select("iteration", "h", *[F.col(g).alias(f"lag_time{g}") for g in groups])


def mean_over_iterations(lags: DataFrame) -> DataFrame:
    return lags.groupBy("group", "h").agg(F.round(F.avg("lag"), 6).alias("mean_lag"))


def user_scores(users: DataFrame, births: DataFrame, per_user: DataFrame, default: int = 11_100_000_000) -> DataFrame:
    """(u, lagtime): a user's mean lag over all target tags, `default` for tags never used, rounded.

    Tags that a user doesn't use add a constant, so no pairs of users and tags are made: the mean comes from the
    used ones and the number of tags.
    """
    used = per_user.join(births.select("h", F.col("birthday").alias("b")), "h").groupBy("u").agg(F.sum(F.expr("(birthday - b) div 1000")).alias("s"), F.count(F.lit(1)).alias("k"))
    n = births.agg(F.count(F.lit(1)).alias("n"))
    joined = users.select("u").join(used, "u", "left").join(F.broadcast(n))
    score = (F.coalesce("s", F.lit(0)) + (F.col("n") - F.coalesce("k", F.lit(0))) * default) / F.col("n")
    return joined.select("u", F.round(score).cast("long").alias("lagtime"))


def before_after(first: DataFrame) -> DataFrame:
    """(iteration, group, before, after): tag occurrences, and distinct tags."""
    return first.groupBy("iteration", "group").agg(F.sum("total").alias("before"), F.count(F.lit(1)).alias("after"))


def unfinished(analysis: DataFrame, start: int, stop: int, column: str) -> DataFrame:
    """Rows strictly between two iterations that still lack a column: where to resume."""
    return analysis.filter((F.col("iteration") > start) & (F.col("iteration") < stop) & F.col(column).isNull())
