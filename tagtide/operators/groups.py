"""Control and sensor groups of users, and groups of posts, for any number of iterations at once.

Iterations are a column: what a loop would run per iteration is one plan over (iteration, member). Sizes that
depend on other groups (posts of a control group, say) are joined in, never collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagtide.functions.scalars import hash_order
from tagtide.operators.sampling import exactly_per


def iterations(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).withColumnRenamed("id", "iteration")


def control_groups(spark: SparkSession, users: DataFrame, n: int, size: int, seed=42, min_hashtags: int = 0, min_mentions: int = 0) -> DataFrame:
    """(iteration, u): `size` random users per iteration who meet the minimums.

    The best `size` of each iteration are kept by partition first, then merged, so only size rows per task
    and iteration are shuffled.
    """
    able = users.filter((F.col("nbr_hashtags") >= min_hashtags) & (F.col("nbr_mentions") >= min_mentions)).select("u")
    drawn = able.join(F.broadcast(iterations(spark, n)))
    local = Window.partitionBy("iteration", F.pmod(F.xxhash64("u"), F.lit(64))).orderBy(hash_order(seed, "iteration", "u"), "u")
    best = drawn.withColumn("_r", F.row_number().over(local)).filter(F.col("_r") <= size).drop("_r")
    return exactly_per(best, F.lit(size), ["iteration"], seed, "u")


def sensors(control: DataFrame, network: DataFrame, seed=42) -> DataFrame:
    """(iteration, u, sensor): one random user whom each control user mentions; users without one drop out."""
    met = control.join(network.select(F.col("src").alias("u"), F.col("dst").alias("sensor")).distinct(), "u")
    pick = F.min(F.struct(hash_order(seed, "iteration", "u", "sensor").alias("r"), "sensor"))
    return met.groupBy("iteration", "u").agg(pick.alias("p")).select("iteration", "u", F.col("p.sensor").alias("sensor"))


def one_to_one(pairs: DataFrame) -> DataFrame:
    """Pairs whose sensor serves one control user only, in that iteration."""
    once = pairs.groupBy("iteration", "sensor").agg(F.count(F.lit(1)).alias("n")).filter("n = 1").drop("n")
    return pairs.join(once, ["iteration", "sensor"], "left_semi").select("iteration", "u", "sensor")


def neighbours(control: DataFrame, network: DataFrame) -> DataFrame:
    """(iteration, u): all distinct users whom the group mentions."""
    return control.join(network.select(F.col("src").alias("u"), "dst"), "u").select("iteration", F.col("dst").alias("u")).distinct()


def best_neighbours(control: DataFrame, network: DataFrame, users: DataFrame, size: int, by: str, descending: bool = True) -> DataFrame:
    """(iteration, u): the group's `size` neighbours with the most hashtags, the least lag or the like; ties by user.

    The attribute is the neighbour's own.
    """
    near = neighbours(control, network).join(users.select("u", by), "u")
    w = Window.partitionBy("iteration").orderBy(F.desc(by) if descending else F.asc(by), "u")
    return near.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= size).select("iteration", "u")


def random_neighbours(control: DataFrame, network: DataFrame, size: int, seed=42) -> DataFrame:
    return exactly_per(neighbours(control, network), F.lit(size), ["iteration"], seed, "u")


def top_users(users: DataFrame, by: str, size: int, descending: bool = True) -> DataFrame:
    return users.orderBy(F.desc(by) if descending else F.asc(by), "u").limit(size).select("u")


def top_user_posts(posts: DataFrame, tops: dict[str, DataFrame], sizes: DataFrame, seed=42) -> DataFrame:
    """(iteration, group, tid): for each iteration as many random posts as `sizes` says, of each group's top users.

    tops: group -> (u), the same users in every iteration; sizes: (iteration, n).
    """
    out = None
    for name, users in tops.items():
        own = posts.join(F.broadcast(users), "u", "left_semi").select("tid")
        drawn = sampled_posts(own, sizes, f"{seed}{name}").select("iteration", F.lit(name).alias("group"), "tid")
        out = drawn if out is None else out.unionByName(drawn)
    return out


def posts_of(group: DataFrame, posts: DataFrame) -> DataFrame:
    """(iteration, n): how many posts a group wrote."""
    return group.select("iteration", "u").distinct().join(posts.select("u", "tid"), "u").groupBy("iteration").agg(F.count(F.lit(1)).alias("n"))


def sampled_posts(posts: DataFrame, sizes: DataFrame, seed, buckets: int = 256) -> DataFrame:
    """(iteration, tid): per iteration, n random posts, n from `sizes`; of all posts, or of (iteration, tid) where posts have an iteration.

    A post's place in an iteration is the hash of both. Of t posts, the n first have hashes below about n / t: a
    filter lets pass those below a bound that is surely enough, and nothing else is shuffled. t is a sketch's
    estimate, taken 10 % lower, ten times its error. Counts per hash range of those that pass tell which ranges lie
    inside the sample; only the range at its edge is ranked.
    """
    keys = ["iteration"] if "iteration" in posts.columns else []
    totals = posts.groupBy(*keys).agg(F.approx_count_distinct("tid", 0.01).alias("_t"))
    share = (F.col("n") + 12 * F.sqrt("n") + 64) / (0.9 * F.col("_t"))
    bound = (sizes.join(totals, "iteration") if keys else sizes.join(totals)).select("iteration", "n", F.least(share * 2**32, F.lit(2.0**32)).alias("_upto"))
    drawn = posts.select(*keys, "tid").join(F.broadcast(bound), keys) if keys else posts.select("tid").join(F.broadcast(bound))
    drawn = drawn.withColumn("h", hash_order(seed, "iteration", "tid")).withColumn("_u", F.conv(F.substring("h", 1, 8), 16, 10).cast("long")).filter("_u < _upto")
    drawn = drawn.withColumn("b", F.floor(F.col("_u") * buckets / F.col("_upto"))).select("iteration", "tid", "n", "h", "b").distinct()
    counts = drawn.groupBy("iteration", "b", "n").agg(F.count(F.lit(1)).alias("c"))
    before = Window.partitionBy("iteration").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    room = counts.withColumn("room", F.col("n") - F.coalesce(F.sum("c").over(before), F.lit(0))).filter("room > 0").select("iteration", "b", "c", "room")
    joined = drawn.join(F.broadcast(room), ["iteration", "b"])
    inner = joined.filter("c <= room").select("iteration", "tid")
    edge = joined.filter("c > room").withColumn("r", F.row_number().over(Window.partitionBy("iteration", "b").orderBy("h", "tid"))).filter("r <= room").select("iteration", "tid")
    return inner.unionByName(edge)


def positional(*groups: DataFrame) -> DataFrame:
    """(iteration, row, u1, u2, ...): members side by side, as far as the shortest group goes."""
    out = None
    for i, g in enumerate(groups, 1):
        numbered = g.select("iteration", F.row_number().over(Window.partitionBy("iteration").orderBy("u")).alias("row"), F.col("u").alias(f"u{i}"))
        out = numbered if out is None else out.join(numbered, ["iteration", "row"])
    return out
