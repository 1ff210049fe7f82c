"""Information measures: user probabilities, conditional entropy, mutual information, shares of families.

Only non-zeros are ever rows: what zeros add comes from totals in closed form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagtide.functions.scalars import entropy_term, information_term


def probabilities(rows: DataFrame, key: str, name: str = "prob") -> DataFrame:
    """Share of all rows per key."""
    total = rows.agg(F.count(F.lit(1)).alias("_t"))
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return counts.join(F.broadcast(total)).select(key, (F.col("_n") / F.col("_t")).alias(name))


def topical_posts(uses: DataFrame, topical: Column) -> DataFrame:
    """(tid, u, t): t is 1 if the post uses a topical tag."""
    return uses.groupBy("tid", "u").agg(F.max(F.when(topical, 1).otherwise(0)).alias("t"))


def contains_counts(posts: DataFrame) -> DataFrame:
    """(bucket, n): 1 posts with a topical tag, 2 without."""
    return posts.groupBy(F.when(F.col("t") == 1, 1).otherwise(2).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def conditional_counts(posts: DataFrame) -> DataFrame:
    """(u, p_topical, p_other): shares of all posts that are the user's and topical, or not."""
    total = posts.agg(F.count(F.lit(1)).alias("t"))
    own = posts.groupBy("u").agg(F.sum("t").alias("a"), F.sum(1 - F.col("t")).alias("b"))
    return own.join(F.broadcast(total)).select("u", (F.col("a") / F.col("t")).alias("p_topical"), (F.col("b") / F.col("t")).alias("p_other"))


def conditional_entropy(posts: DataFrame, normalised: bool = False) -> DataFrame:
    """(u, cond_entropy) in nats: of "a post is topical", given whether u wrote it.

    One aggregate per user and one row of totals; four terms in one projection. As published, the terms of other
    authors are divided by P(u) too; `normalised` divides them by 1 - P(u).
    """
    totals = posts.agg(F.count(F.lit(1)).alias("n"), F.sum("t").alias("c"))
    own = posts.groupBy("u").agg(F.count(F.lit(1)).alias("nu"), F.sum("t").alias("cu"))
    p = own.join(F.broadcast(totals)).select(
        "u", (F.col("nu") / F.col("n")).alias("pu"), (F.col("cu") / F.col("n")).alias("a"), ((F.col("nu") - F.col("cu")) / F.col("n")).alias("b"),
        ((F.col("c") - F.col("cu")) / F.col("n")).alias("c"), ((F.col("n") - F.col("c") - F.col("nu") + F.col("cu")) / F.col("n")).alias("d"),
    )
    rest = 1 - F.col("pu") if normalised else F.col("pu")
    terms = [entropy_term(F.col("a"), F.col("pu")), entropy_term(F.col("b"), F.col("pu")), entropy_term(F.col("c"), rest), entropy_term(F.col("d"), rest)]
    return p.select("u", (-(terms[0] + terms[1] + terms[2] + terms[3])).alias("cond_entropy"))


def mutual_information(features: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, mi) in bits, of a binary label and the presence of a feature.

    features: (row, keys) of present features, each once per row, with the row's label if it is at hand, as
    `label`; labels: (row, label 0/1) of all rows. Features in every row or in none, which tell nothing, get 0.
    """
    totals = labels.agg(F.count(F.lit(1)).alias("_n"), F.sum("label").alias("_n1"))
    present = features if "label" in features.columns else features.select("row", *keys).join(labels, "row")
    cells = present.groupBy(*keys).agg(F.count(F.lit(1)).alias("_f"), F.sum("label").alias("_f1")).join(F.broadcast(totals))
    n, n1, f, f1 = (F.col(c).cast("double") for c in ("_n", "_n1", "_f", "_f1"))
    term = lambda x, pf, pc: information_term(x / n, pf / n, pc / n)
    mi = term(f1, f, n1) + term(f - f1, f, n - n1) + term(n1 - f1, n - f, n1) + term(n - n1 - f + f1, n - f, n - n1)
    return cells.select(*keys, mi.alias("mi"))


def top_per_group(scores: DataFrame, group: list[str], by: str, k: int, ties: str) -> DataFrame:
    """The k best of each group with their rank; a group limit before the shuffle keeps what is ranked small."""
    w = Window.partitionBy(*group).orderBy(F.desc(by), ties)
    return scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def mean_matrix(scores: DataFrame, k: int = 100_000, scale: float = 1e8) -> DataFrame:
    """(family, topic, mean_mi): means of the k best per cell, and the margins' means of cells, null marking 'all'."""
    cells = top_per_group(scores, ["family", "topic"], "mi", k, "feature").groupBy("family", "topic").agg((F.avg("mi") * scale).alias("m"))
    return cells.cube("family", "topic").agg(F.avg("m").alias("mean_mi"))


def family_shares(scores: DataFrame, ks: list[int]) -> DataFrame:
    """(k, family, share): each family's part in the k best features of all."""
    ranked = scores.orderBy(F.desc("mi"), "feature").limit(max(ks))
    ranked = ranked.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("mi"), "feature")))
    within = ranked.select("family", F.explode(F.filter(F.array(*[F.lit(k) for k in ks]), lambda k: F.col("rank") <= k)).alias("k"))
    counts = within.groupBy("k", "family").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("k", "family", (F.col("n") / F.sum("n").over(Window.partitionBy("k"))).alias("share"))
