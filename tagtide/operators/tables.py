"""Tables of posts: tags, first uses, mentions, users, duplicate lines.

`uses` is the common form: one row per occurrence of a tag, (tid, u, h, us) with us in microseconds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagtide.functions.entities import hashtags, mentions
from tagtide.functions.scalars import micros, parse_created_at


def event_uses(events: DataFrame) -> DataFrame:
    """(tid, u, h, us) of the driver's `events`: the tag is the event type and the tens of k."""
    k = F.expr("cast(get_json_object(props, '$.k') as int) div 10")
    return events.select(F.col("event_id").alias("tid"), F.col("user_id").alias("u"), F.concat_ws("_", "event_type", k).alias("h"), micros("ts").alias("us"))


def event_mentions(events: DataFrame) -> DataFrame:
    """(src, dst) of `events`: k as another user, once per event; self-mentions dropped."""
    k = F.expr("cast(get_json_object(props, '$.k') as bigint)")
    return events.select(F.col("user_id").alias("src"), k.alias("dst")).filter("dst is not null and src <> dst")


def post_uses(posts: DataFrame) -> DataFrame:
    """(tid, u, h, us) of flat posts, one row per occurrence: a tag twice in a post is two uses."""
    us = F.unix_micros(parse_created_at(F.col("created_at")))
    return posts.select(F.col("id").alias("tid"), F.lower(F.trim("screen_name")).alias("u"), F.explode(hashtags(F.lower("text"))).alias("h"), us.alias("us"))


def post_mentions(posts: DataFrame) -> DataFrame:
    return posts.select(F.lower(F.trim("screen_name")).alias("src"), F.explode(mentions(F.lower("text"))).alias("dst"))


def line_counts(lines: DataFrame, column: str) -> DataFrame:
    """Copies of each line, by MD5."""
    return lines.groupBy(F.md5(column).alias("digest")).agg(F.count(F.lit(1)).alias("n"))


def post_counts(posts: DataFrame, user: str) -> DataFrame:
    return posts.groupBy(F.col(user).alias("u")).agg(F.count(F.lit(1)).alias("nbr_tweets"))


def birthdays(uses: DataFrame, keys: list[str]) -> DataFrame:
    """First use and number of uses per key; map-side aggregated, so a hot tag is no hot task."""
    return uses.groupBy(*keys).agg(F.min("us").alias("birthday"), F.count(F.lit(1)).alias("nbr_tweets"))


def birthday_sources(uses: DataFrame, source: str) -> DataFrame:
    """Per tag: first use, uses, and the source of the first, the least one of a tie."""
    return uses.groupBy("h").agg(F.min("us").alias("birthday"), F.count(F.lit(1)).alias("nbr_tweets"), F.min(F.struct("us", source))[source].alias("source"))


def mention_network(mentions: DataFrame) -> DataFrame:
    return mentions.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight"))


def tokens(uses: DataFrame) -> DataFrame:
    """One row per use with a constant 1: no shuffle."""
    return uses.select("tid", "u", "h", "us", F.lit(1).alias("one"))


def users(uses: DataFrame, mentions: DataFrame) -> DataFrame:
    """(u, nbr_tweets, nbr_hashtags, nbr_mentions): posts, distinct tags, distinct users mentioned."""
    own = uses.groupBy("u").agg(F.countDistinct("tid").alias("nbr_tweets"), F.countDistinct("h").alias("nbr_hashtags"))
    out = mentions.groupBy("src").agg(F.countDistinct("dst").alias("nbr_mentions"))
    return own.join(out, own.u == out.src, "left").select("u", "nbr_tweets", "nbr_hashtags", F.coalesce("nbr_mentions", F.lit(0)).alias("nbr_mentions"))


def splits(births: DataFrame, train_until, test_from) -> DataFrame:
    """Disjoint tag sets by first use: train, val, test."""
    return births.withColumn("split", F.when(F.col("birthday") < train_until, "train").when(F.col("birthday") < test_from, "val").otherwise("test"))


def labelled_posts(uses: DataFrame, topical: DataFrame, val_from, test_from) -> DataFrame:
    """(tid, u, label, split): posts by their time, before val_from, from then on, and from test_from on (microseconds).

    A topical tag belongs to the split in which it is first used. A post is positive iff it uses a topical tag of
    its own split; posts after training that use a topical tag of the training split are dropped.
    topical: (h). The times are numbers or columns of uses.
    """
    when = lambda us: F.when(us < val_from, "train").when(us < test_from, "val").otherwise("test")
    tags = uses.join(F.broadcast(topical.select("h").distinct()), "h", "left_semi").groupBy("h").agg(F.min("us").alias("born"))
    marked = uses.join(tags, "h", "left").withColumns({"split": when(F.col("us")), "of": F.when(F.col("born").isNotNull(), when(F.col("born")))})
    posts = marked.groupBy("tid", "u").agg(
        F.min(F.struct("us", "split"))["split"].alias("split"),
        F.collect_set("of").alias("of"),  # three values at most
    )
    label = F.array_contains("of", F.col("split")).cast("int")
    return posts.filter((F.col("split") == "train") | ~F.array_contains("of", "train")).select("tid", "u", label.alias("label"), "split")
