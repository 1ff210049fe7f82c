"""Language by letter trigrams: profiles, distances, similarity. JVM expressions throughout.

Text is lower-cased, runs of non-letters become one '_', and all trigrams whose middle is a letter count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def trigrams(text: Column) -> Column:
    """All trigrams, repeats included; none for null, empty or letterless texts."""
    s = F.concat(F.lit("_"), F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+", "_"), F.lit("_"))
    s = F.regexp_replace(s, "_+", "_")
    # a look-ahead finds the overlapping trigrams in one pass; substring() would walk from the start for each
    return F.regexp_extract_all(s, F.lit("(?=(.[^_].))"), F.lit(1))


def profile(texts: DataFrame, column: str = "text", size: int = 1000) -> DataFrame:
    """(ngram, cnt) of the most frequent trigrams, ties by code point."""
    grams = texts.select(F.explode(trigrams(F.col(column))).alias("ngram"))
    return grams.groupBy("ngram").agg(F.count(F.lit(1)).alias("cnt")).orderBy(F.desc("cnt"), "ngram").limit(size)


def distance(texts: DataFrame, known: DataFrame, key: str, column: str = "text") -> DataFrame:
    """(key, total, matched, distance): the share of a text's distinct trigrams that a profile lacks, null without any.

    `known` has a fixed size: it is one array, broadcast, and each text is compared with it where it is.
    """
    grams = known.agg(F.array_sort(F.collect_set("ngram")).alias("_known"))
    own = texts.select(key, F.array_distinct(trigrams(F.col(column))).alias("_own")).join(F.broadcast(grams))
    sums = own.select(key, F.size("_own").cast("long").alias("total"), F.size(F.array_intersect("_own", "_known")).cast("long").alias("matched"))
    return sums.withColumn("distance", F.when(F.col("total") > 0, 1 - F.col("matched") / F.col("total")))


def english_only(texts: DataFrame, profile: DataFrame, key: str, column: str = "text", limit: float = 0.40) -> DataFrame:
    """The rows whose text the profile of English knows; texts without a trigram are none."""
    near = distance(texts.withColumn("_text", F.col(column)).withColumn("_row", F.struct(*texts.columns)), profile, "_row", "_text")
    return near.filter(F.col("distance") < limit).select("_row.*")


def identified(distances: DataFrame, language: str = "en", limit: float = 0.40, certain: float = 0.022) -> DataFrame:
    """language where the distance is below the limit, else 'unknown'; whether it is reasonably certain."""
    return distances.withColumn("language", F.when(F.col("distance") < limit, language).otherwise("unknown")).withColumn("certain", F.coalesce(F.col("distance") < certain, F.lit(False)))


def frequency_distance(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: Euclidean distance of two profiles' relative frequencies."""
    joined = _frequencies(a, "fa").join(_frequencies(b, "fb"), "ngram", "full")
    d = F.coalesce("fa", F.lit(0.0)) - F.coalesce("fb", F.lit(0.0))
    return joined.agg(F.sqrt(F.sum(d * d)).alias("distance"))


def similarity(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: half the absolute differences of shared trigrams' frequencies in both directions, plus unshared frequencies."""
    joined = _frequencies(a, "fa").join(_frequencies(b, "fb"), "ngram", "full")
    both = F.col("fa").isNotNull() & F.col("fb").isNotNull()
    part = F.when(both, F.abs(F.col("fa") - F.col("fb"))).otherwise(F.coalesce("fa", "fb"))
    return joined.agg(F.sum(part).alias("similarity"))


def _frequencies(p: DataFrame, name: str) -> DataFrame:
    return p.select("ngram", (F.col("cnt") / F.sum("cnt").over(Window.partitionBy())).alias(name))


def save_profile(p: DataFrame, path: str, comment: str = "trigram profile") -> None:
    """Lines '<ngram> <count>' below a '#' comment."""
    head = p.sparkSession.createDataFrame([(0, f"# {comment}")], "o int, value string")
    body = p.select(F.lit(1).alias("o"), F.concat_ws(" ", "ngram", "cnt").alias("value"))
    head.unionByName(body).orderBy("o", F.desc(F.expr("try_cast(split(value, ' ')[1] as bigint)")), "value").select("value").coalesce(1).write.mode("overwrite").text(path)


def load_profile(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).filter(~F.col("value").startswith("#") & (F.trim("value") != ""))
    parts = F.split("value", " ")
    return lines.select(parts[0].alias("ngram"), F.expr("try_cast(split(value, ' ')[1] as bigint)").alias("cnt")).dropna()
