"""Tag birthdays as a stream: first use and number of uses per tag, kept up to date.

Minimum and count don't depend on order, so late rows need no watermark to be right; one only bounds state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def live_birthdays(uses: DataFrame) -> DataFrame:
    """Streaming (h, us) -> (h, birthday, nbr_tweets); update or complete mode."""
    return uses.groupBy("h").agg(F.min("us").alias("birthday"), F.count(F.lit(1)).alias("nbr_tweets"))


def windowed_uses(uses: DataFrame, ts: str, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Uses per tag and event-time window; rows later than the watermark are dropped, and closed windows appended."""
    return uses.withWatermark(ts, late).groupBy(F.window(ts, width), "h").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "h", "n")


def start(df: DataFrame, folder: str, checkpoint: str, mode: str = "update") -> StreamingQuery:
    """Changed rows of each batch as Parquet in a folder of its own, until what is there is processed. Only changes are written, and a batch that is run again overwrites its folder."""

    def write(rows: DataFrame, batch: int) -> None:
        rows.withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").parquet(f"{folder}/batch-{batch:09d}")

    return df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, folder: str, schema: str, keys: list[str]) -> DataFrame:
    """What the stream has come to: each key's row of its last batch."""
    rows = spark.read.schema(f"{schema}, batch long").option("recursiveFileLookup", True).parquet(folder)
    rest = [c for c in rows.columns if c not in keys and c != "batch"]
    return rows.groupBy(*keys).agg(F.max(F.struct("batch", *rest)).alias("_s")).select(*keys, *[F.col(f"_s.{c}").alias(c) for c in rest])
