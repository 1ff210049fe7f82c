"""Helpers that the corpus operators share: tables, cut lineage, broadcasts of a checked size."""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space of the word definition `[^\x20\x09-\x0D]+`, as a Java/RE2 regular expression.
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of `spark.checkpoint.dir`; one of our own only where the session names none, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        folder = tempfile.mkdtemp(prefix="tagtide-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared folder and cut the lineage there: the files survive the loss of any executor."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def tidy(spark: SparkSession) -> None:
    """Collect what finished plans have left in the driver: an operator of many jobs fills its heap before it is collected by itself."""
    gc.collect()
    spark.sparkContext._jvm.java.lang.System.gc()


def small(df: DataFrame, max_bytes: int = 32 << 20) -> DataFrame:
    """`df`, hinted for broadcast only when its rows hold at most `max_bytes`: 8 for a number or flag, a string's or array's length as JSON.

    Beyond that Spark picks a shuffled join. `df` should be cut or cheap: it is evaluated here.
    """
    size = F.lit(0)
    for field in df.schema.fields:
        c, kind = F.col(f"`{field.name}`"), field.dataType.typeName()
        width = F.octet_length(c.cast("string")) + 16 if kind in ("string", "binary") else F.octet_length(F.to_json(F.struct(c))) if kind in ("array", "map", "struct") else F.lit(8)
        size = size + F.coalesce(width, F.lit(8))
    held = df.agg(F.sum(size.cast("long"))).first()[0] or 0
    return F.broadcast(df) if held <= max_bytes else df


def reshuffled(df: DataFrame, key: str) -> DataFrame:
    """`df` with a long key that Spark doesn't know to be partitioned by.

    A join of a table with an aggregate of itself would reuse the aggregate's partitioning, and AQE can't split
    a hot key there. With an exchange of its own for the small side, it can.
    """
    return df.withColumn(key, F.shiftright(key, 0))


def words(text: Column) -> Column:
    """Array of the words `[^\\x20\\x09-\\x0D]+`; null and empty texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def fold(text: Column) -> Column:
    """A-Z in lower case, all else unchanged."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
