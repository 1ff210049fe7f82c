"""Readers and writers: JSON-lines posts, TSV, CSV, Parquet, feature files, result files.

Compressed input (gzip, bzip2) is told by its suffix; hidden files are skipped by Spark. Rows that don't
parse are dropped one by one, never a whole file.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagtide.functions.language import english_only

RAW = "created_at string, text string, user struct<screen_name: string>"
FLAT = "id bigint, text string, created_at string, screen_name string"
RAW_START = '{"created_at":'
# Fixed value: the parts of a feature file's header, in order, and the families they count.
HEADER = ["rows", "columns", "term", "hashtag", "mention", "user", "location"]
FAMILIES = HEADER[2:]
# Fixed value: characters that JSON escapes beyond what the format demands.
RARE = r"[\u007f-\u009f\u2000-\u20ff]"


def json_lines(spark: SparkSession, path: str, schema: str, start: str | None = None, glob: str | None = None, recursive: bool = True) -> DataFrame:
    """Parsed lines with the source's name in `file`; comments, blank lines, lines without `start` and lines that don't parse are skipped."""
    reader = spark.read.option("recursiveFileLookup", recursive)
    reader = reader.option("pathGlobFilter", glob) if glob else reader
    lines = reader.text(path).select("value", F.col("_metadata.file_name").alias("file"))
    line = F.trim("value")
    keep = (line != "") & ~line.startswith("#")
    if start:
        keep &= F.col("value").startswith(start)
    parsed = lines.filter(keep).select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("p"), "file", line.endswith("}").alias("whole"))
    return parsed.filter("p is not null and whole").select("p.*", "file")


def raw_posts(spark: SparkSession, path: str, glob: str = "*.{gz,bz2,json}") -> DataFrame:
    """Nested posts -> (created_at, text, screen_name, file), delete notices and rows without text or name dropped."""
    posts = json_lines(spark, path, RAW, RAW_START, glob)
    flat = posts.select("created_at", F.regexp_replace("text", r"[\n\r]", "").alias("text"), F.col("user.screen_name").alias("screen_name"), "file")
    return flat.dropna(subset=["text", "screen_name"])


def flat_posts(spark: SparkSession, path: str) -> DataFrame:
    """(id, text, created_at, screen_name, file) of flat posts; rows without text or name are dropped."""
    return json_lines(spark, path, FLAT).dropna(subset=["text", "screen_name"])


def normalised(posts: DataFrame) -> DataFrame:
    """Lower-case trimmed names, lower-case texts, trimmed times."""
    return posts.withColumns({"screen_name": F.lower(F.trim("screen_name")), "text": F.lower("text"), "created_at": F.trim("created_at")})


def sequential_ids(df: DataFrame, order: list[str | Column], start: int = 1, name: str = "id") -> DataFrame:
    """Consecutive ids from `start` in the given order, without gathering the rows in one task.

    A range exchange sorts the rows; counts per partition, a few numbers, give each partition its offset.
    """
    ordered = kept(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id()))
    firsts = ordered.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"))
    offsets = firsts.select("_part", "_first", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_offset"))
    return ordered.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_offset") + F.col("_row") - F.col("_first") + start).drop("_part", "_row", "_first", "_offset")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share. A local session without one gets a folder of its own; a cluster has none by chance."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tagtide-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def kept(df: DataFrame) -> DataFrame:
    """Range bounds are sampled, so partitions must not be computed twice: they are written to the checkpoint folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def english_posts(posts: DataFrame, profile: DataFrame) -> DataFrame:
    """Posts in English, by their text's trigrams; links, mentions and tags don't count."""
    bare = F.regexp_replace("text", r"https?://\S+|[@#\uff20\uff03]\S+", " ")
    return english_only(posts.withColumn("_bare", bare), profile, "id", "_bare").drop("_bare")


def escaped_json(line: Column) -> Column:
    """JSON as strict consumers have it: '/' as '\\/', and DEL, C1 controls and U+2000-20FF as \\uXXXX."""
    rare = F.when(line.rlike(RARE), F.array_join(F.transform(F.split(line, ""), lambda c: F.when(c.rlike(RARE), F.concat(F.lit("\\u"), F.lpad(F.hex(F.ascii(c)), 4, "0"))).otherwise(c)), "")).otherwise(line)
    return F.replace(rare, F.lit("/"), F.lit("\\/"))


def to_json_lines(df: DataFrame, escaped: bool = False) -> DataFrame:
    """One JSON object per row, nulls kept; NaN and infinities are null."""
    finite = [F.when(F.isnan(f.name) | (F.abs(f.name) == float("inf")), None).otherwise(F.col(f.name)).alias(f.name) if f.dataType.typeName() in ("double", "float") else F.col(f.name) for f in df.schema.fields]
    line = F.to_json(F.struct(*finite), {"ignoreNullFields": "false"})
    return df.select((escaped_json(line) if escaped else line).alias("value"))


def write_json_lines(df: DataFrame, path: str, compression: str = "bzip2") -> None:
    to_json_lines(df).write.mode("overwrite").option("compression", compression).text(path)


def read_tsv(spark: SparkSession, path: str, schema: str, header: bool = False) -> DataFrame:
    return spark.read.schema(schema).option("sep", "\t").option("header", header).csv(path)


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").csv(path)


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_single_text(df: DataFrame, path: str) -> None:
    """Rows joined by commas in one file: for results of a few rows."""
    df.select(F.concat_ws(",", *[F.col(c).cast("string") for c in df.columns]).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def tsv_to_csv(spark: SparkSession, source: str, target: str) -> None:
    """Header kept, cells trimmed, NaN to empty; empty cells stay cells."""
    df = spark.read.option("header", True).option("sep", "\t").option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(source)
    df.select([F.when(F.col(c) == "NaN", None).otherwise(F.col(c)).alias(c) for c in df.columns]).write.mode("overwrite").option("header", True).option("nullValue", "").csv(target)


def merge_iterations(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """Result files of all iterations as one table, by iteration and hashtag."""
    return spark.read.schema(schema).csv(paths).orderBy("iteration", "hashtag")


def read_features(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, int]]:
    """Feature file -> (row_id, label, feature_id, value, family) of non-zeros, and the header's counts.

    A line is `tid ([i,..],[v,..]) label`; families are consecutive ranges of feature ids, in header order.
    Values below 1e-12 are zeros. Rows without a non-zero are kept, with a null feature.
    """
    lines = spark.read.text(path).filter(~F.col("value").startswith("#"))
    head = lines.filter(F.col("value").rlike(r"^\s*\w+\s*=")).first()["value"]
    counts = dict(zip(HEADER, (int(x.split("=")[1]) for x in head.split(","))))
    shape = r"^\s*(\d+)\s*\(\[([^\]]*)\],\s*\[([^\]]*)\]\)\s*(\S+)\s*$"
    rows = lines.filter(F.col("value").rlike(shape)).select(
        F.regexp_extract("value", shape, 1).cast("long").alias("row_id"),
        F.regexp_extract("value", shape, 4).cast("double").alias("label"),
        F.explode_outer(F.expr(rf"filter(arrays_zip(transform(filter(split(regexp_extract(value, '{shape}', 2), ','), x -> trim(x) != ''), x -> cast(trim(x) as int)), transform(filter(split(regexp_extract(value, '{shape}', 3), ','), x -> trim(x) != ''), x -> cast(trim(x) as double))), z -> abs(z['1']) >= 1e-12)".replace("\\", "\\\\"))).alias("z"),
    )
    family, upto = None, 0
    for name in FAMILIES:
        upto += counts[name]
        family = (F if family is None else family).when(F.col("feature_id") < upto, name)
    return rows.select("row_id", "label", F.col("z")["0"].alias("feature_id"), F.col("z")["1"].alias("value")).withColumn("family", family), counts


def read_properties(path: str) -> dict[str, str]:
    """A driver-side properties file: '#' comments, key=value."""
    with open(path) as f:
        pairs = (line.strip().partition("=") for line in f if line.strip() and not line.lstrip().startswith("#"))
        return {k.strip(): v.strip() for k, _, v in pairs}


def topic_schema() -> T.StructType:
    return T.StructType([T.StructField("topic", T.StringType()), T.StructField("ap_rank", T.IntegerType()), T.StructField("mi_rank", T.IntegerType()), T.StructField("ap", T.DoubleType()), T.StructField("mi", T.DoubleType())])


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stream_checkpoint(spark: SparkSession) -> str:
    """A new folder for a stream's state."""
    return work_folder(spark, "stream")
