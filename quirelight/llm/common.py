"""Helpers that the corpus operators share: the shared folder, tables written there, words, distributed numbering."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as every operator here splits words: space, and 0x09 to 0x0D.
SPACE = " \t\n\x0b\x0c\r"
SPLIT = r"[\x20\x09-\x0D]+"
#: bytes.translate table that lower-cases A-Z and leaves all other bytes, UTF-8 sequences too, as they are.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
UPPER_LETTERS, LOWER_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where that is unset and all runs on one machine (tests), a
    temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quirelight-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df into the shared folder and read it back: computed once, lineage cut, safe from lost executors.
    The files go when the driver's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


def text_of(column: str = "text") -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """The words [^\\x20\\x09-\\x0D]+ of a text, in order."""
    return F.filter(F.split(text, SPLIT), lambda w: w != "")


def let(value: Column, body) -> Column:
    """body(value) with value computed once per row: a lambda's variable is bound, an outer expression is not."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def numbered(df: DataFrame, group: list[str], block: str, order: list[str], to: str) -> DataFrame:
    """Number the rows of each group from 0 without gaps, in the order (block, order).

    Rows are numbered inside (group, block); a block's offset is the sum of the earlier blocks' counts. Blocks bound what one
    task sorts, so a group that holds most rows is still spread."""
    from pyspark.sql import Window

    counts = df.groupBy(*group, block).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*group, block, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*group, block).orderBy(*order)
    rows = df.withColumn("_inside", F.row_number().over(inside) - 1)
    return rows.join(offsets, [*group, block]).withColumn(to, F.col("_inside") + F.col("_offset")).drop("_inside", "_offset")
