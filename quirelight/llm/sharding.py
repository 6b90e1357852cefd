"""Sharding by a two-pass external shuffle.

Pass one scatters the records uniformly into memory-sized buckets by a seeded hash of the whole record's identity (doc_id and
text). Pass two loads one bucket at a time, puts it in a fixed order, shuffles it by Fisher-Yates with a generator seeded by
(seed, bucket), and numbers it from the bucket's offset, the number of records in earlier buckets; shard = place mod shards and
slot = place div shards. Hence the law `rows`: shard sizes differ by one record at most and slots have no gaps.

Counts are taken before texts move, so texts are shuffled once. The offsets (8 bytes a bucket, 26 MB for 100 TB) go to all tasks.
Buckets hold about `bucket_bytes` of text however large the input is; equal seeds give equal results on any cluster. Rows of one
identity that would fill a bucket alone are scattered by their place in the input instead, so docs should be a table or something
else that gives the same rows each time.

Defined results: null text counts as no bytes (size 1, CRC 0); repeated rows are records of their own, their order among
themselves does not matter; an empty table gives empty shards; all other columns pass through `shuffle_into_shards`, and if one is called
shard or slot it gets underscores in front until its name is free.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import shuffle_partitions, text_of

SHARDS = 16
BUCKET_BYTES = 32 << 20


def fisher_yates(n: int, rng: np.random.Generator) -> np.ndarray:
    """A uniform permutation of range(n): each place, from the last down, is swapped with one drawn from those up to it."""
    order = list(range(n))
    draws = rng.integers(0, np.arange(n, 0, -1)).tolist()
    for i, j in zip(range(n - 1, 0, -1), draws, strict=False):
        order[i], order[j] = order[j], order[i]
    return np.array(order, np.int64)


def _shuffled(seed: int, shards: int, offsets):
    def bucket(key, table):  # no type hints: Spark would read them as a request for another kind of function
        number = key[0].as_py()
        order = np.lexsort([table.column(c).to_numpy() for c in ("text_key", "id_key")])
        order = order[fisher_yates(len(order), np.random.Generator(np.random.PCG64([seed, number])))]
        place = offsets.value[number] + np.arange(len(order), dtype=np.int64)
        return pa.table([table.column("row").take(pa.array(order)), pa.array((place % shards).astype(np.int32)), pa.array(place // shards)], names=["row", "shard", "slot"])

    return bucket


def _free_names(columns: list[str]) -> dict[str, str]:
    """Names for the columns of an input beside shard and slot."""
    taken, out = {"shard", "slot"} | {c.lower() for c in columns}, {}
    for c in columns:
        name = c
        if c.lower() in ("shard", "slot"):
            while name.lower() in taken:
                name = f"_{name}"
            taken.add(name.lower())
        out[c] = name
    return out


def shuffle_into_shards(docs: DataFrame, shards: int = SHARDS, seed: int = 42, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """All rows and columns of docs with shard (int) and slot (long)."""
    spark = docs.sparkSession
    rows, total = docs.agg(F.count(F.lit(1)), F.sum(F.octet_length(text_of()) + 1)).first()
    buckets = max(1, shuffle_partitions(spark), math.ceil((total or 0) / bucket_bytes))
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64("doc_id").alias("id_key"), F.xxhash64(text_of()).alias("text_key"))
    scatter = lambda *keys: F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(buckets)).cast("int")
    keyed = keyed.withColumn("bucket", scatter("id_key", "text_key"))
    count = lambda: keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).toArrow()
    counts, full = count(), 4 * rows // buckets + 1000
    crowded = [b for b, n in zip(*(c.to_pylist() for c in counts.columns), strict=True) if n > full]
    if crowded:
        hot = keyed.filter(F.col("bucket").isin(crowded)).groupBy("id_key", "text_key").count().filter(F.col("count") > full // 4).select("id_key", "text_key")
        hot = {(r["id_key"], r["text_key"]) for r in hot.collect()}  # each has over rows / buckets of the rows
        if hot:
            alone = F.struct("id_key", "text_key").isin([F.struct(F.lit(a), F.lit(b)) for a, b in sorted(hot)])
            keyed = keyed.withColumn("bucket", F.when(alone, scatter(F.monotonically_increasing_id())).otherwise(F.col("bucket")))
            counts = count()
    size = np.zeros(buckets + 1, np.int64)
    size[counts.column(0).to_numpy() + 1] = counts.column(1).to_numpy()
    offsets = spark.sparkContext.broadcast(np.cumsum(size))
    schema = T.StructType([T.StructField("row", keyed.schema["row"].dataType), T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])
    placed = keyed.groupBy("bucket").applyInArrow(_shuffled(seed, shards, offsets), schema)
    return placed.select(*[F.col(f"row.`{c}`").alias(name) for c, name in _free_names(docs.columns).items()], "shard", "slot")


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """Write shard=K/ folders of Parquet; rows carry their slot and are sorted by it in each file."""
    out = shuffle_into_shards(docs, **options)
    out.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op10_shuffled_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = text_of()
    return shuffle_into_shards(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
