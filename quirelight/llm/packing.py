"""Packing into optimal length buckets.

Tokens are words. A text longer than the context is cut into sequences of at most `context` words; a sequence is the exact piece of
the text up to where the next one's first word starts, so a document's sequences in order are its text. The global histogram of
sequence lengths has at most `context` entries however large the corpus is; it alone comes to the driver. Dynamic programming over it
chooses the bucket boundaries that minimise padding (each sequence is padded to its bucket's boundary). Inside a bucket, batches hold
floor(budget / boundary) sequences, numbered in a seeded order without gaps; every batch but a bucket's last is full.

Numbering takes blocks: sequences of a bucket are dealt by hash into blocks of about BLOCK_BYTES, a block is sorted by one task, and its
first number is the sum of the counts of the blocks before it. The counts (a row a block, 16 bytes; 40 MB for 100 TB) are taken before
texts move and go to all tasks, so texts are shuffled once.

Defined results: null and wordless texts make one sequence of 0 words (boundary at least 1), so no document is lost; repeated rows
are packed one by one; an empty table gives an empty result; of the input's other columns none is read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions

CONTEXT = 2048
BUCKETS = 16
BUDGET = 16_384
BLOCK_BYTES = 32 << 20
#: Bytes of texts that a task hands on at once.
OUT_BYTES = 4 << 20
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def boundaries(histogram: dict[int, int], buckets: int) -> list[int]:
    """The upper lengths of at most `buckets` buckets that cover the histogram with least padding; fewest buckets on ties."""
    lengths = np.array(sorted(histogram), np.int64)
    counts = np.array([histogram[x] for x in lengths.tolist()], np.float64)
    n = len(lengths)
    if not n:
        return []
    total = np.concatenate([[0.0], np.cumsum(counts)])
    best = total[1:] * lengths  # padded size of the first k+1 lengths in one bucket
    cuts = []
    for _ in range(min(buckets, n) - 1):
        # best[k] = min over j < k of best[j] + (total[k+1] - total[j+1]) * lengths[k]
        cost = best[None, :] - total[None, 1:] * lengths[:, None] + (total[1:] * lengths)[:, None]
        cost[np.triu_indices(n)] = np.inf
        cut = cost.argmin(axis=1)
        new = cost[np.arange(n), cut]
        better = new < best
        cuts.append(np.where(better, cut, -1))
        best = np.where(better, new, best)
    out, k = [int(lengths[-1])], n - 1
    for cut in reversed(cuts):
        if cut[k] >= 0:
            k = int(cut[k])
            out.append(int(lengths[k]))
    return sorted(out)


def cut(text: bytes, context: int) -> list[tuple[int, bytes]]:
    """(words, piece) of a text's sequences."""
    n = len(text.split())
    if n <= context:
        return [(n, text)]
    starts = [m.start() for m in WORD.finditer(text)][::context]
    ends = [*starts[1:], len(text)]
    starts[0] = 0
    return [(min(context, n - k * context), text[a:b]) for k, (a, b) in enumerate(zip(starts, ends, strict=True))]


def _lengths(context: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times: Counter[int] = Counter()
        size = 0
        for batch in batches:
            for text in batch.column(0):
                text = (text.as_py() or "").encode()
                n = len(text.split())
                size += len(text)
                times[context] += n // context
                if n % context or not n:
                    times[n % context] += 1
        yield pa.RecordBatch.from_arrays([pa.array([*times, -1], pa.int64()), pa.array([*times.values(), size], pa.int64())], names=["n_tokens", "n"])

    return run


def _sequences(context: int):
    kinds = (pa.int32(), pa.int64(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[int] = []
            out: list[tuple[int, int, str]] = []
            size = 0
            for row in range(batch.num_rows):
                for part, (n, piece) in enumerate(cut((batch.column(1)[row].as_py() or "").encode(), context)):
                    rows.append(row)
                    out.append((part, n, piece.decode()))
                    size += len(piece)
                if size > OUT_BYTES or row == batch.num_rows - 1:
                    columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), *columns], names=["doc_id", "part", "n_tokens", "text"])
                    rows, out, size = [], [], 0

    return run


def sequences(docs: DataFrame, context: int = CONTEXT) -> DataFrame:
    """doc_id, part (from 0), n_tokens and text of every sequence; a document's parts in order are the whole text."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(_sequences(context), f"doc_id {kind}, part int, n_tokens long, text string")


def pack(docs: DataFrame, context: int = CONTEXT, buckets: int = BUCKETS, budget: int = BUDGET, seed: int = 42) -> DataFrame:
    """Every sequence (doc_id, part, n_tokens, text) with bucket (from 0), padded_tokens (the boundary), batch (in its bucket, from 0) and
    slot (in its batch). A batch is the texts of its rows, in the order of their slots."""
    spark = docs.sparkSession
    counted = docs.select(F.col("text").cast("string")).mapInArrow(_lengths(context), "n_tokens long, n long").groupBy("n_tokens").agg(F.sum("n").alias("n"))
    histogram: Counter[int] = Counter()
    size = 0
    for r in counted.collect():  # at most context + 2 rows
        if r["n_tokens"] < 0:
            size = r["n"]
        elif r["n"]:
            histogram[max(1, r["n_tokens"])] += r["n"]
    tops = boundaries(histogram, buckets) or [1]
    total = max(1, sum(n * k for n, k in histogram.items()))
    share = [sum(n * k for n, k in histogram.items() if low < n <= top) / total for low, top in zip([0, *tops[:-1]], tops, strict=True)]
    most = max(shuffle_partitions(spark), size // BLOCK_BYTES)
    blocks = np.maximum(1, np.ceil(np.array(share) * most)).astype(int)
    first = np.concatenate([[0], np.cumsum(blocks)]).tolist()
    top = F.array(*[F.lit(t).cast("long") for t in tops])
    bucket = F.size(F.filter(top, lambda t: t < F.greatest(F.lit(1), "n_tokens"))).cast("int")
    key = F.xxhash64(F.lit(seed), "doc_id", "part", "text")
    number = F.get(F.array(*map(F.lit, first[:-1])), F.col("bucket")) + F.pmod(F.col("_key"), F.get(F.array(*[F.lit(int(b)) for b in blocks]), F.col("bucket")))
    keyed = sequences(docs, context).withColumns({"bucket": bucket, "_key": key}).withColumn("_block", number.cast("int"))
    found = keyed.groupBy("_block").agg(F.count(F.lit(1)).alias("n")).toArrow()
    counts = np.zeros(first[-1], np.int64)
    counts[found.column(0).to_numpy()] = found.column(1).to_numpy()
    before = np.concatenate([[0], np.cumsum(counts)[:-1]])
    before -= np.repeat(before[np.array(first[:-1])], blocks)  # a bucket starts at 0
    offsets = spark.createDataFrame(pa.table({"_block": pa.array(np.arange(first[-1]), pa.int32()), "_before": before}))
    inside = F.row_number().over(Window.partitionBy("_block").orderBy("_key", "doc_id", "part", F.xxhash64("text"))) - 1
    per = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("padded_tokens"))).cast("long")
    out = keyed.withColumn("_inside", inside).join(F.broadcast(offsets), "_block").withColumns({"_at": F.col("_inside") + F.col("_before"), "padded_tokens": F.get(top, F.col("bucket"))})
    return out.select("doc_id", "part", "n_tokens", "text", "bucket", "padded_tokens", F.floor(F.col("_at") / per).cast("long").alias("batch"), F.pmod("_at", per).cast("long").alias("slot"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return packed.select("doc_id", "part", "n_tokens", "bucket", "padded_tokens", "batch", "slot", F.sha2("text", 256).alias("text_sha256"))
