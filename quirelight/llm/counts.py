r"""Token counts by overlap resynchronisation, as a tokenizers vocabulary of byte-level BPE gives them.

The vocabulary cuts a text into pieces by one pattern from left to right, without looking back, and merges bytes inside pieces only. So
what follows a piece's start depends on the text from there on alone. Two things are built on this:

* A huge text is cut into chunks that overlap, which become rows of their own and are encoded with offsets wherever Spark puts them. A
  place in an overlap where a piece starts in the left chunk's encoding and in the right one's is where they are spliced, if it lies far
  enough before the left chunk's end that no more text could move it (`margin`); the left chunk is right up to there by the same
  argument, the first chunk being right from its start. Texts with an overlap without such a place come again with overlaps, and if need
  be chunks, four times as wide, at last as one chunk.
* Any other text is cut before each space that stands before anything but white space, where a piece always starts, and each distinct
  part is encoded once by a worker (which remembers a bounded number of them), however often it occurs.

Texts that hold an added token (a special string; it is one token, as the library has it by default) are encoded whole or in chunks.
A vocabulary with a normalizer, another pre-tokenizer or a post-processor is applied to whole texts.

Defined results: null text is empty (no bytes, no tokens); texts of any length are counted whole; repeated rows are counted alike, a
huge text once for all its copies; an empty table gives an empty result; other columns are not read. A piece of any length is encoded
by one task, since a merge may reach across all of it.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, text_of

#: Code points of a chunk and of an overlap; texts longer than a chunk are huge.
CHUNK, OVERLAP = 65_536, 256
#: Parts that a worker remembers, and the length from which one is not remembered.
REMEMBERED, LONG = 1_000_000, 256
#: Code points of texts that are counted together.
TOGETHER = 4_000_000
ODD_SPACE = re.compile(r" (?:\s|\Z)")
CUT = re.compile(r"(?= \S)")


class Counter:
    """Counts tokens with one vocabulary, given as the text of its file."""

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel part
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        form = json.loads(spec)
        self.added = [t["content"] for t in form.get("added_tokens") or ()]
        cutter = form.get("pre_tokenizer") or {}
        plain_added = not any(t["lstrip"] or t["rstrip"] or t["normalized"] or t["single_word"] or t["content"].strip() != t["content"] for t in form.get("added_tokens") or ())
        self.local = plain_added and not form.get("normalizer") and not form.get("post_processor") and cutter.get("type") == "ByteLevel" and cutter.get("use_regex", True) and not cutter.get("add_prefix_space")
        #: A piece's extent shows at most 3 code points beyond its start or 1 beyond its end; an added token shows whole.
        self.margin = max([4, *(len(t) + 1 for t in self.added)])
        self.first: dict[str, int] = {}
        self.later: dict[str, int] = {}

    def whole(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def count(self, texts: list[str]) -> list[int]:
        if not self.local:
            return self.whole(texts)
        if len(self.first) + len(self.later) > REMEMBERED:
            self.first, self.later = {}, {}
        out: list[int | None] = [None] * len(texts)
        special = [i for i, t in enumerate(texts) if any(a in t for a in self.added)]
        for i, n in zip(special, self.whole([texts[i] for i in special]), strict=True):
            out[i] = n
        first, later, parts = set(), set(), {}
        for i, text in enumerate(texts):
            if out[i] is None:
                if ODD_SPACE.search(text):
                    parts[i] = (CUT.split(text), [])
                else:
                    head, *rest = text.split(" ")
                    parts[i] = ([head], rest)
                first.update(parts[i][0])
                later.update(parts[i][1])
        for known, fresh, front in ((self.first, first, ""), (self.later, later, " ")):
            fresh = list(fresh - known.keys())
            known.update(zip(fresh, self.whole([front + part for part in fresh]), strict=True))
        for i, (some, rest) in parts.items():
            out[i] = sum(map(self.first.__getitem__, some)) + sum(map(self.later.__getitem__, rest))
        for known, used in ((self.first, first), (self.later, later)):
            for part in used:
                if len(part) > LONG:
                    del known[part]
        return out

    def starts(self, text: str) -> tuple[list[tuple[int, int]], int]:
        """(place, tokens before it) of each piece of the text, and the number of tokens."""
        coded = self.tokenizer.encode(text, add_special_tokens=False)
        found, last = [], object()
        for token, (piece, (place, _)) in enumerate(zip(coded.word_ids, coded.offsets, strict=True)):
            if piece is None or piece != last:
                found.append((place, token))
                last = piece if piece is not None else object()
        return found, len(coded)


_counters: dict[int, Counter] = {}


def _counter(spec: str) -> Counter:
    key = hash(spec)
    if key not in _counters:
        _counters[key] = Counter(spec)
    return _counters[key]


def _groups(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most TOGETHER code points, or one text."""
    begin = size = 0
    for at, text in enumerate(texts):
        if at > begin and size + len(text) > TOGETHER:
            yield begin, at
            begin, size = at, 0
        size += len(text)
    if begin < len(texts):
        yield begin, len(texts)


def _spliced(texts: DataFrame, spec, chunk: int, overlap: int) -> tuple[DataFrame, DataFrame]:
    """(digest, n_tokens) of the huge texts (digest, text) whose chunks could all be spliced, and digest of the others."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for digest, text in zip(batch.column("digest").to_pylist(), batch.column("text").to_pylist(), strict=True):
                last = max(0, -(-(len(text) - overlap) // chunk) - 1)
                for k in range(last + 1):
                    part = text[k * chunk : (k + 1) * chunk + overlap if k < last else len(text)]
                    yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (digest, k, k == last, part)], names=["digest", "k", "last", "part"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(spec.value)
        for batch in batches:
            for digest, k, last, part in zip(*(batch.column(c).to_pylist() for c in ("digest", "k", "last", "part")), strict=True):
                found, n = counter.starts(part)
                # zone k lies between chunks k and k + 1; places count from its start, which is the right chunk's
                rows = [(k - 1, False, place, before) for place, before in found if place < overlap] if k else []
                rows += [(k, True, place - chunk, before) for place, before in found if place >= chunk and place < chunk + overlap - counter.margin] if not last else [(k, True, -1, n)]
                zone, left, place, before = zip(*rows, strict=True) if rows else ((), (), (), ())
                columns = [[digest] * len(rows), zone, left, place, before, [last] * len(rows)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.bool_()), strict=True)], names=["digest", "zone", "left", "place", "before", "last"])

    chunks = texts.mapInArrow(cut, "digest string, k long, last boolean, part string").repartition("digest", "k")
    starts = materialize(chunks.mapInArrow(encode, "digest string, zone long, left boolean, place long, before long, last boolean"), "starts")
    ends = starts.filter("left and place = -1").select("digest", F.col("zone").alias("zones"), F.col("before").alias("n"))
    left = starts.filter("left and place >= 0").select("digest", "zone", "place", F.col("before").alias("above"))
    right = starts.filter("not left").select("digest", "zone", "place", "before")
    splices = left.join(right, ["digest", "zone", "place"]).groupBy("digest", "zone").agg(F.min_by(F.col("above") - F.col("before"), "place").alias("n"))
    sums = splices.groupBy("digest").agg(F.count(F.lit(1)).alias("found"), F.sum("n").alias("spliced"))
    done = materialize(ends.join(sums, "digest", "left").select("digest", (F.coalesce("found", F.lit(0)) == F.col("zones")).alias("whole"), (F.col("n") + F.coalesce("spliced", F.lit(0))).alias("n_tokens")), "spliced")
    return done.filter("whole").select("digest", "n_tokens"), done.filter("not whole").select("digest")


def count_tokens(docs: DataFrame, path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens (long) for every row of docs (doc_id, text); path: a file of the tokenizers library."""
    spark = docs.sparkSession
    with open(path, encoding="utf-8") as lines:  # a vocabulary's size does not depend on the corpus
        text = lines.read()
    spec, local = spark.sparkContext.broadcast(text), Counter(text).local
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", text_of().alias("text"))
    huge = F.length("text") > chunk + overlap if local else F.lit(False)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(spec.value)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            counts = [n for a, b in _groups(texts) for n in counter.count(texts[a:b])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(counts, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    sized = lambda some: some.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text")
    out = sized(rows.filter(~huge)).mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long")
    if not local:
        return out
    long = rows.filter(huge).withColumn("digest", F.sha2("text", 256))
    texts = materialize(long.groupBy("digest").agg(F.first("text").alias("text")), "huge-texts")
    counted, waiting = [], texts
    while not waiting.isEmpty():
        done, failed = _spliced(waiting, spec, chunk, overlap)
        counted.append(done)
        overlap *= 4
        chunk = max(chunk, 4 * overlap)
        waiting = texts.join(failed, "digest", "left_semi")
    if not counted:
        return out
    found = counted[0]
    for more in counted[1:]:
        found = found.union(more)
    ids = long.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes"))
    return out.union(ids.join(found, "digest").select("doc_id", "n_bytes", "n_tokens"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counted = count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 512)
