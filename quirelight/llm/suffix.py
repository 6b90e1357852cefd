"""Suffix-array removal of repeated byte strings, by a distributed merge sort that knows common prefixes.

A byte is removed if a string of `length` bytes over it starts anywhere else too (same document included). Sorting all suffixes of a
corpus would move hundreds of bytes for each byte of text, so a sparse suffix array is sorted, from which the same answer follows:

1. Anchors. Each window of `length` bytes is given to the k-byte string in it (k: a power of two, about a third of the length) with
   the least hash (the leftmost on ties). The choice
   depends on the window's bytes alone, so equal windows have equal anchors in the same place. An anchor serves a run of windows.
   Anchors whose hash occurs once in the corpus cannot take part; they go.
2. Runs. The suffix at an anchor (the bytes from it to the end of its last window, then the bytes back to the start of its first
   window, reversed) stands for all its windows. A task sorts its suffixes; equal ones are settled there and then, and one of them
   goes on. The run is front-coded: the length of the prefix shared with the suffix before, and the rest.
3. Merge. Suffixes that may share k bytes go to one task, which merges the runs' blocks with a loser tree. Every suffix carries its
   common prefix with the last one sent; two are compared only where these are equal, and only from there on. Equal suffixes are
   adjacent: all their windows repeat. Where suffixes with a common anchor differ, those windows that the neighbours' common
   prefixes do not rule out are compared by 128-bit hashes.
4. Hot anchors (over HOT occurrences) are spread by the whole suffix; what of them differs is compared through a grouped count of
   window hashes, summed before the shuffle.

Rows with equal texts are one text to the sort, whatever their number: it is known without a look that all their windows repeat. Texts
are told apart by 128-bit digests.

Defined results: null text is empty; texts under `length` bytes keep all; texts of any size are read whole (long ones in overlapping
pieces); repeated rows are documents like others, so all their long strings repeat, with or without a doc_id;
empty tables give empty results; other columns are not read, but `remove_repeats` passes them through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest, xxh3_128_digest

from .common import materialize, shuffle_partitions

LENGTH = 400
#: Occurrences of an anchor from which its suffixes are spread over tasks.
HOT = 4096
#: Bytes of suffixes that a task sorts as one run, that a merge target holds (about), and of rows that a task hands on at once.
RUN_BYTES = 24 << 20
TARGET_BYTES = 4 << 20
OUT_BYTES = 4 << 20
PIECE = 1 << 20
#: Texts that a task remembers to have met; what it forgets costs work, not results.
SEEN = 200_000
_PLACE = np.uint64(24)


def anchor_bytes(length: int) -> int:
    """k: the largest power of two up to a third of the length."""
    return 1 << max(0, (length // 3).bit_length() - 1)


def _hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each string of `size` bytes (a power of two), by doubling."""
    h = data.astype(np.uint64) + np.uint64(1)
    k, factor = 1, 0x9E3779B97F4A7C15
    while k < size:
        h = h[: len(h) - k] * np.uint64(factor) + h[k:]
        factor = factor * factor % (1 << 64)
        k *= 2
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def anchors(text: bytes, length: int = LENGTH) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Arrays (hash, place, first window, last window) of a text's anchors."""
    size = anchor_bytes(length)
    for start in range(0, max(1, len(text) - length + 1), PIECE):
        data = np.frombuffer(text, np.uint8)[start : start + PIECE + length - 1]
        if len(data) < length:
            return
        h = _hashes(data, size)
        least = (h >> _PLACE << _PLACE) | np.arange(len(h), dtype=np.uint64)
        wide, k = length - size + 1, 1
        while 2 * k <= wide:
            least = np.minimum(least[:-k], least[k:])
            k *= 2
        if wide > k:
            least = np.minimum(least[: k - wide], least[wide - k :])
        at = (least & np.uint64((1 << 24) - 1)).astype(np.int64)
        first = np.flatnonzero(np.diff(at, prepend=-1))
        last = np.append(first[1:] - 1, len(at) - 1)
        yield h[at[first]], at[first] + start, first + start, last + start


def _unseen(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, bytes]]:
    """(key, data) of a task's rows, texts that it remembers left out."""
    seen: set[bytes] = set()
    for batch in batches:
        for key, data in zip(batch.column(0), batch.column(1), strict=True):
            key = key.as_py()
            if key not in seen:
                if len(seen) > SEEN:
                    seen.clear()
                seen.add(key)
                yield key, data.as_py()


def _find_anchors(length: int):
    names = ["key", "h", "at", "first", "last"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[bytes] = []
        parts: list[tuple[np.ndarray, ...]] = []
        held = 0

        def flush() -> pa.RecordBatch:
            of = np.repeat(np.arange(len(parts)), [len(x[0]) for x in parts])
            h, at, first, last = (np.concatenate(x) for x in zip(*parts, strict=True))
            out = pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()).take(pa.array(of)), pa.array(h.view(np.int64)), *(pa.array(x.astype(np.int32)) for x in (at, first, last))], names=names)
            keys.clear()
            parts.clear()
            return out

        for key, data in _unseen(batches):
            for found in anchors(data, length):
                keys.append(key)
                parts.append(found)
                held += len(found[0])
            if held > 50_000:
                yield flush()
                held = 0
        if parts:
            yield flush()

    return run


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, of which `known` bytes are known already."""
    n = min(len(a), len(b))
    while known < n:
        step = min(n - known, 64)
        x = int.from_bytes(a[known : known + step]) ^ int.from_bytes(b[known : known + step])
        if x:
            return known + step - (x.bit_length() + 7) // 8
        known += step
    return n


def front_code(run: list[tuple[bytes, bytes, int]]) -> bytes:
    """A sorted run of (suffix, owner, first window) as a compressed block. Owners are KEY bytes."""
    shared, rests, last = [], [], b""
    for suffix, _, _ in run:
        n = common_prefix(last, suffix)
        shared.append(n)
        rests.append(suffix[n:])
        last = suffix
    head = np.array([shared, [len(r) for r in rests], [x[2] for x in run]], np.int32).tobytes()
    return len(run).to_bytes(4, "little") + zstandard.ZstdCompressor(3).compress(b"".join([head, *(x[1] for x in run), *rests]))


def decode(block: bytes) -> Iterator[tuple[int, bytes, bytes, int]]:
    """(prefix shared with the one before, suffix, owner, first window) of a block, in order."""
    n = int.from_bytes(block[:4], "little")
    data = zstandard.ZstdDecompressor().decompress(block[4:])
    shared, sizes, firsts = np.frombuffer(data, np.int32, 3 * n).reshape(3, n).tolist()
    at, last = (12 + KEY) * n, b""
    for k in range(n):
        last = last[: shared[k]] + data[at : at + sizes[k]]
        at += sizes[k]
        yield shared[k], last, data[12 * n + KEY * k : 12 * n + KEY * (k + 1)], firsts[k]


def merge(runs: list[Iterator[tuple[int, bytes, bytes, int]]]) -> Iterator[tuple[int, bytes, bytes, int]]:
    """One sorted stream of sorted runs. Each item comes with its common prefix with the item before.

    known[i] is the common prefix of run i's head with the last item that was sent on from i's part of the tree: if two heads differ
    in it, the longer is smaller, without a look at the bytes; if not, bytes are compared from there on."""
    width = 1
    while width < len(runs):
        width *= 2
    runs = [*runs, *[iter(())] * (width - len(runs))]
    heads: list[tuple[int, bytes, bytes, int] | None] = [next(r, None) for r in runs]
    known = [0] * width
    losers = [0] * width

    def play(i: int, j: int) -> tuple[int, int]:
        a, b = heads[i], heads[j]
        if a is None:
            return j, i
        if b is None or known[i] > known[j]:
            return i, j
        if known[i] < known[j]:
            return j, i
        x, y = a[1], b[1]
        n = common_prefix(x, y, known[i])
        if n == len(x) or n < len(y) and x[n] < y[n]:
            known[j] = n
            return i, j
        known[i] = n
        return j, i

    winners = list(range(width))
    level = width // 2
    while level:
        pairs = [play(winners[2 * k], winners[2 * k + 1]) for k in range(level)]
        for k, (_, loser) in enumerate(pairs):
            losers[level + k] = loser
        winners = [w for w, _ in pairs]
        level //= 2
    best = winners[0]
    while heads[best] is not None:
        _, suffix, owner, first = heads[best]
        yield known[best], suffix, owner, first
        heads[best] = head = next(runs[best], None)
        known[best] = head[0] if head else 0
        node = (best + width) // 2
        while node:
            best, losers[node] = play(best, losers[node])
            node //= 2


#: Suffixes end in (bytes before the anchor, windows after the first), two bytes each, so they are equal only if their windows are.
_TAIL = 4
#: Bytes of a text's key, and the owner of a suffix that stands for several.
KEY = 16
NOBODY = bytes(KEY)


def _suffix(text: bytes, at: int, first: int, last: int, length: int) -> bytes:
    return text[at : last + length] + text[first:at][::-1] + (at - first).to_bytes(2) + (last - first).to_bytes(2)


def _windows(suffix: bytes, length: int, rights: int | None = None) -> list[tuple[int, bytes]]:
    """(number, hash) of a suffix's windows; with rights, only of those that reach no further than so many bytes after the anchor."""
    before, more = int.from_bytes(suffix[-4:-2]), int.from_bytes(suffix[-2:])
    end = len(suffix) - _TAIL - before
    text = suffix[end : end + before][::-1] + suffix[:end]
    most = more if rights is None else min(more, before + rights - length)
    return [(k, xxh3_128_digest(text[k : k + length])) for k in range(most + 1)]


def _make_runs(targets: int, length: int):
    kinds = (pa.int32(), pa.binary(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        held: list[tuple[bytes, bytes, int, int]] = []

        def flush() -> pa.RecordBatch:
            held.sort()
            blocks: dict[int, list[tuple[bytes, bytes, int]]] = {}
            settled: dict[int, list[tuple[bytes, int, int]]] = {}
            k = 0
            while k < len(held):
                suffix, key, first, target = held[k]
                end = k + 1
                while end < len(held) and held[end][0] == suffix:
                    end += 1
                if end - k > 1:
                    more = int.from_bytes(suffix[-2:])
                    settled.setdefault(target, []).extend((x[1], x[2], x[2] + more) for x in held[k:end])
                    blocks.setdefault(target, []).append((suffix, NOBODY, -1))
                else:
                    blocks.setdefault(target, []).append((suffix, key, first))
                k = end
            held.clear()
            rows = []
            for target in sorted(blocks):
                sure = settled.get(target, [])
                places = np.array([[x[1] for x in sure], [x[2] for x in sure]], np.int32).tobytes()
                rows.append((target, front_code(blocks.pop(target)), b"".join([places, *(x[0] for x in sure)])))
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["target", "block", "settled"])

        size, last = 0, None
        for batch in batches:
            lists = batch.column(2)
            ends = lists.offsets.to_numpy()
            h, at, first, until, hot = (lists.values.field(k).to_numpy(zero_copy_only=False) for k in range(5))
            for row in range(batch.num_rows):
                key = batch.column(0)[row].as_py()
                if key == last:  # an equal text, which has been seen just now
                    continue
                last = key
                text = unpack(batch.column(1)[row].as_py())
                some = slice(ends[row], ends[row + 1])
                for a, b, c, d, e in zip(h[some].tolist(), at[some].tolist(), first[some].tolist(), until[some].tolist(), hot[some].tolist(), strict=True):
                    suffix = _suffix(text, b, c, d, length)
                    place = xxh3_64_intdigest(suffix) if e else a & 0xFFFFFFFFFFFFFFFF
                    # hot suffixes have targets of their own, below 0
                    held.append((suffix, key, c, -1 - place % targets if e else place % targets))
                    size += len(suffix) + 150
                if size > RUN_BYTES:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return run


_FOUND = "key binary, first int, last int, hash binary, n int"


def _merge_target(length: int):
    size = anchor_bytes(length)

    def merged(key, table):
        hot = key[0].as_py() < 0
        owners: list[bytes | None] = []
        firsts: list[int] = []
        lasts: list[int] = []
        marks: list[bytes | None] = []
        times: list[int | None] = []

        def span(owner: bytes, first: int, last: int) -> None:
            owners.append(owner)
            firsts.append(first)
            lasts.append(last)
            marks.append(None)
            times.append(None)

        for part in table.column("settled").to_pylist():
            n = len(part) // (8 + KEY)
            places = np.frombuffer(part, np.int32, 2 * n).reshape(2, n).tolist()
            for k in range(n):
                span(part[8 * n + KEY * k : 8 * n + KEY * (k + 1)], places[0][k], places[1][k])

        def settle(group: list[list]) -> None:
            """group: [suffix, common prefix with the one before, [(owner, first)...], whether it repeats] with a common anchor."""
            for suffix, _, own, repeats in group:
                if repeats:
                    more = int.from_bytes(suffix[-2:])
                    for owner, first in own:
                        if first >= 0:
                            span(owner, first, first + more)
            if hot:
                for suffix, _, own, repeats in group:
                    owner, first = (None, 0) if repeats else own[0]
                    for k, mark in _windows(suffix, length):
                        owners.append(owner)
                        firsts.append(first + k)
                        lasts.append(first + k)
                        marks.append(mark)
                        times.append(2 if repeats else 1)
                return
            if len(group) < 2 or all(x[3] for x in group):
                return
            reach = [max(x[1], group[k + 1][1] if k + 1 < len(group) else 0) if k else group[1][1] for k, x in enumerate(group)]
            windows = [_windows(x[0], length, r) for x, r in zip(group, reach, strict=True)]
            count: dict[bytes, int] = {}
            for x, own in zip(group, windows, strict=True):
                for _, mark in own:
                    count[mark] = count.get(mark, 0) + (2 if x[3] else 1)
            for x, own in zip(group, windows, strict=True):
                if not x[3]:
                    owner, first = x[2][0]
                    start = end = None
                    for k, mark in own:
                        if count[mark] > 1:
                            if end != k - 1:
                                if start is not None:
                                    span(owner, first + start, first + end)
                                start = k
                            end = k
                    if start is not None:
                        span(owner, first + start, first + end)

        group: list[list] = []
        for shared, suffix, owner, first in merge([decode(b.as_py()) for b in table.column("block")]):
            if group and shared == len(suffix) == len(group[-1][0]):
                group[-1][2].append((owner, first))
                group[-1][3] = True
                continue
            if group and (shared < size or hot):
                settle(group)
                group = []
            group.append([suffix, shared, [(owner, first)], first < 0])
        if group:
            settle(group)
        schema = pa.schema([("key", pa.binary()), ("first", pa.int32()), ("last", pa.int32()), ("hash", pa.binary()), ("n", pa.int32())])
        return pa.table([owners, firsts, lasts, marks, times], schema=schema)

    return merged


def repeated_windows(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """key, first, last: ranges of places where strings of `length` bytes start that start elsewhere too. docs: key (KEY bytes, equal only for
    equal data), data (binary); rows may repeat."""
    spark = docs.sparkSession
    size = F.octet_length("data")
    copies = docs.filter(size >= length).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.first(size).alias("size")).filter("n > 1")
    copies = copies.select("key", F.lit(0).alias("first"), (F.col("size") - length).cast("int").alias("last"))
    found = docs.select("key", "data").mapInArrow(_find_anchors(length), "key binary, h long, at int, first int, last int")
    # written, so that both sides of the join below are shuffled for it alone and Spark can split an anchor that is everywhere
    often = materialize(found.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "anchors")
    total = often.agg(F.sum("n")).first()[0] or 0
    targets = max(4 * shuffle_partitions(spark), total * length // TARGET_BYTES)
    met = found.join(often.select("h", (F.col("n") > HOT).alias("hot")), "h")
    lists = met.groupBy("key").agg(F.collect_set(F.struct("h", "at", "first", "last", "hot")).alias("anchors"))
    texts = docs.select("key", "data").mapInArrow(_pack_unseen, "key binary, data binary")
    runs = texts.join(lists, "key").select("key", "data", "anchors").mapInArrow(_make_runs(targets, length), "target int, block binary, settled binary")
    merged = materialize(runs.groupBy("target").applyInArrow(_merge_target(length), _FOUND), "repeats")
    sure = merged.filter("n is null").select("key", "first", "last")
    hot = merged.filter("n is not null")
    twice = hot.groupBy("hash").agg(F.sum("n").alias("times")).filter("times > 1").select("hash")
    return sure.union(hot.filter("key is not null").join(twice, "hash").select("key", "first", "last")).union(copies)


class _Out:
    """Rows on their way out of a task, handed on by OUT_BYTES."""

    def __init__(self, *columns: tuple[str, pa.DataType]):
        self.names, self.kinds = zip(*columns, strict=True)
        self.rows: list[tuple] = []
        self.size = 0

    def add(self, row: tuple, size: int) -> bool:
        self.rows.append(row)
        self.size += size
        return self.size > OUT_BYTES

    def batch(self) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*self.rows, strict=True) if self.rows else [[]] * len(self.kinds), self.kinds, strict=True)], names=self.names)
        self.rows, self.size = [], 0
        return out


def _pack_unseen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compressed texts, those left out that the task remembers. zstd halves what the shuffle's own compression leaves."""
    compress = zstandard.ZstdCompressor(1).compress
    out = _Out(("key", pa.binary()), ("data", pa.binary()))
    for key, data in _unseen(batches):
        packed = compress(data)
        if out.add((key, packed), len(packed)):
            yield out.batch()
    yield out.batch()


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compress the data column."""
    compress = zstandard.ZstdCompressor(1).compress
    for batch in batches:
        at = batch.schema.get_field_index("data")
        columns = list(batch.columns)
        columns[at] = pa.array((compress(x.as_py()) for x in batch.column(at)), pa.binary())
        yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)


def cut(data: bytes, windows: list[tuple[int, int]], length: int = LENGTH) -> tuple[int, int, bytes]:
    """Bytes removed, maximal runs of them, and what remains, if the windows that start in these ranges go."""
    kept, at, removed, n, end = [], 0, 0, 0, -1
    for first, last in sorted(windows):
        if first > end:
            n += 1
            kept.append(data[at:first])
        else:
            first = end
        end = at = max(end, last + length)
        removed += max(0, end - first)
    kept.append(data[at:])
    return removed, n, b"".join(kept)


def _cut(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        kinds = (("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary()), ("text", pa.string()))
        for batch in batches:
            rests, datas, spans = (batch.column(c) for c in ("_rest", "_data", "_spans"))
            out, start = _Out(*kinds), 0
            for row in range(batch.num_rows):
                data = unpack(datas[row].as_py())
                removed, n, kept = cut(data, [(x["first"], x["last"]) for x in spans[row].as_py() or ()], length)
                if out.add((len(data), removed, n, kept, kept.decode("utf-8", "ignore")), 2 * len(kept)) or row == batch.num_rows - 1:
                    found = out.batch()
                    yield pa.RecordBatch.from_arrays([rests.slice(start, row + 1 - start), *found.columns], names=["_rest", *found.schema.names])
                    start = row + 1

    return run


def cut_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Every row of docs: _rest (its columns but text), n_bytes, n_removed, n_spans, kept (the remaining bytes), text (kept, without
    the bytes of characters that were cut in two)."""
    data = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rest = F.struct(F.lit(None).cast("boolean").alias("_"), *[F.col(f"`{c}`") for c in docs.columns if c != "text"])
    rows = docs.select(F.unhex(F.md5(data)).alias("key"), data.alias("data"), rest.alias("_rest"))
    spans = repeated_windows(rows.select("key", "data"), length).groupBy("key").agg(F.collect_set(F.struct("first", "last")).alias("_spans"))
    found = rows.mapInArrow(_pack, rows.schema).join(spans, "key", "left").select("_rest", F.col("data").alias("_data"), "_spans")
    kind = rows.schema["_rest"].dataType.simpleString()
    return found.mapInArrow(_cut(length), f"_rest {kind}, n_bytes long, n_removed long, n_spans long, kept binary, text string")


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs with the text that remains, all columns; n_chars, if there is such a column, follows it."""
    out = cut_repeats(docs, length)
    own = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return out.select(*[own.get(c, F.col(f"_rest.`{c}`")).alias(c) for c in docs.columns])


def op2_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cut_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("_rest.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "text")
