"""Byte-level BPE encoding and decoding by corpus-level merge replay.

The distinct pieces of a task's share of the corpus are laid out in flat symbol lists, linked to their neighbours. An inverted
index leads from each mergeable token pair (by the rank of what it makes) to the positions where it stands. Merges are replayed in
rank order over all words at once; a merge looks only at the two neighbours it touches and files the pairs that it makes. A piece
is encoded once per worker (a bounded memory of pieces is kept between batches), however often it occurs.

Within one word the order is that of the usual encoder: the lowest rank first, the leftmost first. If a merge makes a pair of equal
or lower rank in its word, the word's later positions of the present rank wait for it.

Spark only maps: no shuffle, no skew; a task holds one Arrow batch and its pieces. Defined results: null text is empty (no tokens,
hashes of nothing); texts of any length are encoded whole; repeated rows are encoded alike; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Chunks that a worker remembers between batches, and the length from which one is not remembered.
REMEMBERED, LONG = 400_000, 256
#: Code points of text that are replayed together, which bounds a worker's memory; a longer text is replayed alone.
TOGETHER = 12 << 20
#: From this many places on, the merges of a rank are applied as one array operation.
MANY = 24
#: With a pattern that is `spaced`, a text can be cut into chunks before each space that stands before anything but white space, and
#: a chunk of letters alone (with the space in front) is one piece. Other patterns are applied to whole texts.
ODD_SPACE = re.compile(r" (?:\s|\Z)")
CUT = re.compile(r"(?= \S)")


class Replay:
    """Encoder for one vocabulary: `tokens` holds each token's bytes at its rank (None: unused)."""

    def __init__(self, tokens: list[bytes | None], pattern: str, spaced: bool = False):
        self.tokens = tokens
        self.spaced = spaced
        self.ranks = ranks = {t: i for i, t in enumerate(tokens) if t is not None}
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.find = regex.compile(pattern).findall
        #: (left << 32 | right) to the rank of what they make.
        self.pairs = {ranks[t[:k]] << 32 | ranks[t[k:]]: i for t, i in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks}
        self.pair_keys = np.array(sorted(self.pairs), np.int64)
        self.pair_ranks = np.array([self.pairs[k] for k in self.pair_keys.tolist()], np.int32)
        #: Tokens of which a later pair has no higher rank; their merges are applied one by one.
        self.careful = {x for k, i in self.pairs.items() for x in (k >> 32, k & 0xFFFFFFFF) if i <= x}
        self.first: dict[str, bytes] = {}
        self.later: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers."""
        if len(self.first) + len(self.later) > REMEMBERED:
            self.first, self.later = {}, {}
        first, later = set(), set()
        if not self.spaced:
            found = [self.find(text) for text in texts]
            fresh = {p for pieces in found for p in pieces} - self.first.keys()
            self.first |= self._replay(list(fresh))
            return [b"".join(map(self.first.__getitem__, pieces)) for pieces in found]
        for text in texts:
            if ODD_SPACE.search(text):
                first.update(CUT.split(text))
            else:
                head, *rest = text.split(" ")
                first.add(head)
                later.update(rest)
        first.difference_update(self.first)
        later.difference_update(self.later)
        long = [(known, c) for known, chunks in ((self.first, first), (self.later, later)) for c in chunks if len(c) > LONG]
        split = {True: [(c, [c] if c.isalpha() else self.find(c)) for c in first], False: [(c, [" " + c] if c.isalpha() else self.find(" " + c)) for c in later]}
        made = self._replay(list({p for chunks in split.values() for _, pieces in chunks for p in pieces}))
        for known, chunks in ((self.first, split[True]), (self.later, split[False])):
            for chunk, pieces in chunks:
                known[chunk] = made[pieces[0]] if len(pieces) == 1 else b"".join([made[p] for p in pieces])
        out = []
        for text in texts:
            if ODD_SPACE.search(text):
                out.append(b"".join(map(self.first.__getitem__, CUT.split(text))))
            else:
                head, *rest = text.split(" ")
                out.append(self.first[head] + b"".join(map(self.later.__getitem__, rest)))
        for known, chunk in long:
            del known[chunk]
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def _made(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ranks of what pairs make; -1 where they make nothing."""
        keys = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], -1)

    def _replay(self, pieces: list[str]) -> dict[str, bytes]:
        known: dict[str, bytes] = {}
        raws = []
        for piece in pieces:
            raw = piece.encode()
            if (whole := self.ranks.get(raw)) is not None:
                known[piece] = whole.to_bytes(4, "little")
            else:
                raws.append((piece, raw))
        if not raws:
            return known
        # one array item is a symbol; lists of the standard library and numpy share its memory
        lengths = np.array([len(raw) for _, raw in raws], np.int64)
        ends = np.cumsum(lengths)
        starts = ends - lengths
        symbol_of = self.byte[np.frombuffer(b"".join([raw for _, raw in raws]), np.uint8)]
        n = len(symbol_of)
        symbols, after, before = array("i", symbol_of.tobytes()), array("i", np.arange(1, n + 1, dtype=np.int32).tobytes()), array("i", np.arange(-1, n - 1, dtype=np.int32).tobytes())
        symbols_np, after_np, before_np = (np.frombuffer(x, np.int32) for x in (symbols, after, before))
        after_np[ends - 1] = -1
        before_np[starts] = -1

        index: dict[int, list[int]] = {}
        queue: list[int] = []

        def file(ranks: np.ndarray, places: np.ndarray) -> None:
            there = ranks >= 0
            ranks, places = ranks[there], places[there]
            if not len(places):
                return
            order = np.argsort(ranks, kind="stable")
            ranks, places = ranks[order], places[order]
            cuts = np.flatnonzero(np.diff(ranks, prepend=-1))
            places = places.tolist()
            for rank, a, b in zip(ranks[cuts].tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(places)], strict=True):
                if rank in index:
                    index[rank] += places[a:b]
                else:
                    index[rank] = places[a:b]
                    heapq.heappush(queue, rank)

        inner = np.flatnonzero(after_np >= 0)
        file(self._made(symbols_np[inner], symbols_np[inner + 1]), inner)
        pairs = self.pairs.get
        while queue:
            rank = heapq.heappop(queue)
            places = index.pop(rank, ())
            if len(places) >= MANY and rank not in self.careful:
                i = np.unique(np.array(places, np.int64))
                j = after_np[i]
                i, j = i[j >= 0], j[j >= 0]
                right = symbols_np[j]
                good = (symbols_np[i] >= 0) & (right >= 0)
                i, j = i[good], j[good]
                good = self._made(symbols_np[i], symbols_np[j]) == rank
                i, j = i[good], j[good]
                if not len(i):
                    continue
                if not np.isin(j, i, assume_unique=True).any():
                    k = after_np[j]
                    symbols_np[i], symbols_np[j] = rank, -1
                    after_np[i], after_np[j] = k, -1
                    near = k >= 0
                    before_np[k[near]] = i[near]
                    h = before_np[i]
                    right = symbols_np[np.maximum(k, 0)]
                    file(np.where(near, self._made(np.full(len(i), rank), right), -1), i)
                    far = h >= 0
                    h = h[far]
                    file(self._made(symbols_np[h], np.full(len(h), rank)), h)
                    continue
                places = i.tolist()
            waiting: set[int] = set()
            for i in sorted(set(places)):
                j = after[i]
                if j < 0 or symbols[i] < 0 or pairs(symbols[i] << 32 | symbols[j], -1) != rank:
                    continue
                if waiting and int(np.searchsorted(starts, i, "right")) in waiting:
                    if rank not in index:
                        index[rank] = []
                        heapq.heappush(queue, rank)
                    index[rank].append(i)
                    continue
                symbols[i], symbols[j] = rank, -1
                after[i] = k = after[j]
                after[j] = -1
                h = before[i]
                news = []
                if k >= 0:
                    before[k] = i
                    news.append((pairs(rank << 32 | symbols[k], -1), i))
                if h >= 0:
                    news.append((pairs(symbols[h] << 32 | rank, -1), h))
                for new, place in news:
                    if new >= 0:
                        if new in index:
                            index[new].append(place)
                        else:
                            index[new] = [place]
                            heapq.heappush(queue, new)
                        if new <= rank:
                            waiting.add(int(np.searchsorted(starts, i, "right")))
        ids = symbols_np[symbols_np >= 0].astype("<u4")
        ends = np.cumsum(np.add.reduceat(symbols_np >= 0, starts, dtype=np.int64)) * 4
        ids, at = ids.tobytes(), 0
        for (piece, _), end in zip(raws, ends.tolist(), strict=True):
            known[piece] = ids[at:end]
            at = end
        return known


def read_ranks(path: str) -> list[bytes | None]:
    """The tokens of a rank file (base64 token, rank) by rank. A vocabulary's size does not depend on the corpus."""
    with open(path, "rb") as lines:
        ranks = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, lines)}
    return [ranks.get(i) for i in range(max(ranks) + 1)]


def _parts(texts: list[str], most: int) -> Iterator[list[str]]:
    """Runs of texts of at most so many code points, or of one text."""
    start, size = 0, 0
    for k, text in enumerate(texts):
        if k > start and size + len(text) > most:
            yield texts[start:k]
            start, size = k, 0
        size += len(text)
    if texts:
        yield texts[start:]


_encoders: dict[int, Replay] = {}


def encode(docs: DataFrame, path: str, pattern: str, spaced: bool = False) -> DataFrame:
    """doc_id, ids (binary: little-endian unsigned 32-bit integers), decoded (binary: the bytes decoded from them). spaced: the pattern
    breaks before every space that stands before anything but white space, and takes a space and letters as one piece."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(read_ranks(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash((path, pattern, spaced))
        if key not in _encoders:
            _encoders[key] = Replay(vocabulary.value, pattern, spaced)
        encoder = _encoders[key]
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            ids = [x for some in _parts(texts, TOGETHER) for x in encoder.encode(some)]
            for at in range(0, batch.num_rows, 1000):
                some = ids[at : at + 1000]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 1000), pa.array(some, pa.binary()), pa.array(map(encoder.decode, some), pa.binary())], names=["doc_id", "ids", "decoded"])

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids binary, decoded binary")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    coded = encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, spaced=True)
    return coded.select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
