"""Near copies by SimHash with verification: all pairs of Jaccard similarity ALIKE or more over five-word shingles that lie in the radius.

A text is the set of its hashed shingles. Each distinct set has a fingerprint of 192 bits (a bit is 1 if it is set in over half of
the set's hashes). Tiles of fingerprints are compared by exclusive-or and bit counts (`tiles`); sets whose sizes rule the
similarity out are skipped too. A bit of two sets of similarity 0.8 differs with probability 0.15 (0.19 for sets of five), so RADIUS
of the 192 misses one of 40,000 such pairs (one of 200 for sets of five; none of equal sets), while of unrelated pairs one in 10^11 is
looked at in vain.

Every pair that decides is verified on the whole sets. A group of n mutual near copies would have n squared pairs, so there are two
rounds. The first takes for each set its K nearest ones from each pair of tiles, verifies these and merges what holds to components. Of
sets that had more than K it also returns a spanning forest of all their pairs, so that the components of these forests (`crowds`) hold all
pairs not looked at yet. A crowd's whole sets then come together, a large crowd's in parts that meet two by two, and every pair of
different components is verified on the spot, nearest ones first; pairs that merged components make needless are left out. So the
components are those of all pairs in the radius; there is no cap, and sets travel with their crowd, not with their tile.

Defined results: texts of fewer than five words are one shingle; null and wordless texts are copies of each other; texts of any
length are read whole; rows without a doc_id take part (they may link others) and always stay; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest, xxh64_intdigest

from . import tiles
from .common import LOWER, materialize
from .components import components

SHINGLE = 5
#: Similarity of a link, as a fraction (4 / 5).
ALIKE = (4, 5)
RADIUS = 50
WORDS = 3
#: Nearest ones that the first round takes.
K = 2
#: Sets, and bytes of them, in a part of a crowd.
PART, PART_BYTES = 1024, 8 << 20
#: Keys (of 8 bytes or so) that are sent to all tasks.
LIGHT = 1 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)
_TURN = np.uint64(0xD6E8FEB86659FD93)


def shingles(text: str | None) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit hashes."""
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < SHINGLE:
        return np.array([xxh64_intdigest(b" ".join(words), len(words))], np.uint64)
    hashes = np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))
    n = len(words) - SHINGLE + 1
    out = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        out = (out ^ hashes[k : k + n]) * _MIX
        out ^= out >> np.uint64(29)
    return np.unique(out)


def fingerprint(found: np.ndarray) -> np.ndarray:
    """WORDS words of 64 bits of a set; a bit is 1 if it is set in over half of the hashes."""
    ones = np.zeros(64 * WORDS, np.int64)
    for at in range(0, len(found), 1 << 14):
        words = [found[at : at + (1 << 14)]]
        for _ in range(WORDS - 1):
            h = (words[-1] ^ (words[-1] >> np.uint64(31))) * _TURN
            words.append(h ^ (h >> np.uint64(32)))
        ones += np.unpackbits(np.stack(words, axis=1).view(np.uint8).reshape(-1, 8 * WORDS), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(found), bitorder="little").view("<i8")


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if not len(b):
        return True
    both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return ALIKE[1] * both >= ALIKE[0] * (len(a) + len(b) - both)


PRINT = [f"f{k}" for k in range(WORDS)]


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, words, sizes = [], [], []
        for text in batch.column(1):
            found = shingles(text.as_py())
            keys.append(xxh3_128_digest(found.tobytes()))
            words.append(fingerprint(found))
            sizes.append(len(found))
        words = np.array(words, np.int64).reshape(-1, WORDS)
        columns = [batch.column(0), pa.array(keys, pa.binary()), *(pa.array(words[:, k]) for k in range(WORDS)), pa.array(sizes, pa.int32())]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "key", *PRINT, "n"])


def _ordered(fields: list[np.ndarray], sets: pa.Array | None = None) -> list:
    """The columns (id, size, component, words...) of some rows ordered by set size, and the sets at the end if there are."""
    order = np.argsort(fields[1], kind="stable")
    out = [f[order] for f in fields[:3]] + [f[order].view(np.uint64) for f in fields[3:]]
    return out if sets is None else [*out, [np.frombuffer(sets[k].as_buffer(), np.uint64) for k in order.tolist()]]


def _hits(a: list, b: list | None, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, distance) of the pairs of rows of a with rows of b, or (None) with other rows of a, of another component, within the radius and
    of sizes that allow the similarity; all pairs of some rows i at once."""
    within = b is None
    b = a if within else b
    size, group, other_size, other_group = a[1], a[2], b[1], b[2]
    least, most = -(-ALIKE[0] * size // ALIKE[1]), ALIKE[1] * size // ALIKE[0]
    first, last = np.searchsorted(other_size, least), np.searchsorted(other_size, most, "right")
    at = 0
    while at < len(size):
        step = max(1, min(256, (1 << 18) // max(1, int(last[at] - first[at]))))
        end = min(len(size), at + step)
        lo, hi = int(first[at]), int(last[end - 1])
        differ = np.zeros((end - at, hi - lo), np.uint8)
        for f, g in zip(a[3 : 3 + WORDS], b[3 : 3 + WORDS], strict=True):
            differ += np.bitwise_count(f[at:end, None] ^ g[None, lo:hi])
        found = np.flatnonzero(differ <= radius)
        if len(found):
            i, j = found // (hi - lo) + at, found % (hi - lo) + lo
            good = (group[i] != other_group[j]) & (j >= first[i]) & (j < last[i])
            if within:
                good &= i != j
            if good.any():
                yield i[good], j[good], differ.reshape(-1)[found[good]]
        at = end


class _Groups:
    """Disjoint sets of numbers."""

    def __init__(self):
        self.top: dict[int, int] = {}

    def find(self, x: int) -> int:
        top = self.top
        while (y := top.get(x, x)) != x:
            top[x] = top.get(y, y)
            x = y
        return x

    def join(self, x: int, y: int) -> bool:
        p, q = self.find(x), self.find(y)
        if p != q:
            self.top[max(p, q)] = min(p, q)
        return p != q


def nearest(a: list, b: list | None, radius: int, k: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """The pairs (id, id) of each row of a with its k nearest rows of b, or (None) of a (see _hits); and a spanning forest of all pairs of the
    rows that have more."""
    ids, jds = a[0], (a if b is None else b)[0]
    out = [np.empty((0, 2), np.int64)]
    crowd, forest = _Groups(), []
    for i, j, d in _hits(a, b, radius):
        order = np.argsort(i * 256 + d, kind="stable")
        i, j = i[order], j[order]
        start = np.flatnonzero(np.diff(i, prepend=-1))
        place = np.arange(len(i)) - np.repeat(start, np.diff(np.append(start, len(i))))
        take = place < k
        out.append(np.stack([ids[i[take]], jds[j[take]]], axis=1))
        if not take.all():
            more = np.isin(i, i[~take])
            forest += [x for x in zip(ids[i[more]].tolist(), jds[j[more]].tolist(), strict=True) if crowd.join(*x)]
    return np.unique(np.sort(np.concatenate(out), axis=1), axis=0), forest


def joined(a: list, b: list | None, radius: int) -> list[tuple[int, int]]:
    """Links (id, id) of sets of similarity ALIKE or more that merge all components which such pairs of rows of a and b (see _hits) merge."""
    other = a if b is None else b
    groups, links = _Groups(), []
    for i, j, d in _hits(a, b, radius):
        order = np.argsort(d, kind="stable")
        i, j = i[order], j[order]
        for x, y, g, h in zip(i.tolist(), j.tolist(), a[2][i].tolist(), other[2][j].tolist(), strict=True):
            if b is None and x > y:
                continue
            if groups.find(g) != groups.find(h) and alike(a[-1][x], other[-1][y]):
                groups.join(g, h)
                links.append((int(a[0][x]), int(other[0][y])))
    return links


def _compare(radius: int, k: int):
    def pair(table):
        sides = [_ordered([row.values.field(c).to_numpy(zero_copy_only=False) for c in range(3 + WORDS)]) for row in table.column("rows").combine_chunks()]
        found, forest = nearest(sides[0], sides[1] if len(sides) > 1 else None, radius, k)
        forest = np.array(forest, np.int64).reshape(-1, 2)
        return pa.table({"a": np.concatenate([found[:, 0], forest[:, 0]]), "b": np.concatenate([found[:, 1], forest[:, 1]]), "crowd": np.arange(len(found) + len(forest)) >= len(found)})

    return pair


def _join(radius: int):
    def pair(key, table):
        part, sides = table.column("part").to_numpy(), []
        for p in sorted({key[1].as_py(), key[2].as_py()}):
            own = table.filter(pa.array(part == p)).combine_chunks()
            if own.num_rows:
                fields = [own.column(c).to_numpy() for c in ("id", "n", "component", *PRINT)]
                sides.append(_ordered(fields, own.column("found").combine_chunks()))
        if not sides or len(sides) < 2 and key[1] != key[2]:
            return pa.table({"a": np.empty(0, np.int64), "b": np.empty(0, np.int64)})
        found = np.array(joined(sides[0], sides[1] if len(sides) > 1 else None, radius), np.int64).reshape(-1, 2)
        return pa.table({"a": found[:, 0], "b": found[:, 1]})

    return pair


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [shingles(t.as_py()).tobytes() for t in batch.column(0)]
        yield pa.RecordBatch.from_arrays([pa.array(map(xxh3_128_digest, found), pa.binary()), pa.array(found, pa.binary())], names=["key", "found"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yes = pa.array([alike(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)) for x, y in zip(batch.column(2), batch.column(3), strict=True)], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(yes), batch.column(1).filter(yes)], names=["a", "b"])


def _light(keys: DataFrame) -> DataFrame:
    """keys, sent to all tasks if there are no more than LIGHT of them, so that the texts they meet need no shuffle."""
    return F.broadcast(keys) if keys.count() <= LIGHT else keys


def near_copies(docs: DataFrame, radius: int = RADIUS, tile: int = tiles.TILE) -> DataFrame:
    """id, first, component: every distinct set of shingles with its smallest doc_id (null if it has none) and its component (an id)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    text = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    prints = text.mapInArrow(_prints, f"doc_id {kind}, key binary, {', '.join(f'{c} long' for c in PRINT)}, n int")
    classes = prints.groupBy("key").agg(*[F.first(c).alias(c) for c in (*PRINT, "n")], F.min("doc_id").alias("first"))
    classes = materialize(classes.withColumn("id", F.monotonically_increasing_id()), "sets")
    ones = reduce(add, [F.bit_count(c) for c in PRINT])

    def sets_of(ids: DataFrame) -> DataFrame:
        """id, found: the sets of some ids, made again from the texts of their first documents."""
        wanted = materialize(ids.join(classes.select("id", "key", "first"), "id"), "wanted")
        texts = text.join(_light(wanted.select("first").distinct()), F.col("doc_id").eqNullSafe(F.col("first")), "left_semi").select("text")
        found = texts.mapInArrow(_sets, "key binary, found binary").join(wanted.select("id", "key"), "key")
        return materialize(found.groupBy("id").agg(F.first("found").alias("found")), "shingles")

    # sets of up to three shingles are alike only if they are equal
    rows = classes.filter(F.col("n") >= ALIKE[0]).select("id", "n", F.col("id").alias("component"), *PRINT)
    work = tiles.pairs_of_tiles(rows, ones, F.xxhash64("id"), radius, tile, share=64)
    found = materialize(work.groupBy("pair").applyInArrow(_compare(radius, K), "a long, b long, crowd boolean"), "found")
    pairs = materialize(found.filter("not crowd").select("a", "b").distinct(), "pairs")
    sets = sets_of(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct())
    a, b = (sets.select(F.col("id").alias(x), F.col("found").alias(f"found_{x}")) for x in "ab")
    held = pairs.join(a, "a").join(b, "b").select("a", "b", "found_a", "found_b").mapInArrow(_verify, "a long, b long")
    links = materialize(held, "links")
    group = components(links)

    forest = found.filter("crowd").select("a", "b")
    if not forest.isEmpty():
        crowds = materialize(components(forest).select(F.col("node").alias("id"), F.col("component").alias("crowd")), "crowds")
        size = crowds.join(classes.select("id", "n"), "id").groupBy("crowd").agg(F.greatest(F.ceil(F.count(F.lit(1)) / PART), F.ceil(8 * F.sum("n") / PART_BYTES)).cast("int").alias("parts"))
        rest = crowds.join(size, "crowd").join(classes.select("id", "n", *PRINT), "id").join(group, F.col("id") == F.col("node"), "left")
        rest = rest.select("id", "n", F.coalesce("component", "id").alias("component"), *PRINT, "crowd", F.pmod(F.xxhash64("id"), "parts").cast("int").alias("part"), "parts").join(sets_of(crowds.select("id")), "id")
        met = rest.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
        met = met.withColumns({"low": F.least("part", "other"), "high": F.greatest("part", "other")}).drop("parts", "other")
        more = materialize(met.groupBy("crowd", "low", "high").applyInArrow(_join(radius), "a long, b long"), "links")
        group = components(links.union(more))
    labels = classes.join(group, F.col("id") == F.col("node"), "left")
    return labels.select("id", "first", F.coalesce("component", "id").alias("component"))


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """docs without all but the first document (smallest doc_id) of each group of near copies. Rows that repeat a doc_id go or stay
    together; rows without a doc_id stay, since no decision can name them."""
    first = near_copies(docs, **options).groupBy("component").agg(F.min("first").alias("doc_id")).select("doc_id").filter("doc_id is not null").distinct()
    gone = materialize(docs.select("doc_id").filter("doc_id is not null").distinct().join(first, "doc_id", "left_anti"), "gone")
    return docs.join(_light(gone), "doc_id", "left_anti").select(*docs.columns)
