"""SimHash near-duplicates by tiled exact comparison.

Fingerprints come from 4-word shingles (see `fingerprint`). Equal fingerprints are one class. The distinct fingerprints are cut
into tiles by population count (`tiles`), and every pair of tiles whose population counts differ by no more than the radius is one
unit of work: numpy exclusive-or and bit counts over blocks of it. Inside a pair, rows are ordered by the population count of their
upper half and blocks whose halves' counts already differ beyond the radius are skipped. All pairs within the radius are
therefore found; none is probed by chance.

A unit of work returns a spanning forest of its links, so a group of n mutual near copies gives about n rows, not n squared, and
the components are the same. Only the histogram of population counts (65 rows) comes to the driver.

The number of comparisons grows with the square of the distinct fingerprints; what a task holds is bounded (`tiles.MOST`).

`keep_first`, the pipeline's form, takes five-word shingles and a similarity of 0.8 or more instead: fingerprints of 128 bits, a
radius that holds such pairs, and an exact check of each deciding pair (`near`).

Defined results: null and wordless texts have fingerprint zero and are linked like any other; texts of any length are read whole;
repeated rows (of a doc_id too) get the same component; rows without a doc_id take part, and component_id is null where no row of a
component has one; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from . import near, tiles
from .common import LOWER, materialize
from .components import components

SHINGLE = 4
RADIUS = 4
SEED = 42


def fingerprint(text: str) -> int:
    """64 bits; a bit is 1 if it is set in over half of the shingles' hashes."""
    words = text.encode().translate(LOWER).split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        return xxh64_intdigest(b" ".join(words), SEED)
    n = len(words) - SHINGLE + 1
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        some = words[at : at + (1 << 16) + SHINGLE - 1]
        shingles = map(b" ".join, zip(*(some[k:] for k in range(SHINGLE)), strict=False))
        hashes = np.fromiter(map(xxh64_intdigest, shingles, repeat(SEED)), np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t or "") for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


def _upper(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x >> np.uint64(32))


def forest(a: np.ndarray, b: np.ndarray | None, radius: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of the pairs within radius: between a and b, or inside a if b is None."""
    within = b is None
    a = a[np.argsort(_upper(a), kind="stable")]
    b = a if within else b[np.argsort(_upper(b), kind="stable")]
    ua, ub = _upper(a).astype(np.int64), _upper(b).astype(np.int64)
    ones, others = np.bitwise_count(a).astype(np.int64), np.bitwise_count(b).astype(np.int64)
    least, most = max(-radius, int(others.min() - ones.max())), min(radius, int(others.max() - ones.min()))
    shift = 0 if within else len(a)
    group = np.arange(len(a) + (0 if within else len(b)))
    links = []
    for upper in np.unique(ua).tolist():
        rows = np.flatnonzero(ua == upper)
        lo, hi = -((radius - least) // 2), (most + radius) // 2
        first, last = np.searchsorted(ub, [upper + lo, upper + hi + 1])
        columns = b[first:last]
        if not len(columns):
            continue
        step = max(1, (1 << 18) // len(columns))
        for at in range(int(rows[0]), int(rows[-1]) + 1, step):
            block = a[at : min(at + step, int(rows[-1]) + 1)]
            near = np.flatnonzero(np.bitwise_count(block[:, None] ^ columns[None, :]) <= radius)
            if not len(near):
                continue
            i, j = near // len(columns) + at, near % len(columns) + int(first) + shift
            apart = group[i] != group[j]
            i, j = i[apart], j[apart]
            if not len(i):
                continue
            _, once = np.unique(group[i] * len(group) + group[j], return_index=True)
            root: dict[int, int] = {}

            def find(x: int, root=root) -> int:
                top = x
                while top in root:
                    top = root[top]
                while x != top:
                    root[x], x = top, root[x]
                return top

            for x, y in zip(i[once].tolist(), j[once].tolist(), strict=True):
                p, q = find(int(group[x])), find(int(group[y]))
                if p != q:
                    root[max(p, q)] = min(p, q)
                    links.append((int(a[x]), int(b[y - shift])))
            table = np.arange(len(group))
            for x in list(root):
                table[x] = find(x)
            group = table[group]
    return links


def _compare(radius: int):
    def pair(table):
        sides = [row.values.field(0).to_numpy().view(np.uint64) for row in table.column("rows").combine_chunks()]
        found = forest(sides[0], sides[1] if len(sides) > 1 else None, radius)
        both = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.table({"a": both[:, 0], "b": both[:, 1]})

    return pair


def links(prints: DataFrame, radius: int = RADIUS, tile: int = tiles.TILE) -> DataFrame:
    """Links (a, b) between distinct fingerprints within radius that connect all of them that are connected. prints: column fp, distinct."""
    work = tiles.pairs_of_tiles(prints, F.bit_count("fp"), F.xxhash64("fp"), radius, tile)
    return work.groupBy("pair").applyInArrow(_compare(radius), "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, tile: int = tiles.TILE) -> DataFrame:
    """doc_id, fp, component_id: the smallest doc_id among all documents linked to this one, directly or not."""
    prints = materialize(fingerprints(docs), "fingerprints")
    classes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    group = components(links(classes.select("fp"), radius, tile))
    labels = classes.join(group, classes["fp"] == group["node"], "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    firsts = labels.groupBy("component").agg(F.min("first").alias("component_id"))
    return prints.join(labels.join(firsts, "component").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """docs without all but the first document of each group of near copies (`near.keep_first`)."""
    return near.keep_first(docs, **options)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
