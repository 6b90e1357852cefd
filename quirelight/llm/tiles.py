"""Tiles of fingerprints by population count: every two tiles whose counts allow the radius are one unit of work.

Neighbouring population counts share a tile while they fit; a count with more fingerprints than a tile holds is cut by hash. A tile
has TILE fingerprints, or a `share`-th of all if that is more (so that fingerprints are not copied to ever more tiles), and never
more than MOST, so what a task holds is bounded. Beyond MOST times `share` fingerprints, copies grow with the number of tiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shuffle_partitions

TILE = 8192
MOST = 1 << 20


def layout(counts: dict[int, int], radius: int, tile: int) -> tuple[list[int], list[int], list[int], list[int]]:
    """For each population count: its first tile, its number of tiles, and the first and last tile that it must meet."""
    top = max(counts, default=0)
    groups: list[list[int]] = []  # first count, last count, fingerprints
    for ones in range(top + 1):
        n = counts.get(ones, 0)
        if groups and groups[-1][2] + n <= tile:
            groups[-1][1:] = [ones, groups[-1][2] + n]
        else:
            groups.append([ones, ones, n])
    parts = [max(1, -(-n // tile)) for *_, n in groups]
    base = [sum(parts[:k]) for k in range(len(groups))]
    low = [min(base[j] for j, (_, last, _) in enumerate(groups) if last >= first - radius) for first, _, _ in groups]
    high = [max(base[j] + parts[j] - 1 for j, (first, _, _) in enumerate(groups) if first <= last + radius) for _, last, _ in groups]
    of = [next(k for k, (first, last, _) in enumerate(groups) if first <= ones <= last) for ones in range(top + 1)]
    return tuple([x[g] for g in of] for x in (base, parts, low, high))


def pairs_of_tiles(prints: DataFrame, ones: Column, spread: Column, radius: int, tile: int, share: int = 256, most: int = MOST) -> DataFrame:
    """pair, rows: two rows for each pair of tiles (one for a tile with itself), with all of a tile's rows of prints as an array.
    Only the histogram of population counts comes to the driver."""
    spark = prints.sparkSession
    counts = {r["ones"]: r["count"] for r in prints.groupBy(ones.alias("ones")).count().collect()}
    tile = min(most, max(tile, sum(counts.values()) // share))
    base, parts, low, high = (F.array(*map(F.lit, x)) for x in layout(counts, radius, tile))
    number = F.get(base, ones) + F.pmod(spread, F.get(parts, ones))
    row = F.struct(*prints.columns)
    packed = prints.select(number.cast("long").alias("tile"), F.get(low, ones).alias("low"), F.get(high, ones).alias("high"), row.alias("row"))
    packed = packed.groupBy("tile").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.collect_list("row").alias("rows"))
    both = packed.select("tile", "rows", F.explode(F.sequence(F.col("low").cast("long"), F.col("high").cast("long"))).alias("partner"))
    pair = F.struct(F.least("tile", "partner").alias("a"), F.greatest("tile", "partner").alias("b"))
    tasks = max(2 * spark.sparkContext.defaultParallelism, shuffle_partitions(spark))
    return both.select(pair.alias("pair"), "rows").repartition(tasks, "pair")
