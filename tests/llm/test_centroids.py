"""Centroid clustering against a plain loop over all centroids."""

import hashlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quirelight.llm import centroids

SCHEMA = "vec_id long, embedding array<float>, label int, v string, cluster int, h string"


def slow(rows, k=40, rounds=5):
    """rows: (vec_id, list of ints) -> rows of the query."""
    order = sorted(rows, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    points = [list(v) for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, p, strict=True)), c) for c, p in enumerate(points))
    for _ in range(rounds):
        mine = [near(v)[1] for _, v in rows]
        for c in range(len(points)):
            own = [v for (_, v), m in zip(rows, mine, strict=True) if m == c]
            if own:
                points[c] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    found = [near(v) for _, v in rows]
    sums = {c: sum(d for d, m in found if m == c) for c in range(len(points))}
    sha = [hashlib.sha256(",".join(map(str, p)).encode()).hexdigest() for p in points]
    return sorted(((i, c, d, sums[c], sum(sums.values()), sha[c]) for (i, _), (d, c) in zip(rows, found, strict=True)), key=str)


def write(spark, rows, at):
    spark.createDataFrame([(i, x, 1, "v", 9, "h") for i, x in rows], SCHEMA).write.parquet(f"{at}/embeddings.parquet")
    return sorted(map(tuple, centroids.op11_centroids(spark, str(at)).collect()), key=str)


def kept(rows):
    good = [(i, x) for i, x in rows if x is not None and len(x) == 64 and all(c is not None and np.isfinite(c) for c in x)]
    return [(i, [int(np.floor(256 * float(np.float32(c)))) for c in x]) for i, x in good]


def test_odd_rows(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(0, 0.2, 64).tolist()) for i in range(60)]
    rows += [rows[3], rows[3], (3, [0.0] * 64), (None, rows[5][1]), (None, None), (70, None), (71, []), (72, [0.1] * 63), (73, [0.1] * 65)]
    rows += [(74, [float("nan")] + [0.0] * 63), (75, [float("inf")] + [0.0] * 63), (76, [None] + [0.0] * 63)]
    # ties: many on a coarse grid, and whole copies
    rows += [(100 + i, [round(x) / 4 for x in rng.normal(0, 1, 64)][:2] * 32) for i in range(60)] + [(200 + i, [0.25] * 64) for i in range(40)]
    assert write(spark, rows, tmp_path) == slow(kept(rows))


def test_few_vectors_and_none(spark, tmp_path):
    rows = [(i, [i / 8] * 64) for i in range(5)]
    assert write(spark, rows, tmp_path / "few") == slow(kept(rows))
    assert write(spark, [(1, None)], tmp_path / "none") == []


def test_too_large_a_component_ends_the_job(spark, tmp_path):
    with pytest.raises(Exception, match="too large"):
        write(spark, [(1, [1e9] * 64)], tmp_path)


@pytest.mark.parametrize("seed", range(4))
def test_tree_is_exact(seed):
    rng = np.random.default_rng(seed)
    points = rng.integers(-3, 4, (rng.integers(1, 60), 5)) * (1 if seed < 2 else 10**6)
    vectors = rng.integers(-4, 5, (500, 5)) * (1 if seed < 2 else 10**6)
    row, far = centroids.Tree(points).nearest(vectors)
    apart = ((vectors[:, None, :] - points[None, :, :]) ** 2).sum(2)
    assert (far == apart.min(1)).all() and (row == apart.argmin(1)).all()  # argmin takes the first of equals


def test_query_equals_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    df = centroids.op11_centroids(spark, sf)
    got = sorted(map(tuple, df.collect()))
    result = con.execute(centroids.OP11_SQL)
    assert [c[0] for c in result.description] == df.columns
    assert got == sorted(result.fetchall()) and df.select(F.count_distinct("cluster")).first()[0] > 10
