r"""Centroid clustering of integer vectors, with a vantage-point tree over the centroids.

Each round builds a tree over the k centroids on the driver and broadcasts it (k vectors: a parameter, not data). Every vector goes down
the tree best bound first: a node's bound is what the triangle inequality leaves as its least distance; a branch is dropped only where
its bound lies beyond the best distance so far, so one at the same distance is still looked at. A batch's vectors take their steps
together, each from its own queue. Bounds are floating point and shrunk by more than their rounding; distances, at vantage points and in
leaves, are exact integers, and of equally near centroids the smaller number wins. Sums are kept in each task and added up by Spark, so
copies of one vector and large clusters don't meet in one task; a round gives the driver k * (dims + 1) numbers.

Defined results: vectors of another length, or with null, NaN or infinite components, are left out, null vectors too. A component whose
scaled value lies beyond 2^27 ends the job with an error, since distances would no longer fit 64 bits. Repeated rows are vectors of their
own; as first centroids they are ordered by id hash, then components; a null id hashes as no digits. Fewer vectors than k give fewer
centroids, an empty table an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize

K, ROUNDS, DIMS, SCALE = 40, 5, 64, 256
#: Centroids in a leaf.
LEAF = 4
#: Largest component: 64 squares of a difference of two such still fit 64 bits.
LARGEST = 2**27
#: Bounds give way by this share of the distances that made them.
SLACK = 1e-12
#: Vectors that go down the tree together.
TOGETHER = 4096


class Tree:
    """Vantage-point tree over the rows of an integer matrix. A node is (vantage, [(child, least, most), ...]) or (None, rows)."""

    def __init__(self, points: np.ndarray):
        self.points = points.astype(np.int64)
        self.nodes: list[tuple] = []
        self._build(list(range(len(points))))

    def _build(self, rows: list[int]) -> int:
        at = len(self.nodes)
        if len(rows) <= LEAF:
            self.nodes.append((None, rows))
            return at
        self.nodes.append(())
        vantage, rest = rows[0], rows[1:]
        far = squares(self.points[rest], self.points[vantage])
        order = np.argsort(far, kind="stable")
        children = []
        for half in (order[: len(order) // 2], order[len(order) // 2 :]):
            roots = np.sqrt(far[half].astype(float))
            children.append((self._build([rest[i] for i in half]), roots.min(), roots.max()))
        self.nodes[at] = (vantage, children)
        return at

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each vector the nearest point's row (the smallest of equals) and the exact squared distance."""
        parts = [self._nearest(vectors[at : at + TOGETHER].astype(np.int64)) for at in range(0, len(vectors), TOGETHER)]
        return (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in (0, 1))

    def _nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(vectors)
        queue = np.full((n, len(self.nodes)), np.inf)
        queue[:, 0] = 0
        row, best = np.full(n, len(self.points)), np.full(n, np.iinfo(np.int64).max)

        def look(who: np.ndarray, point: int) -> np.ndarray:
            found = squares(vectors[who], self.points[point])
            better = (found < best[who]) | ((found == best[who]) & (point < row[who]))
            row[who[better]], best[who[better]] = point, found[better]
            return np.sqrt(found.astype(float))

        active = np.arange(n)
        while len(active):
            node = queue[active].argmin(1)
            bound = queue[active, node]
            # inclusive: a branch at exactly the best distance may hold a smaller number
            open_ = np.isfinite(bound) & (bound <= np.sqrt(best[active].astype(float)) * (1 + SLACK))
            active, node = active[open_], node[open_]
            for at in np.unique(node).tolist():
                who = active[node == at]
                bound = queue[who, at]
                queue[who, at] = np.inf
                vantage, below = self.nodes[at]
                if vantage is None:
                    for point in below:
                        look(who, point)
                    continue
                far = look(who, vantage)
                for child, least, most in below:
                    gap = np.maximum(far - most, least - far) - SLACK * (far + most)
                    queue[who, child] = np.maximum(np.maximum(gap, bound), 0)
        return row, best


def squares(vectors: np.ndarray, point: np.ndarray) -> np.ndarray:
    apart = vectors - point
    return np.einsum("ij,ij->i", apart, apart)


def integers(vectors: DataFrame, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """vec_id, v: the components of every whole vector as floor(scale * x)."""
    x = F.col("embedding").cast("array<double>")
    whole = F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    low = lambda c: F.when(F.abs(c * scale) <= LARGEST, F.floor(c * scale).cast("int")).otherwise(F.raise_error(F.lit("a component is too large")))
    kept = vectors.filter(F.coalesce((F.size("embedding") == dims) & whole, F.lit(False)))
    return kept.select("vec_id", F.transform(x, low).alias("v"))


def _matrix(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    return batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _first(kept: DataFrame, k: int) -> np.ndarray:
    digest = F.sha2(F.concat(F.lit("2:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return np.array([r["v"] for r in kept.select(digest.alias("h"), "v").orderBy("h", "v").limit(k).collect()], np.int64)


def _moved(kept: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: floor of the mean of their vectors, exact; those without vectors stay."""
    k, dims = centroids.shape
    tree = kept.sparkSession.sparkContext.broadcast(Tree(centroids))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, dims + 1), np.int64)  # the last column counts
        for batch in batches:
            vectors = _matrix(batch, dims)
            row, _ = tree.value.nearest(vectors)
            np.add.at(total, row, np.column_stack([vectors, np.ones(len(vectors), np.int64)]))
        row, dim = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(row, pa.int32()), pa.array(dim, pa.int32()), pa.array(total[row, dim])], names=["cluster", "dim", "total"])

    parts = kept.select("v").mapInArrow(sums, "cluster int, dim int, total long")
    found = {(r[0], r[1]): int(r[2]) for r in parts.groupBy("cluster", "dim").agg(F.sum(F.col("total").cast("decimal(38,0)"))).collect()}
    tree.unpersist()
    counts = [found.get((c, dims), 0) for c in range(k)]
    return np.array([[found.get((c, d), 0) // n for d in range(dims)] if (n := counts[c]) else centroids[c] for c in range(k)], np.int64)


def clusters(kept: DataFrame, k: int = K, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """vec_id, cluster, distance (squared) for the integer vectors (vec_id, v) after the given rounds, and the final centroids."""
    kept = materialize(kept, "vectors")
    centroids = _first(kept, k)
    kind = kept.schema["vec_id"].dataType.simpleString()
    if not len(centroids):
        return kept.selectExpr("vec_id", "0 AS cluster", "0L AS distance"), centroids
    for _ in range(rounds):
        centroids = _moved(kept, centroids)
    tree, dims = kept.sparkSession.sparkContext.broadcast(Tree(centroids)), centroids.shape[1]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, far = tree.value.nearest(_matrix(batch, dims))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(row, pa.int32()), pa.array(far, pa.int64())], names=["vec_id", "cluster", "distance"])

    return materialize(kept.mapInArrow(assign, f"vec_id {kind}, cluster int, distance long"), "clusters"), centroids


def digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centroids = clusters(integers(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))
    sums = {r[0]: int(r[1]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect()}  # k numbers
    rows = [(c, sums.get(c, 0), sum(sums.values()), digest(x)) for c, x in enumerate(centroids)]
    totals = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # k rows, whatever the input
    return found.join(F.broadcast(totals), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql() -> str:
    far = "list_sum(list_transform(list_zip(a.v, c.v), lambda z: ((z[1] - z[2]) * (z[1] - z[2]))::HUGEINT))"
    steps = [
        f"""kept AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
            WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMS})""",
        f"""c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY h, v) - 1)::INT AS c, v
            FROM (SELECT v, sha256('2:' || coalesce(vec_id::VARCHAR, '')) AS h FROM kept) QUALIFY row_number() OVER (ORDER BY h, v) <= {K})""",
    ]
    near = lambda r: f"""(SELECT vec_id, v, best.c AS c, best.d AS d FROM (SELECT a.vec_id, a.v, min({{'d': {far}, 'c': c.c}}) AS best
            FROM (SELECT row_number() OVER () AS i, * FROM kept) a, c{r} c GROUP BY a.i, a.vec_id, a.v))"""  # noqa: E731
    for r in range(ROUNDS):
        steps.append(f"""m{r} AS MATERIALIZED (SELECT c, j, sum(x) AS s, count(*) AS n
            FROM (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS j FROM {near(r)}) GROUP BY c, j)""")
        steps.append(f"""c{r + 1} AS MATERIALIZED (SELECT o.c, coalesce(w.v, o.v) AS v FROM c{r} o LEFT JOIN
            (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY j) AS v FROM m{r} GROUP BY c) w ON w.c = o.c)""")
    steps.append(f"found AS MATERIALIZED {near(ROUNDS)}")
    return f"""WITH {", ".join(steps)} SELECT f.vec_id, f.c AS cluster, f.d::BIGINT AS distance, (sum(f.d) OVER (PARTITION BY f.c))::BIGINT AS cluster_inertia,
        (sum(f.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(e.v, ',')) AS centroid_sha256 FROM found f JOIN c{ROUNDS} e ON e.c = f.c"""


OP11_SQL = _sql()
