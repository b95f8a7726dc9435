"""Centroid clustering of integer vectors, with a vantage-point tree over the centroids.

Each round the driver builds the tree from at most CENTROIDS centroids of DIMS integers and broadcasts it. A vector
goes through it best first: of the nodes that it has still to visit, the one whose least possible distance is
smallest comes next, and it stops once that is beyond the best distance found. A node at exactly that distance is
still visited, as a centroid of a smaller number may wait there. Bounds are in doubles with a slack; the distances
that decide, those of vantage points and of leaves, are exact integers. A whole batch of vectors walks the tree at once.

A task adds up its vectors before anything is shuffled, one row for each centroid, so a centroid that holds a
third of all vectors is as cheap as any other; the driver sees the sums of a round, CENTROIDS rows a dimension.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize
from .topk import integer_vectors

DIMS, SCALE, CENTROIDS, ROUNDS, LEAF = 64, 64, 16, 3, 3
#: Components are below this in size, so that squared distances fit into 64 bits.
LARGEST = 1 << 27
_SLACK = 1e-9


class Tree:
    """A vantage-point tree over integer centroids; leaves hold LEAF at most, or equal ones."""

    def __init__(self, centroids: np.ndarray, leaf: int = LEAF):
        self.centroids = np.asarray(centroids, np.int64)
        self.leaf = leaf
        #: Of each node: its centroids, or the vantage point with (child, least, greatest distance) of two children.
        self.nodes: list[tuple] = []
        if len(self.centroids):
            self._build(np.arange(len(self.centroids)))

    def _build(self, own: np.ndarray) -> int:
        at = len(self.nodes)
        self.nodes.append(("leaf", own))
        if len(own) <= self.leaf:
            return at
        spread = ((self.centroids[own][:, None] - self.centroids[own][None]) ** 2).sum(axis=2)
        vantage = int(spread.sum(axis=1).argmax())  # one at the rim tells the others apart best
        rest = np.delete(np.arange(len(own)), vantage)
        far = np.sqrt(spread[vantage, rest].astype(np.float64))
        rest, far = rest[order := np.argsort(far, kind="stable")], far[order]
        half = len(rest) // 2
        children = [(self._build(own[rest[part]]), float(far[part][0]), float(far[part][-1])) for part in (slice(half), slice(half, None))]
        self.nodes[at] = ("vantage", own[vantage : vantage + 1], children)
        return at

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of each vector's nearest centroid, the smaller one of a tie, and its squared distance."""
        n = len(vectors)
        best, number = np.full(n, np.iinfo(np.int64).max), np.full(n, len(self.centroids))
        waits = np.full((n, len(self.nodes)), np.inf)
        waits[:, 0] = 0.0
        going = np.arange(n)
        while len(going):
            node = waits[going].argmin(axis=1)
            least = waits[going, node]
            within = least <= np.sqrt(best[going].astype(np.float64)) * (1 + _SLACK) + _SLACK  # inclusive
            going, node, least = going[within], node[within], least[within]
            waits[going, node] = np.inf
            for which in np.unique(node):
                rows, low = going[node == which], least[node == which]
                kind, own, *children = self.nodes[which]
                found = np.stack([((vectors[rows] - self.centroids[c]) ** 2).sum(axis=1) for c in own], axis=1)
                for c, d in zip(own, found.T):
                    closer = (d < best[rows]) | (d == best[rows]) & (c < number[rows])
                    best[rows[closer]], number[rows[closer]] = d[closer], c
                if kind == "vantage":
                    d = np.sqrt(found[:, 0].astype(np.float64))
                    for child, nearest, farthest in children[0]:
                        bound = np.maximum(np.maximum(nearest - d, d - farthest) - _SLACK * (d + farthest), low)
                        waits[rows, child] = bound
        return number, best


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.asarray(batch.column("v").flatten()).astype(np.int64).reshape(batch.num_rows, -1)


def assign(kept: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """vec_id, cluster, distance of each vector (vec_id, v)."""
    tree = kept.sparkSession.sparkContext.broadcast(Tree(np.array(centroids)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                number, distance = tree.value.nearest(_matrix(batch))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(number, pa.int32()), pa.array(distance, pa.int64())], ["vec_id", "cluster", "distance"])

    return kept.select("vec_id", "v").mapInArrow(run, "vec_id long, cluster int, distance long")


def _sums(kept: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """cluster, n, sums of what each task holds."""
    tree = kept.sparkSession.sparkContext.broadcast(Tree(np.array(centroids)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, dims = tree.value.centroids.shape
        n, sums = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in batches:
            if batch.num_rows:
                m = _matrix(batch)
                number, _ = tree.value.nearest(m)
                n += np.bincount(number, minlength=k)
                for c in np.unique(number):
                    sums[c] += m[number == c].sum(axis=0)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(n[some]), pa.array(list(sums[some]), pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    return kept.select("v").mapInArrow(run, "cluster int, n long, sums array<long>")


def _moved(kept: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """The exact floor of each centroid's mean; one without vectors stays."""
    each = _sums(kept, centroids).select("cluster", "n", F.posexplode("sums").alias("place", "s"))
    total = each.groupBy("cluster", "place").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    moved = [list(c) for c in centroids]
    for r in total.collect():  # a row for each centroid and dimension
        moved[r.cluster][r.place] = int(r.s) // int(r.n)
    return moved


def cluster(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: str = "1:") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of each vector (vec_id, embedding).

    Vectors of another number of components, null ones and those with null or non-finite components are left out, and so
    are rows without a vec_id. Rows that repeat are vectors of their own. Fewer than k vectors make fewer centroids, no
    vectors no rows. The first centroids are the k vectors with the least sha256 of the seed and the vec_id; of rows of one vec_id the
    lesser vector comes first. A component that is LARGEST or more after scaling is an error, as distances would not fit
    into 64 bits. Other columns are not looked at.
    """
    spark = vectors.sparkSession
    whole = integer_vectors(vectors.where(F.size("embedding") == dims), scale=scale)
    small = F.transform("v", lambda c: F.when(F.abs(c) < LARGEST, c.cast("int")).otherwise(F.raise_error(F.lit("a component is too large")).cast("int")))
    kept = materialize(whole.select("vec_id", small.alias("v")))
    first = kept.orderBy(F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")), 256), "vec_id", "v").limit(k)
    centroids = [list(r.v) for r in first.collect()]
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not centroids:
        discard(kept)
        return spark.createDataFrame([], schema)
    for _ in range(rounds):
        centroids = _moved(kept, centroids)
    found = materialize(assign(kept, centroids))
    discard(kept)
    inertia = [0] * len(centroids)
    for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect():
        inertia[r.cluster] = int(r.s)
    told = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    at = F.col("cluster") + 1
    return found.select(
        "vec_id", "cluster", "distance", F.element_at(F.array(*[F.lit(x).cast("long") for x in inertia]), at).alias("cluster_inertia"),
        F.lit(sum(inertia)).cast("long").alias("inertia"), F.element_at(F.array(*map(F.lit, told)), at).alias("centroid_sha256"))


def _oracle() -> str:
    sql = f"""
WITH v AS (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS c, v AS m FROM v ORDER BY sha256('1:' || vec_id), v LIMIT {CENTROIDS})"""
    for i in range(ROUNDS + 1):
        sql += f"""
, a{i} AS (
  SELECT row, vec_id, v, c, d FROM (SELECT *, row_number() OVER (PARTITION BY row ORDER BY d, c) AS place FROM (
    SELECT v.*, c, list_sum(list_transform(list_zip(v.v, m), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM v JOIN c{i} ON true)) WHERE place = 1
)"""
        if i < ROUNDS:
            sql += f"""
, m{i} AS (
  SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS m FROM (
    SELECT c, i, sum(x) AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, unnest(range({DIMS})) AS i FROM a{i}) GROUP BY c, i) GROUP BY c
), c{i + 1} AS (SELECT c, coalesce(m{i}.m, c{i}.m) AS m FROM c{i} LEFT JOIN m{i} USING (c))"""
    return sql + f"""
SELECT vec_id, c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(m, ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN c{ROUNDS} USING (c)
"""


ORACLE = _oracle()
