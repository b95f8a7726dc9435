"""Exact top-k search by inner product over norm-bucketed vectors.

Vectors are ordered by length and packed into buckets of at most BUCKET rows, so a bucket spans a narrow
range of lengths. A query with a k-th best score s so far needs from a bucket with greatest length m a
cosine of at least s / (|q| m), its local threshold. Above 1 the whole bucket is skipped; close to 1 the
query looks only at vectors whose coordinate on the query's largest axis lies in the feasible interval;
otherwise only vectors shorter than s / |q| are skipped. What is left is verified by exact products.

The work is a grid: slots of about QUERIES queries meet lanes of LANE buckets that are neighbours in the order
of length. Before anything is copied, every query is scored against the bucket of the longest vectors, which
gives it a first threshold and a reach, the length that a vector needs to matter to it. Queries are put into slots in the order of
their reach, so one that needs short vectors opens their lanes for its own slot alone, and a slot meets only the lanes whose
longest vector comes up to its least reach. A cell holds one slot and one lane whatever the table's size, keeps k rows for each of its
queries, and the k best of those over all lanes are the answer.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, shuffle_partitions

BUCKET, LANE, QUERIES = 1024, 16, 1024
#: Local cosine thresholds from here on use coordinate pruning.
COORDINATE_FROM = 0.9
#: Products are exact in doubles below the first bound and in 64-bit integers below the second; beyond it Python's
#: own integers are used.
EXACT, WIDE = float(1 << 53), float(1 << 62)
#: The score of no candidate.
NONE = np.iinfo(np.int64).min


def integer_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 256) -> DataFrame:
    """vec_id and v, array<long> of floor(scale * x). Rows whose vector is null or holds null or non-finite
    components are left out; rows that repeat stay. A component that is 2^62 or more after scaling is an error, as
    no column can hold it exactly."""
    x = F.col("_x")
    whole = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return (
        vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("_x"))
        .where(F.coalesce(whole, F.lit(False)) & F.col("vec_id").isNotNull())
        .select("vec_id", F.transform(x, lambda c: F.when(F.abs(c * scale) < WIDE, F.floor(c * scale)).otherwise(F.raise_error(F.lit("a component is too large")))).alias("v"))
    )


PACKED = "ids binary, width int, vectors binary, longest double, part int, place int"


ASKED = "ids binary, width int, vectors binary, known binary, floor double, part int, place int"


def _pack(size: int, asked: bool = False):
    """Rows in their order to PACKED blocks of at most `size`: ids, vectors as bytes, the greatest length, and the
    block's place in its partition. Asked: to ASKED blocks, with each query's known score and their least reach."""

    def block(ids: list[int], rows: list[np.ndarray], known: list[int], reach: list[float], place: int) -> dict:
        m = np.zeros((len(rows), max(map(len, rows))), np.int64)
        for i, r in enumerate(rows):
            m[i, : len(r)] = r
        own = {"known": np.array(known, np.int64).tobytes(), "floor": min(reach)} if asked else {"longest": float(_lengths(m).max())}
        return {"ids": np.array(ids, np.int64).tobytes(), "width": m.shape[1], "vectors": m.tobytes(), **own, "part": TaskContext.get().partitionId(), "place": place}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        place = 0
        for batch in batches:
            for row in zip(batch["vec_id"], batch["v"], batch["known"] if asked else repeat(0), batch["reach"] if asked else repeat(0.0)):
                held.append(row)
                if len(held) == size:
                    yield pd.DataFrame([block(*map(list, zip(*held)), place)])
                    held, place = [], place + 1
        if held:
            yield pd.DataFrame([block(*map(list, zip(*held)), place)])

    return run


def _lengths(m: np.ndarray) -> np.ndarray:
    return np.sqrt((m.astype(np.float64) ** 2).sum(axis=1))


def _matrix(row) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(row["ids"], np.int64)
    return ids, np.frombuffer(row["vectors"], np.int64).reshape(len(ids), row["width"])


def _widen(m: np.ndarray, width: int) -> np.ndarray:
    return np.pad(m, ((0, 0), (0, width - m.shape[1])))


def _products(a: np.ndarray, b: np.ndarray, bound: float, own: np.ndarray) -> np.ndarray:
    """Inner products; NONE where `own` says that a row is the query's own."""
    if bound < EXACT:
        return np.where(own, NONE, np.rint(a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64))
    if bound < WIDE:
        return np.where(own, NONE, a @ b.T)
    whole = np.where(own, 0, a.astype(object) @ b.T.astype(object))
    if whole.size and (whole.max() > np.iinfo(np.int64).max or whole.min() <= NONE):
        raise OverflowError("a score does not fit into 64 bits")
    return np.where(own, NONE, whole.astype(np.int64))


class _Best:
    """The k best (score, id) of each query: scores descending, then ids ascending."""

    def __init__(self, n: int, k: int, known: np.ndarray | None = None):
        """known: scores that the k-th best of each query is known to reach, here or elsewhere."""
        self.k = k
        self.known = np.full(n, NONE) if known is None else known
        self.scores = np.full((n, k), NONE)
        self.ids = np.full((n, k), np.iinfo(np.int64).max)

    def threshold(self, of=slice(None)) -> np.ndarray:
        return np.maximum(self.scores[of, -1], self.known[of])

    def add(self, of: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """scores: a row for each query in `of`, a column for each id; the least integer marks no candidate."""
        if scores.shape[1] > 4 * self.k:  # whatever ties with the k-th largest has to stay
            kth = np.partition(scores, -self.k, axis=1)[:, -self.k]
            floor = np.maximum(kth, self.threshold(of))
            keep = (scores >= floor[:, None]) & (scores > NONE)
            for row in np.flatnonzero(keep.any(axis=1)):
                at = np.flatnonzero(keep[row])
                self._merge(of[row], scores[row, at], ids[at])
            return
        for row in range(len(of)):
            at = scores[row] > NONE
            self._merge(of[row], scores[row, at], ids[at])

    def _merge(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        s = np.concatenate([self.scores[q], scores])
        i = np.concatenate([self.ids[q], ids])
        order = np.lexsort((i, ~s))[: self.k]  # ~s falls as s rises and never overflows
        self.scores[q], self.ids[q] = s[order], i[order]


def search_bucket(queries: np.ndarray, query_ids: np.ndarray, norms: np.ndarray, bucket: np.ndarray, ids: np.ndarray, best: _Best) -> None:
    """Let one bucket compete for the best of each query; norms are the queries' lengths."""
    lengths = _lengths(bucket)
    longest = lengths.max()
    bound = float(norms.max() * longest) if len(norms) else 0.0
    has = best.threshold() > NONE
    need = best.threshold().astype(np.float64)
    with np.errstate(divide="ignore", invalid="ignore"):
        local = np.where(has, need / (norms * longest), -np.inf)
    local = np.where(has & ~np.isfinite(local), np.where(need > 0, np.inf, -np.inf), local)
    slack = 1e-9
    by_length = np.flatnonzero(local < COORDINATE_FROM)
    by_coordinate = np.flatnonzero((local >= COORDINATE_FROM) & (local <= 1 + slack))
    if len(by_length):
        with np.errstate(divide="ignore", invalid="ignore"):
            shortest = np.where(has[by_length] & (need[by_length] > 0), need[by_length] / norms[by_length], 0.0)
        kept = np.flatnonzero(lengths >= shortest.min() * (1 - slack))
        if len(kept):
            scores = _products(queries[by_length], bucket[kept], bound, query_ids[by_length][:, None] == ids[kept][None, :])
            scores[lengths[kept][None, :] < shortest[:, None] * (1 - slack)] = NONE
            best.add(by_length, scores, ids[kept])
    if len(by_coordinate):
        unit = bucket / np.maximum(lengths, 1e-300)[:, None]
        for q in by_coordinate:
            axis = int(np.abs(queries[q]).argmax())
            c, t = queries[q, axis] / norms[q], min(local[q], 1.0)
            reach = np.sqrt(max(0.0, (1 - c * c) * (1 - t * t)))
            low = c * t - reach if c > -t else -1.0
            high = c * t + reach if c < t else 1.0
            at = np.flatnonzero((unit[:, axis] >= low - 1e-7) & (unit[:, axis] <= high + 1e-7) & (ids != query_ids[q]))
            if len(at):
                best.add(np.array([q]), _products(queries[q : q + 1], bucket[at], bound, np.zeros((1, len(at)), bool)), ids[at])


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k greatest inner products; ties go to the smaller vec_id.

    Both have vec_id and v (integer_vectors). A query's own vec_id is no candidate. Vectors of unequal
    dimension are compared as if the shorter ended in zeros. An empty side gives no rows. Scores are exact; one that
    doesn't fit into 64 bits is an error. Rows that repeat are
    candidates of their own, but one query.
    """
    spark = vectors.sparkSession
    norm2 = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    parts = shuffle_partitions(spark)
    by_norm = vectors.withColumn("_n", norm2).repartitionByRange(parts, F.desc("_n"), "vec_id").sortWithinPartitions(F.desc("_n"), "vec_id")
    buckets = materialize(by_norm.select("vec_id", "v").mapInPandas(_pack(BUCKET), PACKED))
    seed = buckets.orderBy(F.desc("longest"), "ids").first()  # BUCKET vectors at most
    first = None if seed is None else _matrix(seed)

    def sow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), QUERIES):
                part = batch.iloc[at : at + QUERIES]
                ids, q = _matrix(next(_pack(len(part))(iter([part]))).iloc[0])
                best, norms = _Best(len(ids), k), _lengths(q)
                if first is not None:
                    width = max(q.shape[1], first[1].shape[1])
                    search_bucket(_widen(q, width), ids, norms, _widen(first[1], width), first[0], best)
                with np.errstate(divide="ignore", invalid="ignore"):
                    reach = np.where(best.threshold() > 0, best.threshold() / norms, -1.0)
                yield part.assign(known=best.threshold(), reach=reach)

    sown = materialize(queries.select("vec_id", "v").distinct().mapInPandas(sow, "vec_id long, v array<long>, known long, reach double"))
    # Only counts, of buckets and blocks in a partition and of queries, are looked at here.
    slots = max(1, min(parts, -(-sown.count() // QUERIES)))
    by_reach = sown.repartitionByRange(slots, "reach", "vec_id").sortWithinPartitions("reach", "vec_id")
    blocks = materialize(by_reach.mapInPandas(_pack(QUERIES, True), ASKED))
    discard(sown)
    deepest, most = buckets.agg(F.max("place")).first()[0], blocks.agg(F.max("place")).first()[0]
    lanes = 1 + (deepest or 0) // LANE
    buckets = buckets.withColumn("lane", F.col("part").cast("long") * lanes + F.floor(F.col("place") / LANE))
    blocks = blocks.withColumn("slot", F.col("part").cast("long") * (1 + (most or 0)) + F.col("place")).drop("part", "place")
    longest = buckets.groupBy("lane").agg(F.max("longest").alias("longest"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts * lanes - 1).cast("long"))).alias("lane")
    meets = blocks.groupBy("slot").agg(F.min("floor").alias("floor")).select("slot", "floor", every).join(longest, "lane")
    meets = materialize(meets.where(F.col("longest") >= F.col("floor") * (1 - 1e-9)).select("slot", "lane"))
    cells, asking = buckets.join(meets, "lane"), blocks.join(meets, "slot")

    def cell(group: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        found = sorted(map(_matrix, group.to_dict("records")), key=lambda x: -_lengths(x[1][:1])[0])
        rows = [np.zeros((0, 3), np.int64)]
        for block in asking.to_dict("records"):
            q_ids, q = _matrix(block)
            norms = _lengths(q)
            best = _Best(len(q_ids), k, np.frombuffer(block["known"], np.int64))
            for ids, bucket in found:
                width = max(q.shape[1], bucket.shape[1])
                search_bucket(_widen(q, width), q_ids, norms, _widen(bucket, width), ids, best)
            row, col = np.nonzero(best.scores > NONE)
            rows.append(np.stack([q_ids[row], best.ids[row, col], best.scores[row, col]], axis=1))
        return pd.DataFrame(np.concatenate(rows), columns=["query_id", "vec_id", "score"])

    local = cells.groupBy("slot", "lane").cogroup(asking.groupBy("slot", "lane")).applyInPandas(cell, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = local.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
