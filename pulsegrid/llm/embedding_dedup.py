"""Near copies among vectors of one label, by binary codes of randomly rotated vectors.

A vector's code has the signs of its components under random rotations, CODE bits in all. The first DIM of them, those of
one rotation, stand for the vector o' that the code's signs make, and the product <o', o> is stored as the code's correction
factor x: for any q, <o', q> / x is an unbiased estimate of <o, q>, and it is off by at most sqrt(1 - <o, q>^2) sqrt(1 - x^2) / x times
SIGMAS / sqrt(DIM - 1), but for a share of 2e-9 of the pairs (times one: never). A pair whose bound stays below the threshold is left alone; any other pair's cosine is
computed anew from the vectors. Nothing is decided by an estimate alone.

Which pairs are estimated: a bit differs between two vectors with the probability angle / pi. Each table's key has some of the code's bits, more for
larger labels, and there are as many tables as it takes for a pair at the threshold to share a key in one with a probability of all but MISS, over the
number of bits in which it may differ. Two codes of one key that differ in more bits than such a pair does, but for the same MISS, are passed over. So
two in 10^8 of the links at the threshold itself are expected to be missed, and far fewer above it. What is copied for every key is the code alone; the vectors
go only to those cells where a code has found a partner.

Buckets of one key are cut into blocks of BLOCK codes and a cell compares two blocks, so a label that holds a third of all vectors, or a large group of
near copies, is spread over many cells. A pair counts in the first table whose key it shares. A cell returns a count and one neighbour for each
vector, never pairs. Equal vectors of one label are one class throughout.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize
from .ngram_join import components

THRESHOLD = 0.98
CODE, SIGMAS, MISS = 512, 6.0, 1e-8
#: Keys have KEY bits at least, and so many that a bucket of the largest label holds some BUCKET codes of vectors that are not alike.
KEY, BUCKET, BLOCK = 8, 64, 512


@lru_cache(maxsize=16)
def rotations(dim: int) -> np.ndarray:
    """As many random rotations of `dim` dimensions as give CODE bits, side by side."""
    r = np.random.default_rng(dim)
    return np.concatenate([np.linalg.qr(r.standard_normal((dim, dim)))[0] for _ in range(-(-CODE // dim))], axis=1).astype(np.float64)


def plan(largest: int, threshold: float = THRESHOLD) -> tuple[np.ndarray, int]:
    """The bits of each table's key, for a largest label of so many vectors, and the most bits in which codes may differ."""
    p = math.acos(threshold) / math.pi
    share = np.array([math.comb(CODE, m) * p**m * (1 - p) ** (CODE - m) for m in range(CODE + 1)])  # of pairs that differ in m bits
    bits = min(40, max(KEY, math.ceil(math.log2(max(largest, 1) / BUCKET))))
    equal = np.array([math.comb(CODE - m, bits) / math.comb(CODE, bits) for m in range(CODE + 1)])  # of keys that such a pair shares
    tables = 1
    while (share * (1 - equal) ** tables).sum() > MISS:
        tables += 1
    most = int(np.flatnonzero(share[::-1].cumsum()[::-1] >= MISS)[-1])
    r = np.random.default_rng(7)
    return np.stack([r.permutation(CODE)[:bits] for _ in range(tables)]), most


def unit(m: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that no square leaves the range of doubles."""
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def codes(units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """CODE signs of each vector of length one, packed in bytes, and the correction factors of the first rotation."""
    turned = units @ rotations(units.shape[1])
    return np.packbits(turned[:, :CODE] > 0, axis=1), np.abs(turned[:, : units.shape[1]]).sum(axis=1) / math.sqrt(units.shape[1])


def estimates(units: np.ndarray, others: np.ndarray, factors: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of `units` and each code with its factor: the estimated cosine, and how much a pair at the threshold can lie above it."""
    dim = units.shape[1]
    signs = np.where(np.unpackbits(code, axis=1)[:, :dim] > 0, 1.0, -1.0) / math.sqrt(dim)
    if dim > CODE:  # the code is shorter than a rotation
        signs = np.where(others @ rotations(dim)[:, :dim] > 0, 1.0, -1.0) / math.sqrt(dim)
    turned = units @ rotations(dim)[:, :dim]
    room = math.sqrt(1 - THRESHOLD**2) * np.sqrt(np.maximum(1 - factors**2, 0)) / factors * min(1.0, SIGMAS / math.sqrt(max(dim - 1, 1)))
    return turned @ signs.T / factors, room


def _keys(code: np.ndarray, tables: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(code, axis=1).astype(np.int64)
    return np.stack([bits[:, t] @ (1 << np.arange(len(t), dtype=np.int64)) for t in tables], axis=1)


def _encode(reps: DataFrame) -> DataFrame:
    """g (of label and dimension), id, code and factor of each class's vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.asarray(batch.column("dim"))
            for dim in np.unique(dims):
                own = batch.filter(pa.array(dims == dim))
                code, factor = codes(unit(np.asarray(own.column("v").flatten()).reshape(-1, dim)))
                yield pa.RecordBatch.from_arrays([*map(own.column, ("g", "id")), pa.array(list(map(bytes, code)), pa.binary()), pa.array(factor)], ["g", "id", "code", "factor"])

    return reps.select(F.xxhash64("label", "dim").alias("g"), "dim", "id", "v").mapInArrow(run, "g long, id long, code binary, factor double")


def _codes_of(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), CODE // 8)


def _spread(coded: DataFrame, tables: np.ndarray) -> DataFrame:
    """A row for each code and table: its key there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                flat = pa.array(_keys(_codes_of(batch.column("code")), tables).ravel())
                ends = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * len(tables))
                yield pa.RecordBatch.from_arrays([*map(batch.column, ("g", "id", "code")), pa.ListArray.from_arrays(ends, flat)], ["g", "id", "code", "keys"])

    keyed = coded.select("g", "id", "code").mapInArrow(run, "g long, id long, code binary, keys array<long>")
    return keyed.select("g", "id", "code", F.posexplode("keys").alias("t", "key"))


CELL = ["g", "t", "key", "low", "high"]


def _cells(rows: DataFrame) -> DataFrame:
    """Rows of a bucket, with its `blocks`, in the cells in which they meet; a cell's rows come one behind the other."""
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    rows = rows.withColumn("block", block).withColumn("_with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("low", F.least("block", "_with")).withColumn("high", F.greatest("block", "_with")).drop("_with", "blocks")
    return rows.repartition(*CELL).sortWithinPartitions(*CELL)


def _each_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[tuple[int, int]]]]:
    """Batches that end where a cell ends, with the first and last row of each of their cells."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        cells = np.stack([np.asarray(whole.column(c)).astype(np.int64) for c in CELL])
        cuts = [0, *(np.flatnonzero((cells[:, 1:] != cells[:, :-1]).any(axis=0)) + 1).tolist()]
        held = [whole.slice(cuts[-1])]
        if len(cuts) > 1:
            yield whole.slice(0, cuts[-1]), list(zip(cuts, cuts[1:]))
    if held:
        yield held[0], [(0, held[0].num_rows)]


def _near(code: np.ndarray, low: np.ndarray, high: np.ndarray, most: int, tables: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of two blocks, or of one, whose codes differ in few bits and share no key of the earlier `tables`."""
    wide = code.view(np.uint64)
    apart = np.zeros((len(low), len(high)), np.uint16)
    for w in range(wide.shape[1]):
        apart += np.bitwise_count(wide[low, w][:, None] ^ wide[high, w][None])
    found = apart <= most
    if low is high:
        found = np.triu(found, 1)
    x, y = np.nonzero(found)
    if not len(x) or not len(tables):
        return low[x], high[y]
    some, at = np.unique(np.concatenate([low[x], high[y]]), return_inverse=True)
    keys = _keys(code[some], tables)
    p, q = at[: len(x)], at[len(x) :]
    first = np.ones(len(x), bool)
    for s in range(len(tables)):
        first &= keys[p, s] != keys[q, s]
    return low[x[first]], high[y[first]]


def linked(reps: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(id, links, other): what each cell found for each class; `other` is one linked class, or null.

    reps: label, dim, id, n (vectors of the class), v (array<double>, neither zero nor holding null or non-finite
    components). Ids are unique.
    """
    coded = materialize(_encode(reps))
    largest = coded.groupBy("g").count().agg(F.max("count")).first()[0] or 0
    tables, most = plan(largest, threshold)
    spread = materialize(_spread(coded, tables))
    bucket = ["g", "t", "key"]
    counts = spread.groupBy(*bucket).agg(F.count("*").alias("_n")).where("_n > 1").select(*bucket, F.ceil(F.col("_n") / BLOCK).cast("int").alias("blocks"))

    def sides(block: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        own = block[a:b]
        low = np.flatnonzero(own == own.min()) + a
        return low, low if own.min() == own.max() else np.flatnonzero(own == own.max()) + a

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, cells in _each_cell(batches):
            code, t = _codes_of(batch.column("code")), np.asarray(batch.column("t"))
            block, low, high = (np.asarray(batch.column(c)) for c in ("block", "low", "high"))
            kept = [np.zeros(0, np.int64)]
            for a, b in cells:
                if b - a > 1 and (low[a] == high[a] or block[a:b].min() != block[a:b].max()):
                    kept.append(np.unique(np.concatenate(_near(code, *sides(block, a, b), most, tables[: t[a]]))))
            yield batch.select([*CELL, "block", "id"]).take(pa.array(np.concatenate(kept)))

    cells = _cells(spread.join(counts, bucket)).select(*CELL, "block", "id", "code")
    asked = materialize(cells.mapInArrow(meet, "g long, t int, key long, low int, high int, block int, id long"))
    told = asked.join(coded.select("id", "code", "factor"), "id").join(reps.select("id", "label", "n", "v"), "id")
    told = told.repartition(*CELL).sortWithinPartitions(*CELL).select(*CELL, "block", "id", "code", "factor", "label", "n", "v")

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, cells in _each_cell(batches):
            code, t, block, ids, n, factor = _codes_of(batch.column("code")), *(np.asarray(batch.column(c)) for c in ("t", "block", "id", "n", "factor"))
            label = np.asarray(batch.column("label").dictionary_encode().indices)
            v = batch.column("v")
            flat, ends = np.asarray(v.values), np.asarray(v.offsets)
            rows: list[tuple[int, int, int | None]] = []
            for a, b in cells:
                x, y = _near(code, *sides(block, a, b), most, tables[: t[a]])
                same = (label[x] == label[y]) & (ends[x + 1] - ends[x] == ends[y + 1] - ends[y])
                x, y = x[same], y[same]
                if not len(x):
                    continue
                units = unit(flat[ends[a] : ends[b]].reshape(b - a, -1))
                low, p = np.unique(x, return_inverse=True)
                high, q = np.unique(y, return_inverse=True)
                guess, room = estimates(units[low - a], units[high - a], factor[high], code[high])
                maybe = guess[p, q] + room[q] >= threshold - 1e-9
                x, y = x[maybe], y[maybe]
                near = np.zeros(len(x), bool)
                for at in range(0, len(x), 1 << 14):  # what no bound decides is computed anew
                    i, j = x[at : at + (1 << 14)] - a, y[at : at + (1 << 14)] - a
                    near[at : at + (1 << 14)] = np.einsum("ij,ij->i", units[i], units[j]) >= threshold
                x, y = x[near], y[near]
                rows += [(int(ids[i]), 0, int(ids[j])) for i, j in _forest(x, y)]
                links = np.bincount(np.concatenate([x, y]) - a, np.concatenate([n[y], n[x]]), b - a).astype(np.int64)
                rows += [(int(ids[i + a]), int(links[i]), None) for i in np.flatnonzero(links)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], ["id", "links", "other"])

    out = materialize(told.mapInArrow(decide, "id long, links long, other long"))
    discard(coded, spread, asked)
    return out


def _forest(x: np.ndarray, y: np.ndarray) -> list[tuple[int, int]]:
    """Of links between rows x and y, as many as connect all that they connect."""
    to: dict[int, int] = {}

    def root(i: int) -> int:
        while i in to:
            to[i] = to.get(to[i], to[i])
            i = to[i]
        return i

    kept = []
    for i, j in zip(x.tolist(), y.tolist()):
        p, q = root(i), root(j)
        if p != q:
            to[max(p, q)] = min(p, q)
            kept.append((p, q))
    return kept


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id and kept of each row of vectors (vec_id, embedding, label).

    Vectors of one label, not null, and one number of components are linked from a cosine of `threshold` on. Vectors that are null,
    empty, zero or hold null or non-finite components are linked with nothing. Rows of one vec_id are one node:
    they have no link with each other and one component, and equal ones count once as another's link. A
    null vec_id has no links and no component, and isn't kept. Other columns are not looked at.
    """
    x = F.col("v")
    rows = materialize(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("v")))
    finite = F.coalesce(F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(x, lambda c: c != 0), F.lit(False))
    some = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite).dropDuplicates(["vec_id", "label", "v"])
    # classes of equal vectors go by their least vec_id; where two classes have the same, by a hash far above all ids
    named = materialize(some.groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")))
    several = named.groupBy("rep").agg(F.count("*").alias("_n")).where("_n > 1")
    apart = F.xxhash64("label", "v", "rep").bitwiseAND(F.lit((1 << 61) - 1)) + F.lit(3 << 61)
    classes = materialize(named.join(several, "rep", "left").select("label", "v", F.size("v").alias("dim"), "rep", "n", F.when(F.col("_n") > 1, apart).otherwise(F.col("rep")).alias("id")))
    found = linked(classes, threshold)
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    told = classes.select("label", "v", "rep", "n", "id").join(links, "id", "left").withColumn("links", F.coalesce("links", F.lit(0)) + F.col("n") - 1)
    told = materialize(told)
    # nodes are vec_ids: those of a class hang on its representative
    members = some.join(told.select("label", "v", "rep", "id", "links"), ["label", "v"]).select("vec_id", "label", "v", "rep", "id", "links")
    members = materialize(members)
    rep = told.select("id", "rep")
    edges = found.where("other IS NOT NULL").select("id", "other").join(rep, "id").join(rep.select(F.col("id").alias("other"), F.col("rep").alias("b")), "other").select(F.col("rep").alias("a"), "b")
    roots = components(edges.unionByName(members.where("rep <> vec_id").select(F.col("rep").alias("a"), F.col("vec_id").alias("b"))))
    own = rows.join(members.select("vec_id", "label", "v", "links"), ["vec_id", "label", "v"], "left").select("vec_id", F.coalesce("links", F.lit(0)).alias("n_links"))
    out = own.join(roots.select(F.col("node").alias("vec_id"), "root"), "vec_id", "left")
    out = materialize(out.select("vec_id", "n_links", F.coalesce("root", "vec_id").alias("component_id")).withColumn("kept", F.col("vec_id") == F.col("component_id")))
    discard(rows, named, classes, found, told, members)
    return out


ORACLE = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= {THRESHOLD}
), reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
root AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
links AS (SELECT a, count(*) AS n_links FROM link GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings e JOIN root ON root.a = vec_id LEFT JOIN links ON links.a = vec_id
"""
