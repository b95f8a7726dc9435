"""N-gram Jaccard self-join by chosen paths.

A document is the set of its runs of five words, or of all its words if it has fewer. Documents with the
same set are one class, and classes whose sets have a Jaccard similarity of 0.8 or more are linked.

Candidates come from chosen paths. A node picks BRANCHES of the SKETCH min-hash coordinates by its own id; a
set goes on to one child for each, named by the token (the least hash) that the set has there. So sets split
on sampled tokens that they share, again and again; nodes with one set are dropped at each step, and after
DEPTH levels what shares a node is a candidate. RUNS roots repeat this. A pair of similarity s shares a leaf of
one run with probability p, where p' = 1 - (1 - s p)^2 at each level: 0.94 at 0.8. All runs draw on the same
SKETCH coordinates, so they are not independent: simulated over 40,000 pairs, RUNS = 4 leave out one pair in 13,000
of those exactly at the threshold and one in 40,000 at 0.82, but for those that others of their cluster join.

Candidates are then compared exactly. Sets that are joined by leaves form clusters; a cluster is cut into
blocks of about BLOCK sets, and a task compares two blocks, so each pair is compared once, memory is bounded
and a large cluster is spread over many tasks. A task gives back a row for each set, with its number of links
and one linked set, never pairs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, set_aside, taken_back

WORDS, THRESHOLD = 5, (4, 5)  # similarity of at least 4 / 5
SKETCH, BRANCHES, DEPTH, RUNS = 64, 2, 5, 4
#: A block of a cluster has about so many sets, and about so many shingles at most but for those of a single set.
BLOCK, BLOCK_SHINGLES = 128, 200_000
#: The first step goes down so many levels before single sets are dropped; later steps one level each.
FIRST = 2

_WORDS = re.compile(rb"[^\x20\x09-\x0D]+").findall
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_COORDINATES = np.random.default_rng(5).integers(1, 1 << 63, SKETCH, dtype=np.uint64) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str | None) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, _WORDS(text.encode())), np.uint64) if text else np.zeros(0, np.uint64)


def shingle_set(text: str | None, n: int = WORDS) -> np.ndarray:
    """Sorted 64-bit hashes of the runs of n words; of all words, if there are fewer; none without words."""
    w = word_hashes(text)
    k = max(1, len(w) - n + 1) if len(w) else 0
    s = w[:k].copy()
    for j in range(1, min(n, len(w))):
        s = mix(s * _MULTIPLIER + w[j : k + j])
    return np.unique(s)


def sketch(s: np.ndarray) -> np.ndarray:
    """For each coordinate the least hash of the set's members, 32 bits of it."""
    least = np.full(SKETCH, np.iinfo(np.uint64).max)
    for at in range(0, len(s), 8192):
        least = np.minimum(least, (s[at : at + 8192, None] * _COORDINATES).min(axis=0))
    return (least >> np.uint64(32)).astype(np.uint32).view(np.int32)


def describe(docs: DataFrame) -> DataFrame:
    """doc_id, size, s0, s1 (128 bits that stand for the set) and sketch of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, s0, s1, sketches = [], [], [], []
            for text in batch.column("text"):
                s = shingle_set(text.as_py())
                sizes.append(len(s))
                s0.append(int(s.sum().view(np.int64)) if len(s) else 0)
                s1.append(int(mix(s ^ _MULTIPLIER).sum().view(np.int64)) if len(s) else 0)
                sketches.append(sketch(s) if len(s) else np.zeros(0, np.int32))
            flat = np.concatenate(sketches) if sketches else np.zeros(0, np.int32)
            ends = np.cumsum([0, *map(len, sketches)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int32()), pa.array(s0, pa.int64()), pa.array(s1, pa.int64()), pa.ListArray.from_arrays(ends, flat)],
                ["doc_id", "size", "s0", "s1", "sketch"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, size int, s0 long, s1 long, sketch array<int>")


def descend(rows: DataFrame, levels: int) -> DataFrame:
    """(rep, node) of the nodes that lie `levels` below the given ones (rep, node, sketch)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rep = np.asarray(batch.column("rep"))
            node = np.asarray(batch.column("node")).view(np.uint64)
            own = np.asarray(batch.column("sketch").flatten()).view(np.uint32).reshape(len(rep), SKETCH)
            at = np.arange(len(rep))
            for _ in range(levels):
                first = mix(node) % np.uint64(SKETCH)
                kids = []
                for b in range(BRANCHES):  # odd steps from the first give distinct coordinates
                    pick = (first + np.uint64(b) * (mix(node + _MULTIPLIER) | np.uint64(1))) % np.uint64(SKETCH)
                    token = own[at, pick.astype(np.int64)].astype(np.uint64)
                    kids.append(mix(node * _MULTIPLIER + mix(token * np.uint64(SKETCH) + pick)))
                node, at = np.concatenate(kids), np.tile(at, BRANCHES)
            yield pa.RecordBatch.from_arrays([pa.array(rep[at]), pa.array(node.view(np.int64))], ["rep", "node"])

    return rows.select("rep", "node", "sketch").mapInArrow(run, "rep long, node long")


def shared(paths: DataFrame) -> DataFrame:
    """The paths whose node holds more than one set, with the node's least set as `first`."""
    paths = materialize(paths)
    nodes = materialize(paths.groupBy("node").agg(F.count("*").alias("_n"), F.min("rep").alias("first")).where("_n > 1").drop("_n"))
    return paths.join(nodes, "node")


def candidates(sets: DataFrame, runs: int = RUNS, depth: int = DEPTH) -> DataFrame:
    """Edges (a, b), a < b, between sets (rep, sketch) that share a leaf; in each leaf all are joined to the least."""
    roots = F.explode(F.array(*[F.lit(int(mix(np.array([r + 1], np.uint64)).view(np.int64)[0])) for r in range(runs)]))
    paths = shared(descend(sets.select("rep", "sketch", roots.alias("node")), min(FIRST, depth)))
    if depth > FIRST:
        paths = shared(descend(paths.select("rep", "node").join(sets, "rep"), depth - FIRST))
    return paths.where("first < rep").select(F.col("first").alias("a"), F.col("rep").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (a, b); root is the least node it is connected with.

    Rounds of joining larger neighbours, then smaller ones, to the least neighbour, until none changes an edge;
    their number grows with the logarithm of the longest path. Edges stay tables throughout; two numbers a round
    tell whether to go on.
    """
    edges = materialize(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        low = large.groupBy("b").agg(F.min("a").alias("m"))  # neighbours below b
        small = large.join(low, "b").select(F.col("m").alias("x"), F.col("a").alias("y")).where("x <> y")
        before, edges = edges, materialize(small.unionByName(low.select(F.col("m").alias("x"), F.col("b").alias("y"))).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        discard(before)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    roots = edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root"))
    return roots.unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).join(roots.select("node"), "node", "left_anti").distinct())


def _links(a: list[np.ndarray], b: list[np.ndarray] | None) -> np.ndarray:
    """Which pairs of sets are similar enough: a matrix; with b None, of a with itself, without the diagonal."""
    own = a if b is None else a + b
    sizes = np.array(list(map(len, own)))
    who = np.repeat(np.arange(len(own)), sizes)
    _, token, times = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
    keep = times[token] > 1
    token, who = token[keep], who[keep]
    _, token = np.unique(token, return_inverse=True)
    order = np.argsort(token, kind="stable")
    token, who = token[order], who[order]
    n, m = len(a), len(own) - (0 if b is None else len(a))
    both = np.zeros((n, m), np.float32)
    width = 2048
    top = int(token[-1]) + 1 if len(token) else 0
    for low in range(0, top, width):
        x, y = np.searchsorted(token, [low, low + width])
        dense = np.zeros((len(own), min(width, top - low)), np.float32)
        dense[who[x:y], token[x:y] - low] = 1
        both += dense[:n] @ (dense if b is None else dense[n:]).T
    both = both.astype(np.int64)
    right = sizes if b is None else sizes[n:]
    found = THRESHOLD[1] * both >= THRESHOLD[0] * (sizes[:n, None] + right[None, :] - both)
    if b is None:
        np.fill_diagonal(found, False)
    return found


def _forest(names: np.ndarray, found: np.ndarray, shift: int) -> list[tuple[int, int]]:
    """Links that connect all that the links of a cell connect, one fewer than its sets at most; column j of
    found is name j + shift."""
    to: dict[int, int] = {}

    def root(x: int) -> int:
        while x in to:
            to[x] = to.get(to[x], to[x])
            x = to[x]
        return x

    kept = []
    for x, y in np.argwhere(found).tolist():
        p, q = root(x), root(y + shift)
        if p != q:
            to[max(p, q)] = min(p, q)
            kept.append((int(names[p]), int(names[q])))
    return kept


def compare(members: DataFrame, docs: DataFrame) -> DataFrame:
    """(rep, links, other): what each cell found for each of its sets; `other` is one linked set, or null.

    members: (rep, cluster, blocks), rep the doc_id whose text stands for the set.
    """

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [shingle_set(text.as_py()).tobytes() for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*map(batch.column, ("rep", "cluster", "blocks", "block")), pa.array(data, pa.binary())], ["rep", "cluster", "blocks", "block", "set"])

    def cell(table: pa.Table) -> pa.Table:
        low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
        ids, block = table.column("rep").to_numpy(), table.column("block").to_numpy()
        data = table.column("set").to_pylist()
        parts = [np.flatnonzero(block == x) for x in ([low] if low == high else [low, high])]
        rows: list[tuple[int, int, int | None]] = []
        if all(map(len, parts)) and len(ids) > 1:
            own = [[np.frombuffer(data[i], np.uint64) for i in p] for p in parts]
            names = np.concatenate([ids[p] for p in parts])
            found = _links(own[0], own[1] if len(own) > 1 else None)
            rows += [(p, 0, q) for p, q in _forest(names, found, len(own[0]) if len(own) > 1 else 0)]
            counts = [found.sum(axis=1)] + ([found.sum(axis=0)] if len(own) > 1 else [])
            rows += [(i, n, None) for i, n in zip(names.tolist(), np.concatenate(counts).tolist()) if n]
        return pa.table({"rep": pa.array([r[0] for r in rows], pa.int64()), "links": pa.array([r[1] for r in rows], pa.int64()), "other": pa.array([r[2] for r in rows], pa.int64())})

    # members grow with the corpus, so they are shuffled at every size and never broadcast
    block = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    told = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").join(members.hint("merge"), "rep").withColumn("block", block)
    told = told.dropDuplicates(["rep"]).mapInArrow(sets, "rep long, cluster long, blocks int, block int, set binary")
    cells = told.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("_with"))
    cells = cells.select("cluster", F.least("block", "_with").alias("low"), F.greatest("block", "_with").alias("high"), "block", "rep", "set")
    return cells.groupBy("cluster", "low", "high").applyInArrow(cell, "rep long, links long, other long")


def jaccard_join(docs: DataFrame) -> DataFrame:
    """For each row of docs: doc_id, class_id, n_copies, n_links, group_id.

    class_id is the least doc_id with the same set, n_copies the rows with that set, n_links the number of
    other classes that are similar enough, group_id the least doc_id of those that links connect it with.
    Documents without words (null texts too) are similar to nothing, not even to each other. Rows that
    share a doc_id should share their text; where they don't, any one of the texts stands for their links.
    Rows with a null doc_id get nulls and no links. Other columns of docs are not looked at.
    """
    own = materialize(describe(docs))
    some = own.where("size > 0 AND doc_id IS NOT NULL")
    classes = materialize(some.groupBy("s0", "s1").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n_copies")))
    reps = classes.select("rep", F.col("s0").alias("r0"), F.col("s1").alias("r1"))
    same = (F.col("rep") == F.col("doc_id")) & (F.col("r0") == F.col("s0")) & (F.col("r1") == F.col("s1"))
    sets = materialize(some.join(reps, same).select("rep", "size", "sketch").dropDuplicates(["rep"]))
    clusters = materialize(components(candidates(sets.select("rep", "sketch"))))
    sized = clusters.join(sets.select(F.col("rep").alias("node"), "size"), "node")
    counts = sized.groupBy("root").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("size") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    members = clusters.join(counts, "root").select(F.col("node").alias("rep"), F.col("root").alias("cluster"), "blocks")
    found = materialize(compare(members, docs))
    discard(sets, clusters)
    links = found.groupBy("rep").agg(F.sum("links").alias("n_links"))
    groups = components(found.where("other IS NOT NULL").select(F.col("rep").alias("a"), F.col("other").alias("b")))
    verdict = classes.join(links, "rep", "left").join(groups.withColumnRenamed("node", "rep"), "rep", "left").select(
        F.col("s0").alias("c0"), F.col("s1").alias("c1"), F.col("rep").alias("class_id"), "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("root", "rep").alias("group_id"))
    key = (F.col("s0") == F.col("c0")) & (F.col("s1") == F.col("c1")) & (F.col("size") > 0) & F.col("doc_id").isNotNull()
    return own.select("doc_id", "size", "s0", "s1").join(materialize(verdict), key, "left").select(
        "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("group_id", "doc_id").alias("group_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs less those whose group has a document with a smaller doc_id; rows of one doc_id and text count once.

    Of texts that share a doc_id, one stands under it; the others are documents of their own behind all others,
    so each goes only if its text is near to that of a row that stays.
    """
    text = F.xxhash64(F.coalesce("text", F.lit("")))
    own = set_aside(docs.where("doc_id IS NOT NULL"), _text=text)
    several = docs.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(text).alias("_least"), F.max(text).alias("_most"))
    several = materialize(several.where("_least <> _most").drop("_most"))
    other = F.xxhash64("doc_id", "_text").bitwiseAND(F.lit((1 << 61) - 1)) + F.lit(3 << 61)
    own = own.join(several, "doc_id", "left").withColumn("_id", F.when(F.col("_least") != F.col("_text"), other).otherwise(F.col("doc_id")))
    keep = jaccard_join(own.select(F.col("_id").alias("doc_id"), "text")).where("group_id = doc_id").select(F.col("doc_id").alias("_id")).distinct()
    first = own.join(keep, "_id").dropDuplicates(["_id"]).select(*taken_back(docs.columns))
    return first.unionByName(docs.where("doc_id IS NULL"))


ORACLE = """
WITH RECURSIVE word AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), shingle AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS s
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS i FROM word WHERE len(w) > 0)
), class AS (
  SELECT min(doc_id) OVER (PARTITION BY k) AS rep, doc_id, count(*) OVER (PARTITION BY k) AS n_copies, n
  FROM (SELECT doc_id, string_agg(s, chr(10) ORDER BY s) AS k, count(*) AS n FROM shingle GROUP BY doc_id)
), own AS (SELECT rep, s, n FROM class JOIN shingle USING (doc_id) WHERE rep = doc_id),
link AS (
  SELECT a.rep AS a, b.rep AS b FROM own a JOIN own b ON a.s = b.s AND a.rep <> b.rep
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 5 * count(*) >= 4 * (a.n + b.n - count(*))
), reach(a, b) AS (SELECT rep, rep FROM class UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
root AS (SELECT a AS rep, min(b) AS group_id FROM reach GROUP BY a),
links AS (SELECT a AS rep, count(*) AS n_links FROM link GROUP BY a)
SELECT d.doc_id, coalesce(c.rep, d.doc_id) AS class_id, coalesce(n_copies, 1) AS n_copies, coalesce(n_links, 0) AS n_links,
  coalesce(group_id, d.doc_id) AS group_id
FROM documents d LEFT JOIN class c ON d.doc_id = c.doc_id LEFT JOIN links l ON l.rep = c.rep LEFT JOIN root r ON r.rep = c.rep
"""
