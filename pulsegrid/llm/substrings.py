"""Substring dedup by seed and extend over word sequences.

A window is SPAN consecutive words. Its anchor is the least hash among its runs of GRAM words (winnowing), so
equal windows have equal anchors, and a document has about one anchor for every twenty words. Anchors that only
one document has can start no repeat. Where an anchor is shared, it is extended both ways: every window that
holds it as anchor is hashed whole (128 bits), and the least doc_id of each window is its owner. Neighbouring
windows that belong to an earlier document merge to the maximal repeats, whose words go.

Equality of windows is equality of 128 bits made of 64-bit hashes of their words, so windows are taken as equal
that differ only in words of one hash: of a thousand million different words, two have one in one corpus of forty.

Nothing is ever paired within a group: a window that a million documents share is one row for each of them,
whose least doc_id is found by a partial aggregate. Copies of a whole document are told by the hash of all their
words and need no windows of their own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from .common import discard, materialize, set_aside, taken_back
from .ngram_join import _WORDS, mix, word_hashes

SPAN, GRAM = 50, 10
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _runs(h: np.ndarray, size: int, by: np.uint64) -> np.ndarray:
    """A hash of each run of `size` items, put together of runs of powers of two."""
    power, done, out = h, 1, None
    taken = 0
    for bit in range(size.bit_length()):
        if size >> bit & 1:
            if out is None:
                out, taken = power, done
            else:
                n = len(h) - taken - done + 1
                out = mix(power[:n] * by + out[done : done + n])
                taken += done
        if 2 * done <= size:
            power = mix(power[: len(power) - done] * by + power[done:] + np.uint64(done))
            done *= 2
    return out


def _least(h: np.ndarray, size: int) -> np.ndarray:
    """The least of each run of `size` items."""
    done = 1
    while 2 * done <= size:
        h = np.minimum(h[: len(h) - done], h[done:])
        done *= 2
    rest = size - done
    return np.minimum(h[: len(h) - rest], h[rest:]) if rest else h


def anchors(w: np.ndarray, span: int = SPAN) -> np.ndarray:
    """The anchor of each window of the words with hashes w; empty if there is no window."""
    gram = min(GRAM, span)
    return _least(_runs(w, gram, _A), span - gram + 1) if len(w) >= span else w[:0]


def windows(w: np.ndarray, span: int = SPAN) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each window."""
    return _runs(w, span, _A), _runs(mix(w ^ _B), span, _B)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and _t, which with doc_id tells texts apart."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("_t"))


def _seeds(docs: DataFrame, span: int) -> DataFrame:
    """doc_id, _t, h0, h1 (all words) and the anchors of each document that has a window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, h0, h1, found = [], [], [], []
            for row, text in enumerate(batch.column("text")):
                w = word_hashes(text.as_py())
                if len(w) < span:
                    continue
                place = np.arange(1, len(w) + 1, dtype=np.uint64)
                at.append(row)
                h0.append(mix(w * _A + place).sum())
                h1.append(mix(w * _B + mix(place)).sum())
                found.append(np.unique(anchors(w, span)))
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            flat = np.concatenate(found) if found else np.zeros(0, np.uint64)
            take = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(take), batch.column("_t").take(take), _signed(np.array(h0, np.uint64)), _signed(np.array(h1, np.uint64)), pa.ListArray.from_arrays(ends, _signed(flat))],
                ["doc_id", "_t", "h0", "h1", "anchors"])

    return docs.mapInArrow(run, "doc_id long, _t long, h0 long, h1 long, anchors array<long>")


def _extend(docs: DataFrame, span: int) -> DataFrame:
    """doc_id, _t, start, w0, w1 of the windows whose anchor is among a document's `shared` ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                w = word_hashes(batch.column("text")[row].as_py())
                if len(w) < span:
                    continue
                known = np.sort(batch.column("shared")[row].values.to_numpy()).view(np.uint64)
                start = np.flatnonzero(np.isin(anchors(w, span).view(np.int64), known.view(np.int64)))
                w0, w1 = windows(w, span)
                take = pa.array(np.full(len(start), row, np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(take), batch.column("_t").take(take), pa.array(start.astype(np.int32)), _signed(w0[start]), _signed(w1[start])],
                    ["doc_id", "_t", "start", "w0", "w1"])

    return docs.select("doc_id", "_t", "text", "shared").mapInArrow(run, "doc_id long, _t long, start int, w0 long, w1 long")


def repeats(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """doc_id, _t and starts: the windows of each text that also start in a document with a smaller doc_id.

    starts is null where that is every window, as in copies of a whole document. doc_id is not null.
    """
    own = _keyed(docs.where("doc_id IS NOT NULL"))
    seeds = materialize(_seeds(own, span))
    firsts = materialize(seeds.groupBy("h0", "h1").agg(F.min("doc_id").alias("_first")))
    ranked = materialize(seeds.join(firsts, ["h0", "h1"]).select("doc_id", "_t", "anchors", (F.col("doc_id") > F.col("_first")).alias("_copy")))
    discard(seeds, firsts)
    copies = ranked.where("_copy").select("doc_id", "_t").distinct()
    places = ranked.where("NOT _copy").select("doc_id", "_t", F.explode("anchors").alias("anchor"))
    shared = materialize(places.groupBy("anchor").agg(F.min("doc_id").alias("_a"), F.max("doc_id").alias("_b")).where("_a < _b").select("anchor"))
    wanted = places.join(shared, "anchor").groupBy("doc_id", "_t").agg(F.collect_set("anchor").alias("shared"))
    found = materialize(_extend(own.join(wanted, ["doc_id", "_t"]), span))
    discard(shared)
    owners = materialize(found.groupBy("w0", "w1").agg(F.min("doc_id").alias("_a"), F.max("doc_id").alias("_b")).where("_a < _b").drop("_b"))
    gone = found.join(owners, ["w0", "w1"]).where("doc_id > _a").groupBy("doc_id", "_t").agg(F.collect_set("start").alias("starts"))
    return gone.unionByName(copies.withColumn("starts", F.lit(None).cast("array<int>"))).withColumn("_cut", F.lit(True))


def _covered(n: int, starts: np.ndarray | None, span: int) -> np.ndarray:
    """Which of n words lie in a window with one of the starts; all, if starts is None."""
    if starts is None:
        return np.ones(n, bool)
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, starts, 1)
    np.add.at(depth, np.minimum(starts + span, n), -1)
    return np.cumsum(depth[:n]) > 0


def _gone(batch: pa.RecordBatch, row: int, n: int, span: int) -> np.ndarray | None:
    """Which of a row's n words go; None if none does."""
    if not batch.column("_cut")[row].as_py():
        return None
    starts = batch.column("starts")[row]
    return _covered(n, starts.values.to_numpy().astype(np.int64) if starts.is_valid else None, span)


def _kept(found: list[bytes], gone: np.ndarray | None) -> bytes:
    return b" ".join(found if gone is None else [found[i] for i in np.flatnonzero(~gone)])


def report(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of each row: the digest of its kept words, joined by one space.

    Null texts have no words. Rows with a null doc_id lose nothing, and rows that share one take nothing from
    each other. Repeated rows give repeated results; other columns are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, removed, digests = [], [], []
            for row, text in enumerate(batch.column("text")):
                found = _WORDS((text.as_py() or "").encode())
                gone = _gone(batch, row, len(found), span)
                words.append(len(found))
                removed.append(0 if gone is None else int(gone.sum()))
                digests.append(hashlib.sha256(_kept(found, gone)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(words, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_sha256"])

    marked = _keyed(docs).join(repeats(docs, span), ["doc_id", "_t"], "left")
    return marked.select("doc_id", "text", "starts", "_cut").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def dedup_substrings(docs: DataFrame, span: int = SPAN, length: str | None = None) -> DataFrame:
    """docs with the words of repeats taken from text: what is left is joined by single spaces. Texts that lose
    nothing stay as they are, and all other columns too, whatever these are called; a column `length` is set to
    the code points of those that lose words. Rows with a null doc_id lose nothing; null texts stay null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            changed = [False] * len(texts)
            for row in np.flatnonzero(batch.column("_cut").is_valid().to_numpy(zero_copy_only=False)):
                found = _WORDS((texts[row] or "").encode())
                gone = _gone(batch, row, len(found), span)
                changed[row] = bool(gone.any())
                if changed[row]:
                    texts[row] = _kept(found, gone).decode()
            yield pa.RecordBatch.from_arrays([batch.column("_row"), batch.column("doc_id"), pa.array(texts, pa.string()), pa.array(changed, pa.bool_())], ["_row", "doc_id", "text", "_changed"])

    own = set_aside(docs, _t=F.xxhash64(F.coalesce("text", F.lit("")))).join(repeats(docs.select("doc_id", "text"), span), ["doc_id", "_t"], "left")
    out = StructType([own.schema["_row"], own.schema["doc_id"], own.schema["text"], StructField("_changed", BooleanType())])
    kept = own.select("_row", "doc_id", "text", "starts", "_cut").mapInArrow(run, out)
    kind = docs.schema[length].dataType if length else None
    instead = {length: F.when(F.col("_changed"), F.length("text").cast(kind)).otherwise(F.col("_row").getField(length))} if length else {}
    return kept.select(*taken_back(docs.columns, **instead))


ORACLE = f"""
WITH word AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), win AS (
  SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + {SPAN - 1}), ' ')) AS k
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - {SPAN - 1})) AS i FROM word WHERE len(w) >= {SPAN})
), gone AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS own FROM win) WHERE doc_id > own
), lost AS (SELECT DISTINCT doc_id, i + unnest(generate_series(0, {SPAN - 1})) AS i FROM gone),
each AS (SELECT doc_id, w[i] AS x, i FROM (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS i FROM word)),
marked AS (SELECT e.doc_id, e.x, e.i, l.i IS NOT NULL AS out FROM each e LEFT JOIN lost l ON e.doc_id = l.doc_id AND e.i = l.i),
text AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (out) AS n_removed, coalesce(string_agg(x, ' ' ORDER BY i) FILTER (NOT out), '') AS t FROM marked GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM documents d LEFT JOIN text USING (doc_id)
"""
