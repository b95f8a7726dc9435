"""Toxicity by compression distance between two zstandard dictionaries.

zstandard's trainer makes both dictionaries from labelled text. The ordinary one is trained on the windows of
ordinary documents. The toxic one is trained on toxic documents, from which whatever ordinary documents explain
is struck out first: of each word only the runs of GRAM characters stay that toxic text has clearly more often.
Without that the trainer would take what both kinds of text share, and the lengths would differ by chance.

A text is cut into windows of WINDOW words, and each is compressed twice: with the ordinary dictionary, and with
the toxic one put behind the ordinary one. The first time as many zeros lie there, so that the ordinary bytes have
the same distance both times, and the two lengths differ only where the toxic dictionary is of use. A document's features are how
many of its windows save so many bytes, for each of LEVELS, their shares and the greatest saving. A logistic
curve over them gives the score.

The curve and its cut are calibrated on documents that the dictionaries in use have not seen: the labelled
documents are dealt to FOLDS folds, and those of a fold are measured with a toxic dictionary of the others. The
cut is where the share of toxic documents found and that of ordinary ones left alone have the greatest sum; the
curve is moved so that it lies at 0.5.

Fitting reads at most SAMPLE labelled documents of each class, those with the least hashed ids, but all of their
text. Counts are made by Spark; the driver sees the runs and pieces of words that set toxic text apart, two
dictionaries and a row of numbers for each sampled document. Scoring is a map over all documents without a shuffle.
"""

from __future__ import annotations

import random
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import append_column, discard, fresh, materialize, words

#: Bound of the fit: labelled documents of a class.
SAMPLE = 3000
FOLDS, HELD_OUT = 3, 5
#: Words in a window, characters of a run, bytes of the ordinary dictionary and how many tasks train a part of it.
WINDOW, GRAM, ORDINARY, PARTS = 8, 5, 24_576, 2
#: A run sets toxic text apart if it has so many contexts there, so many times its share of the ordinary ones, and
#: so much evidence (log-likelihood ratio).
CONTEXTS, TIMES, EVIDENCE = 4, 3, 8
LEVELS = (1, 2, 3, 4, 5)
#: zstandard finds no match in a block's last bytes, so every window ends in these.
END = b"\n" * 16
#: Windows that are compressed in one call.
CALL = 20_000


def in_training(doc_id) -> Column:
    """False for the fold that is held out: crc32 of the decimal doc_id divisible by five."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % HELD_OUT != 0


@dataclass(frozen=True)
class Model:
    ordinary: bytes
    toxic: bytes
    mean: tuple[float, ...]
    spread: tuple[float, ...]
    weights: tuple[float, ...]

    def scorer(self):
        """texts -> scores, with both dictionaries made ready once."""
        measured = measure(self.ordinary, self.toxic)
        mean, spread, w = map(np.array, (self.mean, self.spread, self.weights))

        def score(texts: list[str | None]) -> np.ndarray:
            z = w[0] + ((measured(texts) - mean) / spread) @ w[1:]
            return 1 / (1 + np.exp(-np.clip(z, -60, 60)))

        return score


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    """Compresses with `content` as its history. The tree search finds the longest match wherever it lies."""
    how = zstandard.ZstdCompressionParameters(
        window_log=17, hash_log=17, chain_log=17, search_log=6, min_match=4, strategy=zstandard.STRATEGY_BTLAZY2,
        target_length=64, write_content_size=0, write_dict_id=0, write_checksum=0)
    held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    held.precompute_compress(compression_params=how)
    return zstandard.ZstdCompressor(dict_data=held, compression_params=how)


def lengths(by: zstandard.ZstdCompressor, windows: list[bytes]) -> np.ndarray:
    """Compressed length of each window."""
    made = by.multi_compress_to_buffer(windows)
    return np.fromiter((len(made[i]) for i in range(len(made))), np.int64, len(made))


def cut(text: str | None) -> list[bytes]:
    """The windows of a text: its words in lower case, with a blank before and after each."""
    w = text.lower().encode().split() if text else []
    return [b" " + b" ".join(w[i : i + WINDOW]) + b" " for i in range(0, len(w), WINDOW)]


def measure(ordinary: bytes, toxic: bytes):
    """texts -> a row of features for each: log counts of the windows that save LEVELS bytes or more, three shares
    of them, the greatest saving and the log number of windows."""
    with_ordinary, with_both = compressor(ordinary + bytes(len(toxic))), compressor(ordinary + toxic)

    def saved(windows: list[bytes]) -> np.ndarray:
        windows = [w + END for w in windows]
        return np.maximum(lengths(with_ordinary, windows) - lengths(with_both, windows), 0)

    def run(texts: list[str | None]) -> np.ndarray:
        counts = np.zeros((len(texts), len(LEVELS)))
        most, sizes = np.zeros(len(texts)), np.zeros(len(texts))
        windows: list[bytes] = []
        whose: list[int] = []

        def flush() -> None:
            if windows:
                d, who = saved(windows), np.array(whose)
                for k, level in enumerate(LEVELS):
                    counts[:, k] += np.bincount(who[d >= level], minlength=len(texts))
                np.maximum.at(most, who, d)
                windows.clear()
                whose.clear()

        for i, text in enumerate(texts):
            own = cut(text)
            sizes[i] = len(own)
            for at in range(0, len(own), CALL):
                part = own[at : at + CALL]
                windows.extend(part)
                whose.extend([i] * len(part))
                if len(windows) >= CALL:
                    flush()
        flush()
        return np.column_stack([np.log1p(counts), counts[:, :3] / np.maximum(sizes, 1)[:, None], most, np.log1p(sizes)])

    return run


def vocabulary(sample: DataFrame) -> DataFrame:
    """word and t0, o0, t1, ...: in how many different contexts (the words around it) toxic and ordinary documents
    of each fold have it. Words are in lower case without full stops and commas behind them; copies of a text count once."""
    w = F.transform(words(F.lower("text")), lambda x: F.rtrim(x, F.lit(".,")))
    blank = F.array(F.lit(""))
    around = F.arrays_zip(F.concat(blank, w).alias("before"), w.alias("word"), F.concat(F.slice(w, 2, F.greatest(F.size(w), F.lit(1))), blank).alias("after"))
    each = sample.select("toxic", "fold", F.explode(around).alias("c")).where("c.word IS NOT NULL AND c.word <> ''").select("toxic", "fold", "c.*").distinct()
    counts = [F.count_if((F.col("toxic") == c) & (F.col("fold") == f)).alias(f"{'ot'[c]}{f}") for f in range(FOLDS) for c in (1, 0)]
    return each.groupBy("word").agg(*counts)


def _apart(counted: DataFrame) -> list[frozenset[str]]:
    """The runs of characters that set toxic text apart, for each fold without its documents, then over all."""
    spelt = F.concat(F.lit(" "), "word", F.lit(" "))
    runs = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(spelt) - GRAM + 1), lambda i: F.substring(spelt, i, F.lit(GRAM))))
    folds = range(FOLDS)
    names = [f"{c}{f}" for f in folds for c in "to"]
    total = counted.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names]).first()
    by_run = counted.where(F.length("word") > GRAM - 3).select(F.explode(runs).alias("run"), *names).groupBy("run").agg(*[F.sum(n).alias(n) for n in names])
    tests = []
    for left_out in [*folds, None]:
        used = [f for f in folds if f != left_out]
        a, b = (sum((F.col(f"{c}{f}") for f in used), F.lit(0)).cast("double") for c in "to")
        n, m = (max(1, sum(total[f"{c}{f}"] for f in used)) for c in "to")
        share = (a + b) / float(n + m)
        evidence = a * F.log(a / (share * n)) + F.when(b > 0, b * F.log(b / (share * m))).otherwise(0.0)
        tests.append(F.when((a >= CONTEXTS) & (a / n >= TIMES * (b + 0.5) / m), evidence >= EVIDENCE).otherwise(F.lit(False)))
    told = by_run.select("run", F.array(*tests).alias("_apart")).where(F.array_contains("_apart", True)).collect()
    return [frozenset(r[0] for r in told if r[1][k]) for k in range(FOLDS + 1)]


def pieces(word: str, apart: frozenset[str]) -> list[str]:
    """What is left of a word when all but the given runs are struck out."""
    spelt = f" {word} "
    stays = [False] * len(spelt)
    for i in range(len(spelt) - GRAM + 1):
        if spelt[i : i + GRAM] in apart:
            stays[i : i + GRAM] = [True] * GRAM
    return [p for p in "".join(c if s else "\0" for c, s in zip(spelt, stays)).split("\0") if p]


def _toxic_dictionaries(counted: DataFrame) -> list[bytes]:
    """The toxic dictionary of all folds but one, for each, then that of all."""
    apart = _apart(counted)
    names = [f"t{f}" for f in range(FOLDS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for word, *times in zip(*(batch.column(n).to_pylist() for n in ("word", *names))):
                for k, own in enumerate(apart):
                    n = sum(t for f, t in enumerate(times) if f != k)
                    if n:
                        for piece in pieces(word, own):
                            found[k, piece] += n
        keys = list(found)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in keys], pa.int32()), pa.array([p for _, p in keys], pa.string()), pa.array([found[x] for x in keys], pa.int64())], ["k", "piece", "n"])

    some = F.lit(False)
    for n in names:
        some = some | (F.col(n) > 0)
    left = counted.where(some).select("word", *names).mapInArrow(run, "k int, piece string, n long")
    rows = left.groupBy("k", "piece").agg(F.sum("n").alias("n")).orderBy("k", "piece").collect()
    return [train_toxic([(r[1].encode(), r[2]) for r in rows if r[0] == k]) for k in range(FOLDS + 1)]


def train_toxic(found: list[tuple[bytes, int]]) -> bytes:
    """zstandard's dictionary for the pieces that are left of toxic text, each as often as it occurs there."""
    samples = [p.ljust(8) for p, n in found for _ in range(n)]
    random.Random(5).shuffle(samples)
    return _train(400 + 3 * sum(len(p) for p, _ in found), samples, k=16, d=6)


def _train(size: int, samples: list[bytes], **how: int) -> bytes:
    """zstandard's dictionary for the samples; a sample too small to train on is its own dictionary."""
    try:
        return zstandard.train_dictionary(size, samples, **how).as_bytes()
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(samples))[:size]


def _ordinary_dictionary(sample: DataFrame) -> bytes:
    """Trained on all windows of the ordinary documents, in PARTS tasks with a part of the room each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = {w for batch in batches for text in batch.column("text") for w in cut(text.as_py())}
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([_train(ORDINARY // PARTS, sorted(seen), level=3)], pa.binary())], ["part"])

    made = sample.where("toxic = 0").repartition(PARTS, "doc_id").select("text").mapInArrow(run, "part binary")
    return b"".join(sorted(bytes(r[0]) for r in made.collect()))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of a ridge logistic regression, the constant first, by Newton steps."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(a.shape[1])
    penalty = np.eye(a.shape[1]) * ridge
    penalty[0, 0] = 1e-9
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (weight * (p - y)) + penalty @ w
        h = (a * (weight * p * (1 - p) + 1e-9)[:, None]).T @ a + penalty
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def best_cut(z: np.ndarray, y: np.ndarray) -> float:
    """Where to cut z so that the shares of y = 1 at or above it and of y = 0 below it have the greatest sum; the
    middle of the gap between two values, and of the best cuts the highest. Above all, if no cut tells them apart."""
    order = np.argsort(-z, kind="stable")
    z, y = z[order], y[order]
    gain = np.cumsum(np.where(y == 1, 1 / max(1, (y == 1).sum()), -1 / max(1, (y == 0).sum())))
    ends = np.append(z[:-1] != z[1:], True)
    at = int(np.flatnonzero(ends)[gain[ends].argmax()])
    if gain[at] <= 1e-9:
        return float(z[0]) + 1.0
    return float(z[at] if at + 1 == len(z) else (z[at] + z[at + 1]) / 2)


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Learn from labelled documents outside the held-out fold; None if a class has none there.

    A document with several labels counts as toxic if one says so; null labels and ids say nothing. Rows that share
    a doc_id but not the text are all used, repeated rows once.
    """
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).where(in_training(F.col("doc_id")))
    of = [F.col("toxic") <= 0, F.col("toxic") > 0]
    some = [known.where(of[c]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE).select("doc_id", F.lit(c).alias("toxic")) for c in (0, 1)]
    chosen = some[0].unionByName(some[1])  # 2 * SAMPLE rows at most
    fold = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(FOLDS)).cast("int").alias("fold")
    sample = materialize(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").distinct().select(F.col("doc_id").cast("long").alias("doc_id"), "text", "toxic", fold).repartition(24, "doc_id"))
    sizes = {r[0]: r[1] for r in sample.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        discard(sample)
        return None
    ordinary = _ordinary_dictionary(sample)
    counted = materialize(vocabulary(sample))
    *of_others, toxic = _toxic_dictionaries(counted)
    discard(counted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_fold: dict = {}
        for batch in batches:
            texts, folds = batch.column("text").to_pylist(), batch.column("fold").to_pylist()
            for f in set(folds):
                at = [i for i, own in enumerate(folds) if own == f]
                own = by_fold.setdefault(f, measure(ordinary, of_others[f]))
                x = own([texts[i] for i in at])
                yield pa.RecordBatch.from_arrays([batch.column("toxic").take(pa.array(at)), pa.array(list(x), pa.list_(pa.float64()))], ["toxic", "x"])

    rows = sorted((r[0], r[1]) for r in sample.select("text", "toxic", "fold").mapInArrow(run, "toxic int, x array<double>").collect())
    discard(sample)
    x, y = np.array([r[1] for r in rows]), np.array([r[0] for r in rows], np.float64)
    mean, spread = x.mean(axis=0), x.std(axis=0)
    spread = np.where(spread < 1e-6, 1.0, spread)  # a feature that never varies says nothing, however far a text is off
    x = (x - mean) / spread
    w = logistic(x, y, np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum())) * len(y))
    w[0] -= best_cut(w[0] + x @ w[1:], y)
    return Model(ordinary, toxic, tuple(mean.tolist()), tuple(spread.tolist()), tuple(w.tolist()))


def score(docs: DataFrame, model: Model | None, out: str = "toxicity") -> DataFrame:
    """docs with `out`, 0 to 1, of each whole text; null texts are scored as empty ones, and all are 0 without
    a model. A column of that name is replaced; rows and other columns stay."""
    if model is None:
        return docs.drop(out).withColumn(out, F.lit(0.0))
    return append_column(docs, "text", out, pa.float64(), "double", model.scorer)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    scored = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), fit(docs, labels))
    return scored.select("doc_id", (~in_training(F.col("doc_id"))).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs less those that are scored 0.5 or more, with all their columns."""
    out = fresh(docs, "_toxicity")
    return score(docs, fit(docs, labels), out).where(F.col(out) < 0.5).drop(out)
