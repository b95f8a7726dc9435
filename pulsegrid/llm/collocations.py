"""Phrase collocations by prefix-free parsing.

A text is cut into pieces at marks and line ends, and a piece is parsed into chunks: a chunk begins at a piece's start
or where the hash of OVERLAP words is a multiple of TRIGGER, and ends behind the OVERLAP words with which the next one begins. What the boundaries are depends
on the words alone, so text that repeats gives chunks that repeat. The parse as a whole is never kept: phrases are
counted inside the distinct chunks, weighted by how often the parse has them. A phrase of up to OVERLAP + 1 words lies inside the chunk in which it begins;
those that begin in the last OVERLAP words of a chunk belong to the next chunk, so each is counted once.

Words are counted first, then pairs of frequent words, then longer phrases whose pairs are all frequent. What is
frequent is told to the tasks as a table of BITS bits, whatever its number: an entry too many costs a count, none
is missing. A task counts what it has read in parts of BUFFER bytes before it shuffles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, shuffle_partitions
from .ngram_join import _MULTIPLIER, mix

LONGEST, LEAST, TOP = 5, 100, 2000
OVERLAP, TRIGGER = LONGEST - 1, 16
#: A chunk of so many words ends even without a trigger.
MOST = 1024
BUFFER = 16 << 20
#: Of the table of frequent phrases: 16 MB, in rows of 63 bits.
WORDS_OF_BITS = 1 << 21
SLOT = 63
_POSITIVE = (1 << 62) - 1

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz.........")


def chunks_of(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The chunks of texts, in UTF-8; whether each is the last one of its piece, and its text's place."""
    tokens: list[bytes] = []
    ends = []
    for text in texts:
        tokens += text.translate(_LOWER).replace(b".", b" . ").split()
        tokens.append(b".")
        ends.append(len(tokens))
    coded = pa.array(tokens, pa.binary()).dictionary_encode()
    ids, known = np.asarray(coded.indices), coded.dictionary.to_pylist()
    mark = ids == known.index(b".")
    own = np.fromiter(map(xxhash.xxh3_64_intdigest, known), np.uint64, len(known))[ids]
    n = len(ids)
    rolled = np.zeros(n, np.uint64)
    clear = np.zeros(n, bool)
    if n > OVERLAP:
        h, free = own[: n - OVERLAP], ~mark[: n - OVERLAP]
        for j in range(1, OVERLAP):
            h, free = mix(h * _MULTIPLIER + own[j : n - OVERLAP + j]), free & ~mark[j : n - OVERLAP + j]
        rolled[: n - OVERLAP], clear[: n - OVERLAP] = h, free
    after = np.concatenate([[True], mark[:-1]])
    starts = np.flatnonzero(~mark & (after | clear & (rolled % np.uint64(TRIGGER) == 0)))
    bounds = np.concatenate([starts, [n]])
    marks = np.flatnonzero(mark)
    long = np.flatnonzero(np.minimum(np.diff(bounds), marks[np.searchsorted(marks, starts)] - starts if len(starts) else 0) > MOST)
    if len(long):
        stop = np.minimum(bounds[long + 1], marks[np.searchsorted(marks, starts[long])])
        starts = np.sort(np.concatenate([starts, *[np.arange(a + MOST, b, MOST) for a, b in zip(starts[long], stop)]]))
    stop = marks[np.searchsorted(marks, starts)] if len(starts) else starts
    following = np.concatenate([starts[1:], [n]])[: len(starts)]
    last = following >= stop
    until = np.where(last, stop, np.minimum(following + OVERLAP, stop))
    return [b" ".join(tokens[a:b]) for a, b in zip(starts.tolist(), until.tolist())], last, np.searchsorted(ends, starts, "right")


def parse(docs: DataFrame) -> DataFrame:
    """The dictionary of a corpus (lang, text): lang, chunk, last, times."""

    def part(texts: list[bytes], langs: list[str]) -> pa.RecordBatch:
        found, last, at = chunks_of(texts)
        table = pa.table({"lang": pa.array(langs, pa.string()).take(pa.array(at)), "chunk": pa.array(found, pa.binary()), "last": pa.array(last)})
        table = table.group_by(["lang", "chunk", "last"]).aggregate([([], "count_all")]).combine_chunks()
        return pa.RecordBatch.from_arrays([table.column("lang").combine_chunks(), table.column("chunk").combine_chunks().cast(pa.string()), table.column("last").combine_chunks(), table.column("count_all").combine_chunks()], ["lang", "chunk", "last", "times"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, langs, held = [], [], 0
        for batch in batches:
            for text, lang in zip(batch.column("text"), batch.column("lang")):
                data = text.as_buffer().to_pybytes() if text.is_valid else b""
                if data:
                    texts.append(data)
                    langs.append(lang.as_py())
                    held += len(data)
                if held >= BUFFER // 2:
                    yield part(texts, langs)
                    texts, langs, held = [], [], 0
        if texts:
            yield part(texts, langs)

    own = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    each = own.mapInArrow(run, "lang string, chunk string, last boolean, times long")
    return each.groupBy("lang", "chunk", "last").agg(F.sum("times").alias("times"))


def _frequent(bits: np.ndarray, keys: pa.Array) -> np.ndarray:
    """Which keys have an entry in the table of bits."""
    h = np.fromiter((xxhash.xxh64_intdigest(k.as_buffer(), 42) for k in keys), np.uint64, len(keys))  # F.xxhash64
    slot = (h & np.uint64(_POSITIVE)).astype(np.int64) % (WORDS_OF_BITS * SLOT)
    return (bits[slot // SLOT] >> slot % SLOT & 1).astype(bool)


def bits_of(frequent: DataFrame) -> np.ndarray:
    """A table of bits with an entry for each key; its size is the same for any number of them."""
    slot = F.xxhash64("key").bitwiseAND(F.lit(_POSITIVE)) % (WORDS_OF_BITS * SLOT)
    rows = frequent.select(slot.alias("slot")).groupBy(F.expr(f"cast(slot div {SLOT} as int)").alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(slot % {SLOT} as int))")).alias("bits"))
    found = rows.toArrow()  # WORDS_OF_BITS rows at most
    bits = np.zeros(WORDS_OF_BITS, np.int64)
    bits[np.asarray(found.column("word"))] = np.asarray(found.column("bits"))
    return bits


def _phrases(table: pa.Table, sizes: tuple[int, ...], frequent: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """key (language and phrase), times of the phrases of chunks. frequent: bits of those of the least size less one."""
    langs = table.column("lang").combine_chunks().dictionary_encode()
    split = pc.split_pattern(table.column("chunk").combine_chunks(), " ")
    coded = split.flatten().dictionary_encode()
    ids, words = np.asarray(coded.indices), coded.dictionary
    lengths = np.diff(np.asarray(split.offsets))
    chunk = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
    left = np.repeat(np.cumsum(lengths, dtype=np.int32), lengths) - np.arange(len(ids), dtype=np.int32)  # words to the chunk's end
    begins = np.asarray(table.column("last").combine_chunks().to_numpy(zero_copy_only=False))[chunk] | (left > OVERLAP)
    times = table.column("times").to_numpy()
    del split, coded
    # the phrase of `size` words at each place, as a number; -1 where there is none
    number, size = np.asarray(langs.indices)[chunk], 0
    names, of_lang = pa.array([""] * len(langs.dictionary), pa.string()), np.arange(len(langs.dictionary))
    base = max(sizes[0] - 1, 0)
    good = np.ones(len(ids), bool)
    while size < sizes[-1]:
        size += 1
        at = np.flatnonzero((number >= 0) & (left >= size) & (good if size > base else True))
        if size > base > 0:  # its last part of `base` words
            at = at[good[at + size - base]]
        keys, back = np.unique(number[at] * np.int64(len(words)) + ids[at + size - 1], return_inverse=True)
        before = keys // len(words)
        more = words.take(pa.array(keys % len(words)))
        names = more if size == 1 else pc.binary_join_element_wise(names.take(pa.array(before)), more, " ")
        of_lang = of_lang[before]
        number = np.full(len(ids), -1, np.int32)
        number[at] = back
        if size == base and frequent is not None:
            own = _frequent(frequent, pc.binary_join_element_wise(langs.dictionary.take(pa.array(of_lang)), names, "\n"))
            good = np.zeros(len(ids), bool)
            good[at] = own[back]
        if size >= sizes[0]:
            counted = begins[at]
            n = np.bincount(back[counted], times[chunk[at[counted]]], len(keys)).astype(np.int64)
            some = pa.array(np.flatnonzero(n))
            keys = pc.binary_join_element_wise(langs.dictionary.take(pa.array(of_lang).take(some)), names.take(some), "\n")
            yield pa.RecordBatch.from_arrays([keys, pa.array(n).take(some)], ["key", "times"])


def count(dictionary: DataFrame, sizes: tuple[int, ...], frequent: np.ndarray | None = None) -> DataFrame:
    """key, times over a dictionary of chunks, a key being a language and a phrase in one text, for short rows; with `frequent`, of those phrases alone whose parts of one
    word less than the least size have an entry there."""
    known = dictionary.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= BUFFER:
                yield from _phrases(pa.Table.from_batches(held), sizes, known.value)
                held, size = [], 0
        if size:
            yield from _phrases(pa.Table.from_batches(held), sizes, known.value)

    return dictionary.mapInArrow(run, "key string, times long").groupBy("key").agg(F.sum("times").alias("times"))


def _told(counts: DataFrame) -> DataFrame:
    """lang, phrase, a of keys; a phrase has no line end, a language may."""
    phrase = F.substring_index("key", "\n", -1)
    return counts.select(F.left("key", F.length("key") - F.length(phrase) - 1).alias("lang"), phrase.alias("phrase"), F.col("times").alias("a"))


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's best phrases of 2 to LONGEST words.

    docs has lang (null: und) and text (null: empty); other columns are not looked at. Repeated rows count as often as
    they are there. A phrase counts from `least` occurrences on. Without such a phrase a language has no rows. Scores are
    exact: products are decimals of 38 digits.
    """
    spark = docs.sparkSession
    dictionary = materialize(parse(docs))
    words = materialize(count(dictionary, (1,)))
    total = _told(words).groupBy("lang").agg(F.sum("a").alias("n"))
    common = materialize(words.where(F.col("times") >= least))
    pairs = materialize(count(dictionary, (2,), bits_of(common)).where(F.col("times") >= least))
    longer = materialize(count(dictionary, tuple(range(3, LONGEST + 1)), bits_of(pairs)).where(F.col("times") >= least))
    found = _told(common.unionByName(pairs).unionByName(longer)).withColumn("size", F.size(F.split("phrase", " ")))
    many = found.where("size > 1")
    piece = F.split("phrase", " ")
    # A longer phrase as frequent as this one has a neighbour of one word less that is, too.
    inner = many.where("size > 2").select("lang", "a", F.explode(F.array(F.array_join(F.slice(piece, F.lit(1), F.col("size") - 1), " "), F.array_join(F.slice(piece, F.lit(2), F.col("size") - 1), " "))).alias("phrase"))
    covered = inner.groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    own = many.join(covered, ["lang", "phrase"], "left").where(F.coalesce(F.col("most"), F.lit(0)) < F.col("a")).drop("most")
    cut = own.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cut = cut.select("lang", "phrase", "a", "k", F.array_join(F.slice(piece, F.lit(1), F.col("k")), " ").alias("head"), F.array_join(F.slice(piece, F.col("k") + 1, F.col("size")), " ").alias("tail"))
    parts = found.select("lang", F.col("phrase").alias("part"), F.col("a").alias("f"))
    cut = cut.join(parts.select("lang", F.col("part").alias("head"), F.col("f").alias("l")), ["lang", "head"]).join(parts.select("lang", F.col("part").alias("tail"), F.col("f").alias("r")), ["lang", "tail"])
    cut = cut.join(total, "lang").withColumn("score", F.expr("cast(1000 as decimal(4,0)) * cast(a as decimal(15,0)) * cast(n as decimal(19,0)) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))"))
    least_cut = cut.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a", "n")).alias("_c")).select("lang", "phrase", "_c.*").drop("k")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(shuffle_partitions(spark)))
    best = least_cut.withColumn("_s", salt).withColumn("_p", F.row_number().over(Window.partitionBy("lang", "_s").orderBy(*order))).where(F.col("_p") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    out = materialize(ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"))
    discard(dictionary, words, common, pairs, longer)
    return out


ORACLE = r"""
WITH piece AS (
  SELECT lang, list_filter(string_split_regex(p, '[ \t]+'), lambda x: x <> '') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0B\x0C\r]')) AS p FROM documents)
), f AS (
  SELECT lang, s, w, count(*) AS a FROM (
    SELECT lang, s, array_to_string(list_slice(w, i, i + s - 1), ' ') AS w FROM (
      SELECT lang, w, s, unnest(generate_series(1, len(w) - s + 1)) AS i FROM piece, generate_series(1, 5) t(s) WHERE len(w) >= s))
  GROUP BY ALL HAVING count(*) >= 100
), total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM piece GROUP BY lang),
inside AS (
  SELECT lang, p, max(a) AS most FROM (
    SELECT lang, a, array_to_string(list_slice(x, i, i + k - 1), ' ') AS p FROM (
      SELECT lang, a, s, x, k, unnest(generate_series(1, s - k + 1)) AS i FROM (SELECT *, string_split(w, ' ') AS x FROM f) q, generate_series(2, 4) t(k) WHERE k < s))
  GROUP BY ALL
), own AS (
  SELECT f.lang, w, a, s, unnest(generate_series(1, s - 1)) AS k, string_split(w, ' ') AS x
  FROM f LEFT JOIN inside ON f.lang = inside.lang AND w = p WHERE s > 1 AND (most IS NULL OR 100 * most < 100 * a)
), scored AS (
  SELECT own.lang, own.w AS phrase, own.a, own.k, h.a AS l, t.a AS r, n, ((1000::HUGEINT * own.a * n) // (h.a::HUGEINT * t.a))::BIGINT AS score
  FROM own JOIN f h ON h.lang = own.lang AND h.w = array_to_string(list_slice(x, 1, k), ' ')
    JOIN f t ON t.lang = own.lang AND t.w = array_to_string(list_slice(x, k + 1, own.s), ' ') JOIN total ON total.lang = own.lang
), least AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS c FROM scored)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM least WHERE c = 1) WHERE rank <= 2000
"""
