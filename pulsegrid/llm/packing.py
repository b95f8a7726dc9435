"""Best-two-fit packing of documents into sequences of a fixed capacity.

A bin is filled greedily with the longest piece that still fits. Then its smallest piece is taken out
and two unpacked pieces go in if together they fit the widened gap more tightly.

Pieces of one length are interchangeable, so the bins are planned over the histogram of lengths, which
has at most `capacity` entries however large the corpus is: that, and no piece, is what the driver sees.
The plan is a table of slots (length, slot range -> sequence, offset); each piece finds its slot by its
rank among the pieces of its length. The rank is a count within (length, salt) plus the counts of the
salts before, so one very common length is spread over SALTS groups.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import _RUNS, CACHE_CHARS, PATTERN, _groups
from .common import materialize

CAPACITY, SALTS = 2048, 1024

#: Most runs that a worker's tokenizer keeps.
CACHE_ENTRIES = 300_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class TokenizerIds:
    """Ids of texts by a tokenizers file, as little-endian unsigned 32-bit bytes, with a cache of runs.

    The file's added tokens are found first and have ids of their own. The file's byte-level splitter never
    joins two runs (see bpe._RUNS), so the ids of what lies between are those of its runs in order. Where the
    file's merges are in the order of their ids, which is all that tiktoken knows, tiktoken merges in a third of
    the time; other files are left to tokenizers, and so are whole texts if an added token takes in blanks or
    stands for whole words only.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        model, added = data["model"], data.get("added_tokens") or []
        self.added = {a["content"]: array("I", [a["id"]]).tobytes() for a in added}
        apart = sorted(self.added, key=len, reverse=True)
        self.whole = any(a.get(k) for a in added for k in ("single_word", "lstrip", "rstrip", "normalized"))
        self.between = re.compile("(" + "|".join(map(re.escape, apart)) + ")") if apart else None
        chars = _byte_chars()
        vocab, merges = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        made = [vocab[a + b] for a, b in merges]
        if made == sorted(made) and not self.whole:
            import tiktoken

            known = {c for c in chars} | {a + b for a, b in merges}
            ranks = {bytes(map(chars.__getitem__, token)): i for token, i in vocab.items() if token in known}
            encode = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
            self.ids = lambda runs: map(encode, runs)
        else:
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            self.ids = lambda runs: (found.ids for found in tokenizer.encode_batch_fast(runs, add_special_tokens=False))
        self.cache: dict[str, bytes] = {}

    def _split(self, text: str | None) -> list[str]:
        if not text:
            return []
        if self.whole:
            return [text]
        if self.between is None or not self.between.search(text):
            return _RUNS.findall(text)
        found = self.between.split(text)
        return [run for i, part in enumerate(found) for run in ([part] if i % 2 else _RUNS.findall(part))]

    def encode(self, texts) -> Iterator[bytes]:
        for group in _groups(texts):
            runs = list(map(self._split, group))
            new = list(set(chain.from_iterable(runs)).difference(self.cache, self.added))
            if len(self.cache) + len(new) > CACHE_ENTRIES:
                self.cache.clear()
                new = list(set(chain.from_iterable(runs)).difference(self.added))
            self.cache |= self.added
            for run, ids in zip(new, self.ids(new)):
                self.cache[run] = array("I", ids).tobytes()
            look = self.cache.__getitem__
            for row in runs:
                yield b"".join(map(look, row))
            for run in [run for run in new if len(run) > CACHE_CHARS]:
                del self.cache[run]


def _byte_chars() -> dict[str, int]:
    """The character that byte-level vocabularies write for each byte: itself if it is printable, else one of
    those from U+0100 on, in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


@lru_cache(maxsize=2)
def tokenizer_ids(path: str) -> TokenizerIds:
    return TokenizerIds(path)


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """The pieces that documents are cut into: doc_id, piece, start, length, ids_crc32 (and ids).

    A document is its ids and end_id; null text counts as empty. One that is longer than capacity is
    cut into pieces of exactly capacity ids, of which the first may be shorter. Rows that repeat are
    documents of their own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, end = tokenizer_ids(tokenizer_path), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            doc, piece, start, length, crc, parts = [], [], [], [], [], []
            for row, data in enumerate(own.encode(batch.column("text").to_pylist())):
                data += end
                n, at = len(data) // 4, 0
                take = n if n <= capacity else n % capacity or capacity
                while at < n:
                    part = data[4 * at : 4 * (at + take)]
                    doc.append(row)
                    piece.append(0 if not at else piece[-1] + 1)
                    start.append(at)
                    length.append(take)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        parts.append(np.frombuffer(part, "<u4").astype(np.int32))
                    at, take = at + take, capacity
            columns = [batch.column("doc_id").take(pa.array(doc, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns, names = [*columns, pa.array(parts, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES + (", ids array<int>" if with_ids else ""))


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[tuple[int, int]], int]]:
    """Patterns [(length, uses), ...] with how many bins get each; they use up all counts.

    A pattern is repeated until one of its lengths runs out, so there are a few patterns for each length.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    plan = []
    while left:
        lengths = np.array(sorted(left))
        gap, uses = capacity, {}
        while True:
            at = int(np.searchsorted(lengths, gap, "right")) - 1
            while at >= 0 and left[int(lengths[at])] <= uses.get(int(lengths[at]), 0):
                at -= 1
            if at < 0:
                break
            n = int(lengths[at])
            more = min(left[n] - uses.get(n, 0), gap // n)
            uses[n] = uses.get(n, 0) + more
            gap -= n * more
        if gap > 0:
            smallest = min(uses)
            wide = gap + smallest
            spare = np.array([n for n in lengths.tolist() if n < wide and left[n] > uses.get(n, 0)])
            if len(spare):
                partner = np.searchsorted(spare, wide - spare, "right") - 1
                fits = partner >= 0
                both = np.where(fits, spare + spare[np.maximum(partner, 0)], 0)
                alone = np.array([left[n] - uses.get(n, 0) < 2 for n in spare.tolist()])
                both[(np.arange(len(spare)) == partner) & alone] = 0
                best = int(both.argmax())
                if both[best] > smallest:
                    uses[smallest] -= 1
                    for n in (int(spare[best]), int(spare[partner[best]])):
                        uses[n] = uses.get(n, 0) + 1
                    uses = {n: c for n, c in uses.items() if c}
        times = min(left[n] // c for n, c in uses.items())
        for n, c in uses.items():
            left[n] -= c * times
            if not left[n]:
                del left[n]
        plan.append((sorted(uses.items(), reverse=True), times))
    return plan


def plan_slots(plan: list[tuple[list[tuple[int, int]], int]]) -> dict[int, list[tuple[int, int, int, int]]]:
    """For each length: (first slot, uses in a bin, first sequence, offset in it) of its slot ranges, in order."""
    slots: dict[int, list[tuple[int, int, int, int]]] = {}
    given: dict[int, int] = {}
    first = 0
    for uses, times in plan:
        offset = 0
        for n, c in uses:
            slots.setdefault(n, []).append((given.get(n, 0), c, first, offset))
            given[n] = given.get(n, 0) + c * times
            offset += n * c
        first += times
    return slots


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces with sequence_id and offset: gapless from 0 in each sequence, none beyond capacity.

    Needs the columns of token_pieces; lengths are from 1 to capacity. An empty table gives an empty one.
    """
    spark = pieces.sparkSession
    pieces = materialize(pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(SALTS))))
    groups = pieces.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    counts = {int(r[0]): int(r[1]) for r in groups.groupBy("length").agg(F.sum("_n")).collect()}  # at most `capacity` rows
    slots = plan_slots(plan_bins(counts, capacity))
    schema = "length long, _slots array<struct<first:long,uses:long,sequence:long,place:long>>"
    ranges = spark.createDataFrame(list(slots.items()), schema)  # at most `capacity` rows
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = groups.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    order = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = pieces.withColumn("_rank", F.row_number().over(order) - 1).join(bases, ["length", "_salt"])
    ranked = ranked.withColumn("_rank", F.col("_rank") + F.col("_base")).join(F.broadcast(ranges), "length")
    slot = F.element_at("_slots", F.size(F.filter("_slots", lambda s: s["first"] <= F.col("_rank"))))
    placed = ranked.withColumn("_slot", slot).withColumn("_at", F.col("_rank") - F.col("_slot.first"))
    return placed.select(
        *[c for c in pieces.columns if c != "_salt"],
        (F.col("_slot.sequence") + F.floor(F.col("_at") / F.col("_slot.uses"))).cast("long").alias("sequence_id"),
        (F.col("_slot.place") + F.col("length") * F.pmod("_at", F.col("_slot.uses"))).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document."""
    return pack(token_pieces(docs, tokenizer_path, capacity), capacity)


def packed_sequences(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """The sequences themselves: sequence_id, ids, doc_ids and starts of the pieces; each at most capacity ids."""
    placed = pack(token_pieces(docs, tokenizer_path, capacity, with_ids=True), capacity)
    parts = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "start", "ids")))
    return placed.groupBy("sequence_id").agg(parts.alias("_p")).select(
        "sequence_id", F.flatten("_p.ids").alias("ids"), F.col("_p.doc_id").alias("doc_ids"), F.col("_p.start").alias("starts")
    )
