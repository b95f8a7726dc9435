"""Byte-level BPE encoding and decoding.

Merges run over a segment tree: leaf i holds the rank of the pair that starts at byte position i,
inner nodes hold the leftmost minimum, so each merge is a root lookup and three logarithmic point
updates (the merged pair, its live left neighbour, the dead right one). A piece of n bytes costs
O(n log n), which also holds for a megabyte without a space.

Texts never meet: encoding is a map over partitions without a shuffle, and a task holds one Arrow
batch of texts and a bounded cache of pieces.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import append_column

#: Fixed value: the pattern that splits text before merges, as published with the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Fixed value: Unicode white space. Python's own \s adds U+001C..U+001F, which the pattern's does not hold.
SPACE = "\t-\r \x85\xa0  -     　"

#: A piece never spans the border between a non-space run (with one blank before it) and what follows,
#: so texts are cut into such runs first and runs are looked up in a cache.
_RUNS = re.compile(rf" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
_PIECES = regex.compile(PATTERN)

#: Most entries of a worker's cache, and the longest run that it keeps.
CACHE_ENTRIES, CACHE_CHARS = 700_000, 48

#: Texts are encoded in groups of about so many characters; new pieces of up to so many bytes go through
#: MergeForest, so many at a time, longer ones through MergeTree.
GROUP_CHARS, FOREST_BYTES, FOREST_PIECES = 2_000_000, 64, 8192


class MergeTree:
    """Segment tree over byte positions with the leftmost minimum pair rank at its root."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.none = len(ranks) + 1

    def encode(self, piece: bytes) -> tuple[int, ...]:
        ranks = self.ranks
        if piece in ranks:
            return (ranks[piece],)
        n = len(piece)
        parts: list[bytes] = [piece[i : i + 1] for i in range(n)]
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        size = 1 << (n - 1).bit_length()
        dead = self.none * n
        # rank * n + position: the least key is the least rank and, among equals, the leftmost
        get, none = ranks.get, self.none
        tree = [dead] * (2 * size)
        for i in range(n - 1):
            tree[size + i] = get(piece[i : i + 2], none) * n + i
        for i in range(size - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b

        def put(at: int, key: int) -> None:
            at += size
            tree[at] = key
            at >>= 1
            while at:
                a, b = tree[2 * at], tree[2 * at + 1]
                least = a if a < b else b
                if tree[at] == least:
                    return
                tree[at] = least
                at >>= 1

        while (key := tree[1]) < dead:
            i = key % n
            j = right[i]
            parts[i] += parts[j]
            parts[j] = b""
            k = right[i] = right[j]
            put(j, dead)
            if k < n:
                left[k] = i
                put(i, get(parts[i] + parts[k], none) * n + i)
            else:
                put(i, dead)
            if (h := left[i]) >= 0:
                put(h, get(parts[h] + parts[i], none) * n + h)
        return tuple(ranks[p] for p in parts if p)


class MergeForest:
    """MergeTree for many short pieces at once: one column per piece, one row per tree node.

    All pieces take their leftmost cheapest merge in the same step, so the steps are numpy calls.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.none = max(ranks.values()) + 1
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        known, merged = [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    known.append(a * self.none + b)
                    merged.append(rank)
        order = np.argsort(known)
        self.known, self.merged = np.array(known)[order], np.array(merged, np.int64)[order]

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the token that a pair of ids makes, or `none`."""
        key = a * self.none + b
        at = np.minimum(np.searchsorted(self.known, key), len(self.known) - 1)
        return np.where(self.known[at] == key, self.merged[at], self.none)

    def encode(self, pieces: list[bytes], size: int) -> list[list[int]]:
        """Ids of pieces of 2 to `size` bytes each; size is a power of two."""
        m = len(pieces)
        n = np.fromiter(map(len, pieces), np.int64, m)
        place = np.arange(size)[:, None]
        held = place < n
        raw = np.frombuffer(b"".join(p.ljust(size, b"\0") for p in pieces), np.uint8).reshape(m, size).T
        ids = np.where(held, self.byte_id[raw], -1)
        right = np.broadcast_to(place + 1, (size, m)).copy()
        left = right - 2
        dead = self.none * size
        tree = np.full((2 * size, m), dead, np.int64)
        pair = held[1:]
        first = np.broadcast_to(place[:-1], pair.shape)[pair]
        ranks = self.rank(ids[:-1][pair], ids[1:][pair])
        tree[size:-1][pair] = np.where(ranks < self.none, ranks * size + first, dead)
        for i in range(size - 1, 0, -1):
            np.minimum(tree[2 * i], tree[2 * i + 1], out=tree[i])

        def put(at: np.ndarray, key: np.ndarray | int, col: np.ndarray) -> None:
            at = at + size
            tree[at, col] = key
            while at[0] > 1:  # all leaves are on one level
                at = at >> 1
                tree[at, col] = np.minimum(tree[2 * at, col], tree[2 * at + 1, col])

        col = np.flatnonzero(tree[1] < dead)
        while len(col):
            key = tree[1, col]
            i = key % size
            ids[i, col] = key // size
            j = right[i, col]
            k = right[j, col]
            right[i, col] = k
            ids[j, col] = -1
            put(j, dead, col)
            inner = k < n[col]
            left[np.where(inner, k, j), col] = i
            follow = self.rank(ids[i, col], np.where(inner, ids[np.minimum(k, size - 1), col], 0))
            put(i, np.where(inner & (follow < self.none), follow * size + i, dead), col)
            has = np.flatnonzero(left[i, col] >= 0)
            if len(has):
                c, h = col[has], left[i[has], col[has]]
                before = self.rank(ids[h, c], ids[i[has], c])
                put(h, np.where(before < self.none, before * size + h, dead), c)
            col = col[tree[1, col] < dead]
        cut = np.cumsum((ids >= 0).sum(axis=0))[:-1]
        flat = ids.T[ids.T >= 0].tolist()
        return [flat[a:b] for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(flat)])]


class Codec:
    """Encoder and decoder for one rank file. Pieces and runs of pieces are kept in one bounded cache."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.tokens = dict(zip(self.ranks.values(), self.ranks.keys()))
        self.decimals = {i: str(i) for i in self.tokens}
        self.shared = {i: i for i in self.tokens}
        self.tree, self.forest = MergeTree(self.ranks), MergeForest(self.ranks)
        self.cache: dict[str, tuple[int, ...]] = {}

    def _pieces(self, pieces: set[str]) -> dict[str, tuple[int, ...]]:
        done: dict[str, tuple[int, ...]] = {}
        by_size: dict[int, tuple[list[str], list[bytes]]] = {}
        for piece in pieces:
            data = piece.encode()
            if (known := self.ranks.get(data)) is not None:
                done[piece] = (known,)
            elif len(data) <= FOREST_BYTES:
                names, datas = by_size.setdefault(max(8, 1 << (len(data) - 1).bit_length()), ([], []))
                names.append(piece)
                datas.append(data)
            else:
                done[piece] = self.tree.encode(data)
        for size, (names, datas) in by_size.items():
            for at in range(0, len(names), FOREST_PIECES):
                for piece, ids in zip(names[at : at + FOREST_PIECES], self.forest.encode(datas[at : at + FOREST_PIECES], size)):
                    done[piece] = tuple(map(self.shared.__getitem__, ids))
        return done

    def encode(self, texts: list[str | None]) -> Iterator[list[int]]:
        """Ids of each text; null and empty texts have none."""
        for group in _groups(texts):
            gc.disable()  # only tuples of integers are made here; scanning them for cycles costs a third of the time
            runs = [_RUNS.findall(text) if text else [] for text in group]
            new = set(chain.from_iterable(runs)).difference(self.cache)
            split = {run: _PIECES.findall(run) for run in new}
            missing = {piece for found in split.values() for piece in found}
            pieces = {p: ids for p in missing if (ids := self.cache.get(p)) is not None}
            pieces |= self._pieces(missing.difference(pieces))
            own = {run: tuple(chain.from_iterable(map(pieces.__getitem__, found))) for run, found in split.items()}
            if len(self.cache) + len(own) + len(pieces) > CACHE_ENTRIES:
                seen = {run: self.cache[run] for run in set(chain.from_iterable(runs)).intersection(self.cache)}
                self.cache.clear()
                own |= seen
            self.cache |= pieces
            self.cache |= own
            gc.enable()
            for row in runs:
                yield list(chain.from_iterable(map(self.cache.__getitem__, row)))
            for x in [x for x in chain(pieces, own) if len(x) > CACHE_CHARS]:
                self.cache.pop(x, None)

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def digest(self, ids: list[int]) -> str:
        return hashlib.sha256(" ".join(map(self.decimals.__getitem__, ids)).encode()).hexdigest()


def _groups(texts) -> Iterator[list[str | None]]:
    """Texts in order, in groups of about GROUP_CHARS."""
    group, chars = [], 0
    for text in texts:
        group.append(text)
        chars += len(text or "")
        if chars >= GROUP_CHARS:
            yield group
            group, chars = [], 0
    if group:
        yield group


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One codec for each rank file and Python worker."""
    return Codec(path)


def encode_documents(docs: DataFrame, ranks_path: str, text: str = "text", out: str = "token_ids") -> DataFrame:
    """docs with the ids of its text column as array<int>. Null and empty texts give an empty array;
    a column that is already called `out` is replaced, all others stay."""
    return append_column(docs, text, out, pa.list_(pa.int32()), "array<int>", lambda: lambda texts: list(codec(ranks_path).encode(texts)))


def decode_documents(docs: DataFrame, ranks_path: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """docs with the bytes of its id column as binary; null ids give null."""
    return append_column(docs, ids, out, pa.binary(), "binary", lambda: lambda rows: [None if x is None else codec(ranks_path).decode(x) for x in rows])


def round_trip(docs: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every text: encoded, then decoded from the ids.

    Null text counts as empty; repeated rows give repeated results; other columns are not read, so
    their names can't clash. Digests are taken where the ids are, so ids never leave the worker.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks_path)
        for batch in batches:
            sizes, digests, decoded = [], [], []
            for ids in own.encode(batch.column("text").to_pylist()):
                sizes.append(len(ids))
                digests.append(own.digest(ids))
                decoded.append(hashlib.sha256(own.decode(ids)).hexdigest())
            columns = [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    own = docs.select(F.col("doc_id").cast("long"), "text")
    return own.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
