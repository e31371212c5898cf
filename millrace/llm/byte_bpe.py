"""Byte-level BPE with two tiers: a minimal perfect hash for whole pre-tokens, a heap for the rest.

The vocabulary's byte strings are placed by hash and displace: keys fall into buckets of four on
average, buckets are placed largest first, each with the first displacement that sends its keys to
free slots, and buckets of one key name their slot outright. There are as many slots as keys. A
pre-token whose slot holds its own bytes is one id. Any other is merged from single bytes: links
between neighbouring parts and a heap of (rank, position), so a pre-token of n bytes costs n log n.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.words import row_slices

#: Distinct pre-tokens a worker remembers, and the longest that it does; results do not depend on either.
MEMORY = 500_000
LONGEST_KEPT = 64
_STEP, _MIX, _MASK = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, (1 << 64) - 1


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: one base64 byte string and its rank a line."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


class PerfectHash:
    """A minimal perfect hash from byte strings to 0..n-1, which also tells strangers from keys."""

    def __init__(self, keys: Iterable[bytes]):
        keys = list(keys)
        self.n = n = len(keys)
        self.buckets = max(1, n // 4)
        self.slots: list[bytes | None] = [None] * n
        self.move = [0] * self.buckets
        members: list[list[int]] = [[] for _ in range(self.buckets)]
        hashed = [xxhash.xxh3_64_intdigest(k) for k in keys]
        for i, h in enumerate(hashed):
            members[h % self.buckets].append(i)
        free = np.ones(n, bool)
        order = sorted(range(self.buckets), key=lambda b: -len(members[b]))
        alone = []
        for b in order:
            if len(members[b]) < 2:
                alone += [b] * len(members[b])
                continue
            h = np.array([hashed[i] for i in members[b]], np.uint64)
            if len(np.unique(h)) < len(h):
                raise ValueError("two keys share a hash")
            d = 0
            while True:
                tries = np.arange(d, d + 256, dtype=np.uint64)[:, None]
                at = self._places(h, tries)
                good = free[at].all(axis=1)
                if good.any():
                    for k in np.flatnonzero(good):
                        if len(set(at[k].tolist())) == len(h):
                            break
                    else:
                        d += 256
                        continue
                    free[at[k]] = False
                    self.move[b] = d + int(k)
                    for i, slot in zip(members[b], at[k].tolist(), strict=True):
                        self.slots[slot] = keys[i]
                    break
                d += 256
        for b, slot in zip(alone, np.flatnonzero(free).tolist(), strict=True):
            self.move[b] = -1 - slot
            self.slots[slot] = keys[members[b][0]]

    def _places(self, h: np.ndarray, move: np.ndarray) -> np.ndarray:
        x = h + move * np.uint64(_STEP)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(_MIX)
        return ((x ^ (x >> np.uint64(29))) % np.uint64(self.n)).astype(np.int64)

    def find(self, key: bytes) -> int:
        """The key's slot, or -1 for a stranger."""
        if not self.n:
            return -1
        h = xxhash.xxh3_64_intdigest(key)
        move = self.move[h % self.buckets]
        if move < 0:
            slot = -1 - move
        else:
            x = (h + move * _STEP) & _MASK
            x = ((x ^ (x >> 32)) * _MIX) & _MASK
            slot = (x ^ (x >> 29)) % self.n
        return slot if self.slots[slot] == key else -1


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a byte string by repeated merges of the neighbouring pair of lowest rank, leftmost first."""
    n = len(piece)
    parts: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    rank = [ranks.get(piece[i : i + 2], -1) for i in range(n - 1)] + [-1]
    heap = [(r, i) for i, r in enumerate(rank) if r >= 0]
    heapq.heapify(heap)
    while heap:
        r, i = heapq.heappop(heap)
        if rank[i] != r:
            continue
        j = after[i]
        joined = parts[i] = parts[i] + parts[j]
        parts[j], rank[j] = None, -1
        k = after[i] = after[j]
        rank[i] = -1
        if k < n:
            before[k] = i
            rank[i] = r = ranks.get(joined + parts[k], -1)
            if r >= 0:
                heapq.heappush(heap, (r, i))
        p = before[i]
        if p >= 0:
            rank[p] = r = ranks.get(parts[p] + joined, -1)
            if r >= 0:
                heapq.heappush(heap, (r, p))
    return [ranks[p] for p in parts if p is not None]


class _Memory(dict):
    """Pre-token to ids, in two generations: one that is met again moves to the younger, the older goes when that is full."""

    def __init__(self, codec: Codec):
        super().__init__()
        self.codec = codec
        self.older: dict[str, tuple[int, ...]] = {}

    def __missing__(self, token: str) -> tuple[int, ...]:
        ids = self.older.get(token)
        if ids is None:
            ids = self.codec.piece(token.encode())
        if len(token) <= LONGEST_KEPT:
            if len(self) >= MEMORY // 2:
                self.older = dict(self)
                self.clear()
            self[token] = ids
        return ids


class Codec:
    """Encodes texts to ids and decodes ids to bytes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, table: PerfectHash | None = None):
        self.ranks, self.pattern = ranks, pattern
        self.table = table or PerfectHash(ranks)
        self.id_of_slot = [ranks[key] for key in self.table.slots]
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        size = max(ranks.values(), default=-1) + 1
        self.width = np.full(size, -1, np.int64)
        self.width[list(ranks.values())] = [len(token) for token in ranks]
        self.begin = np.concatenate(([0], np.cumsum(np.maximum(self.width, 0))))
        self.blob = np.frombuffer(b"".join(self.bytes_of.get(i, b"") for i in range(size)), np.uint8)
        self.split = regex.compile(pattern)
        self.memory = _Memory(self)

    def __reduce__(self):
        return Codec, (self.ranks, self.pattern, self.table)

    def piece(self, piece: bytes) -> tuple[int, ...]:
        slot = self.table.find(piece)
        return (self.id_of_slot[slot],) if slot >= 0 else tuple(merge(piece, self.ranks))

    def encode(self, text: str) -> np.ndarray:
        return np.fromiter(chain.from_iterable(map(self.memory.__getitem__, self.split.findall(text))), np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the ids one after another; an id without bytes is a KeyError."""
        ids = np.asarray(ids, np.int64)
        out = []
        for part in np.array_split(ids, max(1, -(-len(ids) // (1 << 18)))):
            if len(part) and not (0 <= part.min() and part.max() < len(self.width) and self.width[part].min() > 0):
                raise KeyError("an id outside the vocabulary")
            width = self.width[part]
            ends = np.cumsum(width)
            out.append(self.blob[np.repeat(self.begin[part] - (ends - width), width) + np.arange(int(width.sum()))].tobytes())
        return b"".join(out)


_codecs: dict[tuple[str, str], Codec] = {}


def load_codec(path: str, pattern: str) -> Codec:
    """The codec of a rank file, built once in a process."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(read_ranks(path), pattern)
    return _codecs[path, pattern]


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int32), pa.int32()))


def encode(documents: DataFrame, path: str, pattern: str, with_decoded: bool = False) -> DataFrame:
    """doc_id and the ids of each text (array<int>); with_decoded adds the bytes decoded from those ids.

    Every match of the pattern is encoded by itself, special tokens are ordinary text. A null or empty
    text gives an empty array. Rows are independent: repeated rows and null doc_ids pass through, other
    columns are ignored, an empty table gives an empty result.
    """
    shared = documents.sparkSession.sparkContext.broadcast(load_codec(path, pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared.value
        for whole in batches:
            for batch in row_slices(whole, "text", 1 << 20):
                ids = [codec.encode(text or "") for text in batch.column("text").to_pylist()]
                columns = [batch.column("doc_id"), _lists(ids)]
                if with_decoded:
                    columns.append(pa.array([codec.decode(x) for x in ids], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "decoded"][: len(columns)])

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, ids array<int>" + ", decoded binary" * with_decoded)


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and the bytes of each row's ids; null ids are empty, an id outside the vocabulary is an error."""
    shared = encoded.sparkSession.sparkContext.broadcast(load_codec(path, pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([shared.value.decode(np.array(x or (), np.int64)) for x in batch.column("ids").to_pylist()], pa.binary())], ["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded binary")


def round_trip(documents: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (decimal ids joined by commas) and decoded_sha256 (the decoded bytes)."""
    return encode(documents, path, pattern, with_decoded=True).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
