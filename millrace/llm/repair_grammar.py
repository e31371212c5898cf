"""Token ids in files, compressed by Re-Pair grammars with random access.

Documents are dealt into ranges of doc_id, encoded, and cut at document ends into shards of SHARD_IDS ids
and the rest of the last document. In each shard frequent pairs of neighbouring symbols are replaced by
nonterminals, round after round: a round counts the pairs that may have become frequent, lets the more
frequent win where two overlap, and keeps those that still occur MIN_COUNT times, until there are none. A shard's record holds the rules, the
expansion lengths and the remaining sequence, so a document is decoded from the symbols that cover it
alone. Records are Parquet rows, so any store that Spark reads will do and a lost task is just run again.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.storage import through_table
from millrace.llm.word_bpe import Encoder
from millrace.llm.words import row_slices

SHARD_IDS = 1 << 20
#: A rule takes three numbers and saves one with each use, so it pays from the fourth use on.
MIN_COUNT = 4
END = 2
_STEP = np.uint64(0x9E3779B97F4A7C15)
RANGE_BYTES = 32 << 20


#: A worker's encoders by file.
_encoders: dict[str, Encoder] = {}


def _kinds(pair: np.ndarray, seed: int, exact: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(kind of each pair, pair of each kind, count of each kind, whether a pair is its kind's).

    Kinds are hash slots, each held by one of the pairs that fall into it; the others wait for another seed.
    Only `exact` kinds, by a sort, show that no frequent pair is left.
    """
    if exact:
        pairs, kind, counts = np.unique(pair, return_inverse=True, return_counts=True)
        return kind, pairs, counts, np.ones(len(pair), bool)
    bits = max(8, int(2 * len(pair)).bit_length() - 1)
    with np.errstate(over="ignore"):
        kind = ((pair * (_STEP + np.uint64(2 * seed))) >> np.uint64(64 - bits)).astype(np.int32)
    holder = np.empty(1 << bits, np.uint64)
    holder[kind] = pair
    own = holder[kind] == pair
    return kind, holder, np.bincount(kind[own], minlength=1 << bits), own


def compress(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(sequence, rules of two symbols each, first nonterminal) of an id array."""
    n = len(ids)
    sequence = np.append(ids.astype(np.uint32), np.uint32(0))
    base = symbols = int(ids.max()) + 1 if n else 1
    rules = [np.zeros((0, 2), np.uint32)]
    after, before = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
    live = np.ones(n + 1, bool)
    live[n] = False
    # Places whose pair may still be frequent: later on only a pair beside a replacement can become so.
    active = np.arange(max(0, n - 1), dtype=np.int32)
    seed, exact = 0, False
    while len(active):
        follow = after[active]
        pair = sequence[active].astype(np.uint64)
        pair <<= np.uint64(32)
        pair |= sequence[follow]
        kind, pairs, counts, own = _kinds(pair, seed, exact)
        here = counts[kind]
        often = here >= MIN_COUNT
        seed += 1
        at = np.flatnonzero(often & own)
        # The more frequent of two overlapping pairs wins, then left to right within runs of one pair.
        rank = (here[at].astype(np.int64) << 32) | kind[at]
        beside = follow[at[:-1]] == active[at[1:]]
        win = np.ones(len(at), bool)
        win[1:] &= ~beside | (rank[1:] >= rank[:-1])
        win[:-1] &= ~beside | (rank[:-1] >= rank[1:])
        run = np.zeros(len(at), bool)
        run[1:] = beside & win[1:] & win[:-1]
        place = np.arange(len(at))
        win &= (place - np.maximum.accumulate(np.where(run, 0, place))) % 2 == 0
        at = at[win]
        good = np.bincount(kind[at], minlength=len(counts)) >= MIN_COUNT
        at = at[good[kind[at]]]
        if not len(at):
            if exact:
                break
            exact = True
            continue
        exact = False
        left, right = active[at], follow[at]
        beyond = after[right]
        chosen = np.flatnonzero(good)
        number = np.zeros(len(counts), np.uint32)
        number[chosen] = np.arange(symbols, symbols + len(chosen), dtype=np.uint32)
        sequence[left] = number[kind[at]]
        live[right] = False
        after[left] = beyond
        before[beyond] = left
        # What was frequent or undecided, and what now stands beside a new symbol.
        mark = np.zeros(n + 1, bool)
        mark[active[often | ~own]] = True
        mark[left] = True
        mark[np.maximum(before[left], 0)] = True
        mark &= live
        active = np.flatnonzero(mark).astype(np.int32)
        if len(active) and after[active[-1]] >= n:
            active = active[:-1]
        rules.append(np.stack([pairs[chosen] >> np.uint64(32), pairs[chosen] & np.uint64(0xFFFFFFFF)], 1).astype(np.uint32))
        symbols += len(chosen)
    return sequence[live], np.concatenate(rules), base


def expansion_lengths(rules: np.ndarray, base: int) -> np.ndarray:
    """Number of ids below each rule; a rule only refers to earlier ones."""
    out = np.ones(len(rules), np.int64)
    for i, (a, b) in enumerate(rules.tolist()):
        out[i] = (out[a - base] if a >= base else 1) + (out[b - base] if b >= base else 1)
    return out


def pack(ids: np.ndarray) -> bytes:
    sequence, rules, base = compress(ids)
    head = np.array([base, len(rules), len(sequence)], "<u4")
    return head.tobytes() + rules.astype("<u4").tobytes() + expansion_lengths(rules, base).astype("<u4").tobytes() + sequence.astype("<u4").tobytes()


class Shard:
    """A packed shard: ids between any two places."""

    def __init__(self, data: bytes):
        self.base, n, m = np.frombuffer(data, "<u4", 3).tolist()
        self.rules = np.frombuffer(data, "<u4", 2 * n, 12).reshape(n, 2)
        lengths = np.frombuffer(data, "<u4", n, 12 + 8 * n)
        self.sequence = np.frombuffer(data, "<u4", m, 12 + 12 * n)
        inner = self.sequence >= self.base
        size = np.ones(m, np.int64)
        size[inner] = lengths[self.sequence[inner] - self.base]
        self.starts = np.concatenate(([0], np.cumsum(size)))
        # All rules written out one after another, by halves until no nonterminal is left.
        self.begin = np.concatenate(([0], np.cumsum(lengths.astype(np.int64))))
        part = self.rules.ravel()
        while (inner := part >= self.base).any():
            out = np.repeat(part, np.where(inner, 2, 1))
            at = np.flatnonzero(inner) + np.arange(int(inner.sum()))
            out[at], out[at + 1] = self.rules[part[inner] - self.base].T
            part = out
        self.text = part

    def ids(self, start: int, stop: int) -> np.ndarray:
        if stop <= start:
            return np.zeros(0, np.uint32)
        a = int(np.searchsorted(self.starts, start, "right")) - 1
        b = int(np.searchsorted(self.starts, stop, "left"))
        part, ends = self.sequence[a:b], self.starts[a + 1 : b + 1] - self.starts[a]
        inner = part >= self.base
        size = np.diff(ends, prepend=0)
        # Terminals are found behind the written-out rules.
        source = len(self.text) + np.arange(len(part))
        source[inner] = self.begin[part[inner] - self.base]
        out = np.concatenate((self.text, part))[np.repeat(source - (ends - size), size) + np.arange(int(ends[-1]))]
        skip = start - int(self.starts[a])
        return out[skip : skip + stop - start]


def write(documents: DataFrame, path: str) -> DataFrame:
    """Shard records (range, shard, payload, doc_ids, counts) in ascending doc_id order, as stored.

    A null or empty text is the end id alone; null doc_ids come first; repeated rows are documents of
    their own; other columns are ignored; an empty table gives no record.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _encoders:
            _encoders[path] = Encoder(path)
        place, shard, parts, names, counts, held = None, 0, [], [], [], 0

        def flush() -> pa.RecordBatch:
            lists = [pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), pa.array(x, pa.int64())) for x in (names, counts)]
            return pa.RecordBatch.from_arrays(
                [pa.array([place], pa.int32()), pa.array([shard], pa.int32()), pa.array([pack(np.concatenate(parts))], pa.binary()), *lists], ["range", "shard", "payload", "doc_ids", "counts"]
            )

        for whole in batches:
            for batch in row_slices(whole, "text", 1 << 20):
                ids, sizes = _encoders[path].encode_column(batch.column("text"), END)
                place = batch.column("range")[0].as_py()
                stops = np.cumsum(sizes)
                row, begin = 0, 0
                while row < len(sizes):
                    # Documents up to the one that fills the shard.
                    stop = min(int(np.searchsorted(stops, begin + SHARD_IDS - held)) + 1, len(sizes))
                    parts.append(ids[begin : stops[stop - 1]])
                    names += batch.column("doc_id")[row:stop].to_pylist()
                    counts += sizes[row:stop].tolist()
                    held += len(parts[-1])
                    row, begin = stop, int(stops[stop - 1])
                    if held >= SHARD_IDS:
                        yield flush()
                        shard, parts, names, counts, held = shard + 1, [], [], [], 0
        if counts:
            yield flush()

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    dealt = docs.repartitionByRange(max(1, -(-size // RANGE_BYTES)), F.asc_nulls_first("doc_id")).sortWithinPartitions(F.asc_nulls_first("doc_id"), "text")
    dealt = dealt.withColumn("range", F.spark_partition_id())
    return through_table(dealt.mapInArrow(run, "range int, shard int, payload binary, doc_ids array<long>, counts array<long>"), "ids")


def read(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 for every document of the stored shards.

    Every record gives its documents' rows, null and repeated doc_ids included; no record gives no row.
    `Shard.ids` decodes single documents; here each shard is decoded once, as all of it is read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                shard = Shard(batch.column("payload")[i].as_py())
                counts = np.array(batch.column("counts")[i].as_py(), np.int64)
                ends = np.cumsum(counts)
                ids = memoryview(shard.ids(0, int(counts.sum())).astype("<u4").tobytes())
                crc = [zlib.crc32(ids[4 * (e - c) : 4 * e]) for e, c in zip(ends.tolist(), counts.tolist(), strict=True)]
                n = len(counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column(c)[i].as_py()] * n, pa.int32()) for c in ("range", "shard")]
                    + [pa.array(batch.column("doc_ids")[i].as_py(), pa.int64()), pa.array(ends - counts), pa.array(counts), pa.array(crc, pa.int64())],
                    ["range", "shard", "doc_id", "local", "n_tokens", "ids_crc32"],
                )

    totals = shards.select("range", "shard", F.expr("aggregate(counts, 0L, (a, x) -> a + x)").alias("n"))
    # A row for each range only, however many documents there are.
    ranges = totals.groupBy("range").agg(F.sum("n").alias("n")).select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("range_start"))
    inner = totals.select("range", "shard", (F.sum("n").over(Window.partitionBy("range").orderBy("shard")) - F.col("n")).alias("shard_start"))
    starts = inner.join(ranges, "range").select("range", "shard", (F.col("range_start") + F.col("shard_start")).alias("before"))
    docs = shards.mapInArrow(run, "range int, shard int, doc_id long, local long, n_tokens long, ids_crc32 long")
    return docs.join(starts, ["range", "shard"]).select("doc_id", (F.col("before") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")
