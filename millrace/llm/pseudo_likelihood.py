"""Masked pseudo-likelihood: a small bidirectional window network scores every word from both sides.

Words are hashed to SIDE * SIDE codes. The embeddings of the two words before and after, each scaled by a
vector of its place, are summed through tanh to a hidden vector; the word's code is predicted digit by
digit (the second given the first), which keeps the probabilities proper at little cost. Every partition
trains on all its texts by minibatch steps from one common start; the results are averaged by number of
words, summed FAN_IN at a time in as many rounds as it takes, so no task and not the driver sees more than
FAN_IN parameter vectors, however large the corpus. The result depends on how the texts are partitioned.

A word's probability is its code's, from the network, times its own within the code, from the counts of
all distinct words of the corpus. The counts are a table that grows with the corpus and are joined to the
words of each text; only words that make up 1 / FREQUENT of the corpus or more (so FREQUENT at most) are
broadcast, which keeps them out of the join. In each code one more count stands for words never seen.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.storage import discard, through_table
from millrace.llm.word_bpe import Table
from millrace.llm.words import hash_words, row_slices, text_buffer

SIDE = 64
WIDTH = 16
REACH = 2
BATCH = 1024
RATE = 0.5
EPOCHS = 2
FAN_IN = 16
FREQUENT = 1 << 20
#: Words of a task that are counted together.
COUNTED = 1 << 21
_CODES = SIDE * SIDE
#: Embedding row of places outside the text.
_EDGE = _CODES
_SHAPES = ((_CODES + 1, WIDTH), (2 * REACH, WIDTH), (WIDTH, SIDE), (SIDE,), (SIDE, WIDTH), (WIDTH, SIDE), (SIDE,))
#: Where a place's neighbours stand in a chunk, counted from the first of them.
_SHIFTS = [k for k in range(2 * REACH + 1) if k != REACH]
_SIZES = [int(np.prod(s)) for s in _SHAPES]


def start(seed: int = 1) -> np.ndarray:
    rng = np.random.default_rng(seed)
    parts = [rng.normal(0, 0.1, s) for s in _SHAPES]
    parts[1][:] = 1
    return np.concatenate([p.ravel() for p in parts]).astype(np.float32)


def _views(flat: np.ndarray) -> list[np.ndarray]:
    ends = np.cumsum([0, *_SIZES])
    return [flat[a:b].reshape(s) for a, b, s in zip(ends[:-1], ends[1:], _SHAPES, strict=True)]


def sequence(codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Codes of all texts in one array, with REACH edges before, between and after them."""
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    out = np.full(len(codes) + REACH * len(first), _EDGE, np.uint16)
    out[np.arange(len(codes)) + REACH * (row + 1)] = codes
    return out


def chunks(whole: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """Runs of `size` places of a sequence, each with REACH more on both sides."""
    for a in range(REACH, len(whole) - REACH, size):
        yield whole[a - REACH : min(a + size, len(whole) - REACH) + REACH]


def _hidden(p: list[np.ndarray], codes: np.ndarray) -> tuple[np.ndarray, ...]:
    """Embeddings of a chunk, the places of its words, their codes and hidden vectors."""
    seen = p[0][codes]
    n = len(codes) - 2 * REACH
    z = np.zeros((n, WIDTH), np.float32)
    for k, shift in enumerate(_SHIFTS):
        z += seen[shift : shift + n] * p[1][k]
    middle = codes[REACH : REACH + n]
    words = np.flatnonzero(middle != _EDGE)
    return seen, words, middle[words].astype(np.int64), np.tanh(z[words])


def _exponentials(h: np.ndarray, w: np.ndarray, b: np.ndarray, high: float) -> tuple[np.ndarray, np.ndarray]:
    """Logits less a shift, and their exponentials. Hidden values are at most `high`, so mostly no shift is needed."""
    x = h @ w
    x += b
    if high * float(np.abs(w).sum(axis=0).max()) + float(np.abs(b).max()) > 60:
        x -= x.max(axis=1, keepdims=True)
    return x, np.exp(x)


def step(p: list[np.ndarray], codes: np.ndarray) -> None:
    """One minibatch of gradient descent over a chunk, in place."""
    embed, place, w1, b1, e1, w2, b2 = p
    seen, words, target, h = _hidden(p, codes)
    if not len(words):
        return
    d1, d2 = target // SIDE, target % SIDE
    h2 = h + e1[d1]
    at, high = np.arange(len(target)), 1 + float(np.abs(e1).max())
    g1, g2 = (_exponentials(*x)[1] for x in ((h, w1, b1, 1.0), (h2, w2, b2, high)))
    for g, d in ((g1, d1), (g2, d2)):
        g /= g.sum(axis=1, keepdims=True)
        g[at, d] -= 1
    rate = np.float32(RATE / len(target))
    back2 = g2 @ w2.T
    inner = np.zeros((len(codes) - 2 * REACH, WIDTH), np.float32)
    inner[words] = (g1 @ w1.T + back2) * (1 - h * h)
    for x, gradient in ((w1, h.T @ g1), (b1, g1.sum(axis=0)), (w2, h2.T @ g2), (b2, g2.sum(axis=0))):
        x -= rate * gradient
    _subtract(e1, d1.astype(np.uint16), back2, rate)
    # A place's embedding takes part in the hidden vectors of its neighbours.
    back = np.zeros_like(seen)
    moved = np.empty_like(place)
    for k, shift in enumerate(_SHIFTS):
        back[shift : shift + len(inner)] += inner * place[k]
        moved[k] = np.einsum("nw,nw->w", inner, seen[shift : shift + len(inner)])
    place -= rate * moved
    _subtract(embed, codes, back, rate)


def _subtract(rows: np.ndarray, at: np.ndarray, gradient: np.ndarray, rate: np.float32) -> None:
    """rows[at] -= rate * gradient, with repeated places summed."""
    order = np.argsort(at, kind="stable")
    ordered = at[order]
    first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    rows[ordered[first]] -= rate * np.add.reduceat(gradient[order], first)


def log_probability(p: list[np.ndarray], codes: np.ndarray) -> np.ndarray:
    """Log probability of the code of every word of a chunk, given its neighbours."""
    _, _, target, h = _hidden(p, codes)
    at, d1, d2 = np.arange(len(target)), target // SIDE, target % SIDE
    (x1, y1), (x2, y2) = _exponentials(h, p[2], p[3], 1.0), _exponentials(h + p[4][d1], p[5], p[6], 1 + float(np.abs(p[4]).max()))
    return x1[at, d1] - np.log(y1.sum(axis=1)) + x2[at, d2] - np.log(y2.sum(axis=1))


def _coded(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and code of each word, and the index of each row's first word."""
    hashes, first = hash_words(*text_buffer(batch.column("text")), lower=True)
    return hashes.view(np.int64), (hashes % np.uint64(_CODES)).astype(np.int64), first


def coded(documents: DataFrame) -> DataFrame:
    """A table of (words, codes) for runs of texts, as `sequence` lays them out, and of (h, n), counts of word hashes.

    It is made in one pass and read by `vocabulary` and `train`, so texts are not hashed again for each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def row(words: int, codes: bytes | None, kinds: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
            lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x.astype(np.int64))) for x in (kinds, counts)]
            return pa.RecordBatch.from_arrays([pa.array([words], pa.int64()), pa.array([codes], pa.binary()), *lists], ["words", "codes", "h", "n"])

        none = np.zeros(0, np.int64)
        for whole in batches:
            for batch in row_slices(whole, "text", 1 << 20):
                hashes, codes, first = _coded(batch)
                if len(codes):
                    yield row(len(codes), sequence(codes, first).tobytes(), none, none)
                    held.append(hashes)
                if sum(map(len, held)) > COUNTED:
                    yield row(0, None, *np.unique(np.concatenate(held), return_counts=True))
                    held = []
        if held:
            yield row(0, None, *np.unique(np.concatenate(held), return_counts=True))

    docs = documents.select(F.col("text").cast("string").alias("text")).where("text is not null")
    return through_table(docs.mapInArrow(run, "words long, codes binary, h array<long>, n array<long>"), "coded")


def vocabulary(table: DataFrame) -> DataFrame:
    """(h, n): the hash of every distinct word of a coded table, and how often it occurs."""
    return table.select(F.inline(F.arrays_zip("h", "n"))).groupBy("h").agg(F.sum("n").alias("n"))


def train(table: DataFrame) -> np.ndarray:
    """Parameters after EPOCHS passes over all texts of a coded table."""
    spark = table.sparkSession
    docs = table.select("words", "codes").where("codes is not null")
    flat = start()
    for _ in range(EPOCHS):
        shared = spark.sparkContext.broadcast(flat)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            mine = shared.value.copy()
            p, words = _views(mine), 0
            for batch in batches:
                for n, codes in zip(batch.column("words").to_pylist(), batch.column("codes"), strict=True):
                    for chunk in chunks(np.frombuffer(codes.as_buffer(), np.uint16), BATCH):
                        step(p, chunk)
                    words += n
            if words:
                yield pa.RecordBatch.from_arrays([pa.array([words], pa.int64()), pa.array([(words * mine.astype(np.float64)).tobytes()], pa.binary())], ["n", "flat"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, words = np.zeros(sum(_SIZES)), 0
            for batch in batches:
                for n, data in zip(batch.column("n").to_pylist(), batch.column("flat"), strict=True):
                    total += np.frombuffer(data.as_buffer())
                    words += n
            if words:
                yield pa.RecordBatch.from_arrays([pa.array([words], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["n", "flat"])

        kind = "n long, flat binary"
        sums = docs.mapInArrow(run, kind)
        parts = docs.rdd.getNumPartitions()
        while parts > FAN_IN:
            parts = -(-parts // FAN_IN)
            sums = sums.repartition(parts).mapInArrow(add, kind)
        sums = sums.collect()
        if sums:
            flat = (sum(np.frombuffer(s["flat"]) for s in sums) / sum(s["n"] for s in sums)).astype(np.float32)
    return flat


def score(documents: DataFrame, flat: np.ndarray | None = None, words: DataFrame | None = None) -> DataFrame:
    """doc_id, n_words, pseudo_log_likelihood (sum over words) and its mean per word (null without words).

    `flat` and `words` are the results of train and vocabulary, both made from `documents` where not given.
    A null or empty text scores 0 over no words. Repeated rows are trained on and scored alike; null ids
    pass through; other columns are ignored; an empty table gives an empty result.
    """
    spark = documents.sparkSession
    table = coded(documents) if flat is None or words is None else None
    counted = through_table(vocabulary(table) if words is None else words.select("h", "n"), "vocabulary")
    code = F.col("h").bitwiseAND(_CODES - 1)
    totals = np.zeros(_CODES, np.int64)
    for r in counted.groupBy(code.alias("code")).agg(F.sum("n").alias("n")).collect():
        totals[r["code"]] = r["n"]
    often = sorted((r["h"], r["n"]) for r in counted.where(F.col("n") >= max(1.0, float(totals.sum()) / FREQUENT)).collect())
    known, n = np.array([x[0] for x in often], np.int64), np.array([x[1] for x in often], np.int64)
    own = np.log(n / (totals[known & (_CODES - 1)] + 1))
    shared = spark.sparkContext.broadcast((train(table) if flat is None else flat, known, own))
    if table is not None:
        discard(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, known, own = shared.value
        p = _views(flat.copy())
        places = Table()
        places.add(known.view(np.uint64), np.arange(len(known), dtype=np.int32))
        for whole in batches:
            for batch in row_slices(whole, "text", 1 << 20):
                hashes, codes, first = _coded(batch)
                each = np.concatenate([np.zeros(0)] + [log_probability(p, chunk) for chunk in chunks(sequence(codes, first), 2048)])
                at = places.find(hashes.view(np.uint64))
                rare = at < 0
                each = each + np.append(own, 0.0)[at]
                total = np.diff(np.concatenate(([0.0], np.cumsum(each)))[first])
                # The rest of each row's distinct words, with their counts, for the join.
                row, h = np.repeat(np.arange(len(first) - 1), np.diff(first))[rare], hashes[rare]
                order = np.lexsort((h, row))
                row, h = row[order], h[order]
                start = np.flatnonzero(np.concatenate((np.ones(min(len(h), 1), bool), (h[1:] != h[:-1]) | (row[1:] != row[:-1]))))
                ends = pa.array(np.searchsorted(row[start], np.arange(len(first))).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int64))) for x in (h[start], np.diff(np.append(start, len(h))))]
                columns = [batch.column("r"), batch.column("doc_id"), pa.array(np.diff(first).astype(np.int64)), pa.array(total), *lists]
                yield pa.RecordBatch.from_arrays(columns, ["r", "doc_id", "n_words", "ll", "h", "k"])

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("r"))
    out = through_table(docs.mapInArrow(run, "r long, doc_id long, n_words long, ll double, h array<long>, k array<long>"), "scored")
    sums = spark.createDataFrame([(i, int(t)) for i, t in enumerate(totals)], "code long, total long")
    rare = out.select("r", F.inline(F.arrays_zip("h", "k"))).join(counted, "h", "left").join(F.broadcast(sums), code == F.col("code"))
    rare = rare.groupBy("r").agg(F.sum(F.col("k") * F.log(F.coalesce("n", F.lit(1)) / (F.col("total") + 1))).alias("more"))
    out = out.drop("h", "k").join(rare, "r", "left").select("doc_id", "n_words", (F.col("ll") + F.coalesce("more", F.lit(0.0))).alias("pseudo_log_likelihood"))
    return out.withColumn("mean_log_likelihood", F.when(F.col("n_words") > 0, F.col("pseudo_log_likelihood") / F.col("n_words")))
