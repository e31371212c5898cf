"""Repeated passages by difference-cover anchors.

With D = {0, 1, 4, 14, 16} every residue modulo 21 is a difference of two members, so for any two word
positions some shift below 21 brings both to a position whose residue lies in D. A repeated window of
`length` words therefore holds, at equal shifts, an anchor window of length - 20 words that starts at
a cover position in both places. Only anchors are hashed and counted over the corpus, five in 21
positions; where an anchor occurs more than once, the full windows around it are hashed and counted.

Every distinct text stands once, with the number of its rows as weight, so copies cost nothing. What is
sent back to the texts is not the repeated hashes but the places of the others: a hash of weight one has
a single place, which the grouped sum carries along, so there is no join on hashes, partial sums come
before every shuffle, and a passage that a third of all documents share meets in no single task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.storage import discard, release, through_table
from millrace.llm.words import hash_words, row_slices, text_buffer, window_hashes

PERIOD = 21
COVER = (0, 1, 4, 14, 16)
LENGTH = 35
_IN_COVER = np.isin(np.arange(PERIOD), COVER)


def anchor_positions(n_words: int, width: int) -> np.ndarray:
    """Cover positions of a text at which an anchor window fits."""
    at = np.arange(max(0, n_words - width + 1))
    return at[_IN_COVER[at % PERIOD]]


def candidate_windows(n_words: int, anchors: np.ndarray, length: int) -> np.ndarray:
    """Starts of windows of `length` words that hold one of these anchor windows at a shift below the period."""
    n = n_words - length + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, np.clip(anchors - (PERIOD - 1), 0, n), 1)
    np.add.at(change, np.clip(anchors + 1, 0, n), -1)
    return np.flatnonzero(np.cumsum(change[:n]) > 0)


def covered(n_words: int, starts: np.ndarray, length: int) -> np.ndarray:
    """Which words lie in a window that begins at one of `starts`."""
    change = np.zeros(n_words + 1, np.int64)
    change[starts] += 1
    np.add.at(change, np.minimum(starts + length, n_words), -1)
    return np.cumsum(change[:n_words]) > 0


def _anchors(length: int):
    width = length - PERIOD + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in row_slices(whole, "text", 2 << 20):
                hashes, first = hash_words(*text_buffer(batch.column("text")))
                at = [anchor_positions(int(n), width) for n in np.diff(first)]
                row = np.repeat(np.arange(batch.num_rows), [len(x) for x in at])
                position = np.concatenate(at) if at else np.zeros(0, np.int64)
                anchor = window_hashes(hashes, position + first[row], width)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor.view(np.int64)), batch.column("r").take(take), batch.column("n").take(take), pa.array(position.astype(np.int32))], ["h", "r", "n", "position"]
                )

    return run


def _hits(length: int):
    """Texts with a repeated anchor; `alone` becomes the positions of the repeated ones."""
    width = length - PERIOD + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in row_slices(whole, "text", 2 << 20):
                _, first = hash_words(*text_buffer(batch.column("text")))
                found = [np.setdiff1d(anchor_positions(int(n), width), _ints(alone)) for n, alone in zip(np.diff(first), batch.column("alone"), strict=True)]
                out = pa.RecordBatch.from_arrays([batch.column("r"), batch.column("n"), batch.column("text"), _lists(found)], ["r", "n", "text", "anchors"])
                yield out.filter(pa.array([len(x) > 0 for x in found], pa.bool_()))

    return run


def _ints(value: pa.Scalar) -> np.ndarray:
    return value.values.to_numpy(zero_copy_only=False).astype(np.int64) if value.is_valid else np.zeros(0, np.int64)


def _lists(of: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *(len(x) for x in of)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *of]).astype(np.int32)))


def _windows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in row_slices(whole, "text", 2 << 20):
                hashes, first = hash_words(*text_buffer(batch.column("text")))
                at = [candidate_windows(int(first[i + 1] - first[i]), _ints(batch.column("anchors")[i]), length) for i in range(batch.num_rows)]
                row = np.repeat(np.arange(batch.num_rows), [len(x) for x in at])
                position = np.concatenate(at) if at else np.zeros(0, np.int64)
                sums = [window_hashes(hashes, position + first[row], length, seed).view(np.int64) for seed in (13, 17)]
                sums[1] = sums[1].astype(np.int32)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in sums] + [batch.column("r").take(take), batch.column("n").take(take), pa.array(position.astype(np.int32))], ["h1", "h2", "r", "n", "position"]
                )

    return run


def _cut(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in row_slices(whole, "text"):
                removed, texts = [], []
                for text, anchors, alone in zip(batch.column("text").to_pylist(), batch.column("anchors"), batch.column("alone"), strict=True):
                    words = text.encode().split()
                    starts = np.setdiff1d(candidate_windows(len(words), _ints(anchors), length), _ints(alone), assume_unique=True)
                    gone = covered(len(words), starts, length)
                    removed.append(int(gone.sum()))
                    texts.append(b" ".join(w for w, x in zip(words, gone.tolist(), strict=True) if not x).decode())
                yield pa.RecordBatch.from_arrays([batch.column("r"), pa.array(removed, pa.int64()), pa.array(texts, pa.string())], ["r", "n_removed", "kept_text"])

    return run


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in row_slices(whole, "text"):
            n, digests = [], []
            for text in batch.column("text").to_pylist():
                words = (text or "").encode().split()
                n.append(len(words))
                digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("doc_id", "k1", "k2")] + [pa.array(n, pa.int64()), pa.array(digests, pa.string())], ["doc_id", "k1", "k2", "n_words", "whole_sha256"]
            )


def _keyed(documents: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("k1"), F.hash(text).alias("k2"))


def _alone(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(r, alone): the positions of each text whose hash occurs nowhere else."""
    single = rows.groupBy(*keys).agg(F.sum("n").alias("n"), F.min("r").alias("r"), F.min("position").alias("position")).where("n = 1")
    return single.select("r", "position").repartition("r").groupBy("r").agg(F.collect_list("position").alias("alone"))


def repeated_passages(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """(k1, k2, n_removed, kept_text) for each distinct text that loses words; see `without_repeats`.

    Texts and windows are known by 96 bits each, anchors by 64: an anchor that another one happens to
    share a hash with merely has its windows tried as well.
    """
    if length <= PERIOD:
        raise ValueError(f"windows must be longer than {PERIOD} words")
    texts = _keyed(documents).where("text is not null").groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n"), F.first("text").alias("text"))
    texts = through_table(texts.withColumn("r", F.monotonically_increasing_id()), "texts")
    release(documents.sparkSession)
    anchors = texts.select("r", "n", "text").mapInArrow(_anchors(length), "h long, r long, n long, position int")
    alone = through_table(_alone(anchors, ["h"]), "anchors")
    release(documents.sparkSession)
    hit = texts.select("r", "n", "text").join(alone, "r", "left").mapInArrow(_hits(length), "r long, n long, text string, anchors array<int>")
    hit = through_table(hit, "hit")
    discard(alone)

    windows = hit.mapInArrow(_windows(length), "h1 long, h2 int, r long, n long, position int")
    alone = through_table(_alone(windows, ["h1", "h2"]), "windows")
    release(documents.sparkSession)
    lost = hit.select("r", "text", "anchors").join(alone, "r", "left").mapInArrow(_cut(length), "r long, n_removed long, kept_text string").where("n_removed > 0")
    return lost.join(texts.select("r", "k1", "k2"), "r").select("k1", "k2", "n_removed", "kept_text")


def without_repeats(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 per document.

    Words are `[^\\x20\\x09-\\x0D]+`. Every word goes that lies in a window of `length` words whose sequence
    also starts at another place of the corpus, the same document and copies included; the windows are
    those of the input. kept_sha256 is over the remaining words joined by one space. A null or empty
    text has no words; texts shorter than the window lose nothing. Each row counts as a document of its
    own: a repeated row is a copy, and a null or repeated doc_id is carried through. Other columns are
    ignored.
    """
    lost = repeated_passages(documents, length).select("k1", "k2", "n_removed", F.sha2("kept_text", 256).alias("kept"))
    whole = _keyed(documents).select("doc_id", "k1", "k2", "text").mapInArrow(_whole, "doc_id long, k1 long, k2 int, n_words long, whole_sha256 string")
    return whole.join(lost, ["k1", "k2"], "left").select(
        "doc_id", "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("kept", "whole_sha256").alias("kept_sha256")
    )
