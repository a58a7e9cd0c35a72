"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader updates.

A token is a word (letters and digits), or a run of other marks. Features are hashes of tokens, of token pairs, of
token shapes (letter classes and length) and shape pairs, and of "same as the token before". A text's vector is the
square root of its relative feature counts; its score is the logistic of one sparse dot product.

Training looks at a bounded sample of labelled rows (``sample_rows``, those with the smallest hash of their id) and
is sequential, as the method is. Scoring looks at every whole text and moves no row.

Empty and null texts have no features and get the score of the bias. Without any labelled row every score is 0.5.
Repeated rows get equal scores; an empty table gives an empty result; a kept column named like a result is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from transitlapse.llm import scan

BITS = 18
SAMPLE_ROWS = 6_000
THRESHOLD = 0.3

_BYTES = np.arange(256)
_ALNUM = np.isin(_BYTES, list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")) | (_BYTES >= 128)
_SPACE = np.isin(_BYTES, list(b" \t\n\x0b\x0c\r"))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_CLASS = np.select([np.isin(_BYTES, list(b"0123456789")), _ALNUM & (_BYTES >= ord("A")), _ALNUM], [2, 1, 1], _BYTES + 10)


def features(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every feature occurrence of a chunk and the row it belongs to, by row."""
    word = scan.words(buf, offsets, _ALNUM)
    mark = scan.words(buf, offsets, ~_ALNUM & ~_SPACE)
    start = np.concatenate([word[0], mark[0]])
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.concatenate([word[1], mark[1]])[order]
    row = np.searchsorted(offsets, start, "right") - 1
    token = scan.Prefix(scan.BYTE_VALUES[_LOWER[buf]]).window(start, end)
    # Shape: the class of the first byte and the length, long ones alike.
    shape = scan.mix(_CLASS[buf[start]].astype(np.uint64) * np.uint64(64) + np.minimum(end - start, 24).astype(np.uint64), 3)
    found, rows = [scan.mix(token, 5), scan.mix(shape, 7)], [row, row]
    if len(row) > 1:
        pair = np.flatnonzero(row[1:] == row[:-1])
        same = np.where(token[pair] == token[pair + 1], np.uint64(1), np.uint64(2))
        for x in (scan.mix(token[pair] * np.uint64(3) + token[pair + 1], 9),
                  scan.mix(shape[pair] * np.uint64(3) + shape[pair + 1], 11), scan.mix(same, 13)):
            found.append(x)
            rows.append(row[pair])
    found, rows = np.concatenate(found) >> np.uint64(64 - BITS), np.concatenate(rows)
    order = np.argsort(rows, kind="stable")
    return found[order].astype(np.int64), rows[order]


def vectors(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, bucket and value of the non-zero entries of a chunk's text vectors."""
    bucket, row = features(buf, offsets)
    key, count = np.unique((row.astype(np.int64) << BITS) | bucket, return_counts=True)
    row, bucket = key >> BITS, key & ((1 << BITS) - 1)
    total = np.bincount(row, weights=count, minlength=len(offsets) - 1)
    return row, bucket, np.sqrt(count / total[row]).astype(np.float32)


@dataclass
class FollowTheLeader:
    """Per-coordinate updates with L1 and L2 regularisation; a weight is worked out from its sums when it is used."""

    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.5
    z: np.ndarray = field(default_factory=lambda: np.zeros((1 << BITS) + 1))
    n: np.ndarray = field(default_factory=lambda: np.zeros((1 << BITS) + 1))

    def weight(self, at) -> np.ndarray:
        z = self.z[at]
        rate = (self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / rate)

    def learn(self, at: np.ndarray, value: np.ndarray, label: float) -> None:
        w = self.weight(at)
        g = (1 / (1 + np.exp(-np.clip(w @ value, -30, 30))) - label) * value
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def _vector_column(column: pa.Array) -> list[pa.Array]:
    at, value = [], []
    for _, _, buf, offsets in scan.chunks(column):
        row, bucket, x = vectors(buf, offsets)
        cut = np.searchsorted(row, np.arange(len(offsets)))
        at += [bucket[a:b].astype("<i4").tobytes() for a, b in zip(cut[:-1], cut[1:])]
        value += [x[a:b].astype("<f4").tobytes() for a, b in zip(cut[:-1], cut[1:])]
    return [pa.array(at, pa.binary()), pa.array(value, pa.binary())]


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, epochs: int = 6, seed: int = 7) -> np.ndarray:
    """Weights by bucket, the bias last, from ``docs`` (doc_id, text) with ``labels`` (doc_id, quality 0 or 1).

    ``sample_rows`` bounds what the driver receives: the labelled ids with the smallest hash. They are picked before
    their texts are read, so no text is moved.
    """
    known = labels.where(F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    some = docs.select("doc_id").join(known, "doc_id").distinct().orderBy(
        F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(sample_rows)
    chosen = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")  # sample_rows ids and labels
    rows = scan.add_columns(chosen, ["doc_id", "quality"], [T.StructField("at", T.BinaryType()), T.StructField("value", T.BinaryType())],
                            _vector_column).dropDuplicates(["doc_id"]).orderBy("doc_id").collect()
    model, bias = FollowTheLeader(), 1 << BITS
    data = [(r["at"], r["value"], float(r["quality"] > 0)) for r in rows]  # packed, so that the sample stays small here
    del rows
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(data)):
            at, value, label = data[i]
            model.learn(np.append(np.frombuffer(at, "<i4"), bias), np.append(np.frombuffer(value, "<f4"), 1.0), label)
    return model.weight(np.arange(bias + 1)).astype(np.float32)


def score(docs: DataFrame, weights: np.ndarray, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns and ``score``: the probability of label 1."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)  # (2^BITS + 1) floats

    def run(column: pa.Array) -> list[pa.Array]:
        w, out = sent.value, []
        for _, _, buf, offsets in scan.chunks(column, 2 * scan.CHUNK_BYTES):
            row, bucket, x = vectors(buf, offsets)
            dot = np.bincount(row, weights=w[bucket] * x, minlength=len(offsets) - 1) + w[-1]
            out.append(1 / (1 + np.exp(-np.clip(dot, -30, 30))))
        return [pa.array(np.concatenate(out) if out else np.zeros(0))]

    return scan.add_columns(docs, keep, [T.StructField("score", T.DoubleType())], run, text)


def learnable(labels: DataFrame) -> DataFrame:
    """Labels whose crc32 of the id is not divisible by five: the ones a model may learn from."""
    return labels.select("doc_id", "quality").where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
