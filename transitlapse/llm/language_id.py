"""Language identification as a mixture: each text's language proportions by expectation maximisation.

A language is a distribution over hashed byte n-grams, learned from counts over all learnable documents. The
proportions of a text maximise the likelihood of its n-grams under a mixture of the languages; its language set
grows by the language that raises the likelihood most, as long as the gain exceeds a penalty for the added
language. The predicted language is the set's largest share, its score that share.

A text stands between two breaks, so one letter already has n-grams. Shares are followed until no other shares can be
likelier by more than GAP (the bound: total * log of the largest gradient), and a text keeps one language without
further trials only if that bound shows that no mixture pays its price.

Counting sends one row for each language and partition to the driver: (number of languages) x 2^BITS sums, whatever
the size of the input. Texts that are null or have no letter are ``und`` with score 0. Repeated rows get equal
results; an empty table gives an empty result; without learnable documents every text is ``und``; of equal shares the
language added first to the set counts, of equal likelihoods the one first by name. A text is one array in its task, of
any length. A kept column named like a result is replaced by it.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from transitlapse.llm import scan

BITS = 14
SIZES = (2, 3, 4)
UNKNOWN = "und"
#: What a further language must gain: this many times the log of the number of n-grams.
PENALTY = 4.0
#: How far, as a logarithm, a likelihood may stay below the most its languages can reach, and the rounds for it.
GAP = 0.1
STEPS = 200

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_LETTER = np.isin(np.arange(256), list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")) | (np.arange(256) >= 128)
_SHOWN = np.where(_LETTER, _LOWER, 32).astype(np.uint64)


def grams(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, bucket and count of the n-grams of a chunk's texts; other bytes than letters count as one break each."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    long = np.diff(offsets)
    shown = np.full(len(buf) + 2 * len(long), 32, np.uint64)
    shown[np.arange(len(buf)) + np.repeat(2 * np.arange(len(long)) + 1, long)] = _SHOWN[buf]
    row = np.repeat(np.arange(len(long)), long + 2)
    keys = []
    value = shown.copy()
    for k in range(1, max(SIZES)):
        value = value[:-1] * np.uint64(256) + shown[k:]
        if k + 1 in SIZES:
            own = row[: len(value)]
            whole = (own == row[k:]) & ((shown[: len(value)] != 32) | (shown[1 : len(value) + 1] != 32))
            bucket = (scan.mix(value[whole], k) >> np.uint64(64 - BITS)).astype(np.int64)
            keys.append((own[whole] << BITS) | bucket)
    key, count = np.unique(np.concatenate(keys), return_counts=True)
    return key >> BITS, key & ((1 << BITS) - 1), count


@dataclass
class Model:
    languages: list[str]
    likelihood: np.ndarray  # bucket x language


def train(docs: DataFrame) -> Model:
    """A model of ``docs`` (text, lang): every text counts, null languages do not."""
    scan.ship(docs.sparkSession)
    size = 1 << BITS

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            languages = batch.column("lang").to_pylist()
            for first, last, buf, offsets in scan.chunks(batch.column("text")):
                row, bucket, n = grams(buf, offsets)
                own = np.array(languages[first:last], object)[row]
                for lang in set(languages[first:last]):
                    at = own == lang
                    sums.setdefault(lang, np.zeros(size, np.int64))
                    sums[lang] += np.bincount(bucket[at], weights=n[at], minlength=size).astype(np.int64)
        for lang, n in sums.items():
            used = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(used), pa.string()), pa.array(used), pa.array(n[used])], names=["lang", "bucket", "n"])

    counted = docs.where(F.col("lang").isNotNull()).select("text", "lang").mapInArrow(count, "lang string, bucket bigint, n bigint")
    rows = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(rows["lang"].unique())
    n = np.zeros((size, len(languages)))
    n[rows["bucket"], rows["lang"].map({x: i for i, x in enumerate(languages)}).astype(int)] = rows["n"]
    return Model(languages, ((n + 0.1) / (n + 0.1).sum(axis=0)).astype(np.float64) if languages else n)


def _mixture(p: np.ndarray, count: np.ndarray, least: float = -np.inf) -> tuple[np.ndarray, float, float]:
    """Shares of the columns of ``p`` that maximise the likelihood of the counts, its logarithm, and the most that any
    shares can reach. Ends early once that is no more than ``least``."""
    share = np.full(p.shape[1], 1 / p.shape[1])
    total = count.sum()
    for step in itertools.count():
        mixed = p @ share
        reached = float(count @ np.log(mixed))
        slope = (p.T @ (count / mixed)) / total
        most = reached + total * max(0.0, float(np.log(slope.max())))
        if most - reached <= GAP or most <= least or step == STEPS:
            return share, reached, most
        share = share * slope


def shares(p: np.ndarray, count: np.ndarray) -> dict[int, float]:
    """The language set by penalised likelihood and its shares, for n-grams with likelihoods ``p``."""
    single = count @ np.log(p)
    chosen = [int(single.argmax())]
    best, found = float(single[chosen[0]]), np.ones(1)
    price = PENALTY * np.log(count.sum() + 1)
    # No mixture reaches more than the bound of the mixture of all languages.
    if p.shape[1] > 1 and _mixture(p, count, best + price)[2] - best > price:
        while len(chosen) < p.shape[1]:
            tried = [(*_mixture(p[:, [*chosen, k]], count)[:2], k) for k in range(p.shape[1]) if k not in chosen]
            share, reached, k = max(tried, key=lambda t: t[1])
            if reached - best <= price:
                break
            chosen, best, found = [*chosen, k], reached, share
    return dict(zip(chosen, found.tolist()))


def predict(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """``keep`` columns, lang_pred, score and shares (language to share) of each text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(column: pa.Array) -> list[pa.Array]:
        own, best, score, mixed = sent.value, [], [], []
        letters = [any(c.isalpha() for c in t or "") for t in column.to_pylist()]
        for first, _, buf, offsets in scan.chunks(column):
            row, bucket, n = grams(buf, offsets)
            cut = np.searchsorted(row, np.arange(len(offsets)))
            for k, (a, b) in enumerate(zip(cut[:-1], cut[1:])):
                if a == b or not own.languages or not letters[first + k]:
                    best.append(UNKNOWN)
                    score.append(0.0)
                    mixed.append([])
                    continue
                found = shares(own.likelihood[bucket[a:b]], n[a:b].astype(np.float64))
                top = max(found, key=found.get)
                best.append(own.languages[top])
                score.append(min(1.0, found[top]))
                mixed.append([(own.languages[j], s) for j, s in sorted(found.items())])
        return [pa.array(best, pa.string()), pa.array(score, pa.float64()), pa.array(mixed, pa.map_(pa.string(), pa.float64()))]

    return scan.add_columns(docs, keep, [
        T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
        T.StructField("shares", T.MapType(T.StringType(), T.DoubleType()))], run)


def learnable(docs: DataFrame) -> DataFrame:
    """Documents a model may learn from: those whose crc32 of the id leaves no remainder of two by four."""
    return docs.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
