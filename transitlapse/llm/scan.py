"""Texts of an Arrow column as byte arrays: chunks of whole texts, prefix hashes, words.

Everything here works on many texts at once: a chunk is one byte array with the offsets of its texts. Nulls count
as empty texts throughout.
"""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

CHUNK_BYTES = 1 << 18
U64 = np.uint64


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package's code to the executors, once per application: they need no copy of their own."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix=f"{package.name}-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for source in sorted(package.rglob("*.py")):
            z.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column and the n + 1 offsets of its texts."""
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets): whole texts, at most ``limit`` bytes unless one is longer."""
    if not len(column):
        return
    data, offsets = text_bytes(column)
    row = 0
    while row < len(column):
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, last, data[offsets[row] : offsets[last]], offsets[row : last + 1] - offsets[row]
        row = last
    pa.default_memory_pool().release_unused()


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = x + U64(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Prefix:
    """Hash of any window of a sequence from two look-ups.

    With the powers of an odd number and those of its inverse modulo 2^64, a prefix sum of value * inverse^i gives
    every window's polynomial by a difference and one product.
    """

    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, values: np.ndarray, base: int = 0x9E3779B97F4A7C15):
        n = len(values)
        self.power, inverse = self._tables(base, n)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * inverse[:n], out=self.sums[1:])

    @classmethod
    def _tables(cls, base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        have = cls._powers.get(base)
        if have is None or len(have[0]) < n + 1:
            size = max(n + 1, CHUNK_BYTES + 1)
            have = tuple(np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, m, np.uint64)]))
                         for m in (base, pow(base, -1, 1 << 64)))
            if size <= 8 * CHUNK_BYTES:
                cls._powers[base] = have
        return have

    def window(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.power[start])


BYTE_VALUES = mix(np.arange(256, dtype=np.uint64), 1)
BYTE_VALUES_2 = mix(np.arange(256, dtype=np.uint64), 2)


def words(buf: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word (a run of bytes with ``is_word``, within one text) and each text's first word."""
    inside = is_word[buf]
    left = np.empty(len(buf), bool)
    right = np.empty(len(buf), bool)
    if len(buf):
        left[0] = right[-1] = False
        left[1:], right[:-1] = inside[:-1], inside[1:]
        edges = offsets[:-1][np.diff(offsets) > 0]
        left[edges] = False
        right[edges[1:] - 1] = False
    starts = np.flatnonzero(inside & ~left)
    ends = np.flatnonzero(inside & ~right) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def add_columns(docs: DataFrame, keep: list[str], fields: list[T.StructField],
                compute: Callable[[pa.Array], list[pa.Array]], text: str = "text") -> DataFrame:
    """``keep`` columns of ``docs`` and new ones that ``compute`` makes of the column ``text``; one row each, in place.

    A kept column named like a new one is replaced by it.
    """
    ship(docs.sparkSession)
    new = {f.name for f in fields}
    kept = [c for c in dict.fromkeys(keep) if c not in new]
    given = docs.select(*dict.fromkeys([*kept, text]))
    schema = T.StructType([given.schema[c] for c in kept] + fields)

    def run(batches):
        for batch in batches:
            made = compute(batch.column(text))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + made, names=[*kept, *(f.name for f in fields)])

    return given.mapInArrow(run, schema)


def numbered_columns(docs: DataFrame) -> tuple[DataFrame, list[str], str]:
    """``docs`` with columns renamed to ``_0``, ``_1``, ..., so that nothing clashes; their names, that of the text."""
    names = [f"_{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), names, names[docs.columns.index("text")]
