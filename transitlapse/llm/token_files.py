"""Token files: frequency-ranked ids as byte-aligned numbers with their control bytes kept apart.

A folder of Parquet files. A row is a block of whole documents: their ids and token counts, the table from rank to
id (most frequent first, over all of the block), one stream of control bytes (two bits a number: its bytes less one)
and one of data bytes, little end first. Blocks follow each other in ascending document order by (file, block).

Nulls count as empty texts (the end id alone). Documents without an id come first; equal ids are ordered by text.
An empty table gives an empty folder of the same schema. Other columns of the input are not stored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from transitlapse.llm import scan, tokens

BLOCK_IDS = 1_000_000
#: Block starts are sent to every executor up to this many blocks (24 bytes each), joined by shuffle beyond.
MOST_SENT_BLOCKS = 100_000
SCHEMA = ("file int, block int, doc_ids array<bigint>, counts array<int>, n_ids bigint, ids_by_rank binary, "
          "control binary, data binary")

#: Byte lengths of the four numbers that each control byte describes.
_LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1


def encode_numbers(numbers: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned 32-bit numbers."""
    n = numbers.astype(np.uint32)
    size = 1 + (n > 0xFF) + (n > 0xFFFF) + (n > 0xFFFFFF)
    code = np.zeros(-(-len(n) // 4) * 4, np.uint8)
    code[: len(n)] = size - 1
    code = code.reshape(-1, 4)
    control = code[:, 0] | code[:, 1] << 2 | code[:, 2] << 4 | code[:, 3] << 6
    place = np.cumsum(size) - size
    data = np.zeros(int(size.sum()), np.uint8)
    for k in range(4):
        has = np.flatnonzero(size > k)
        data[place[has] + k] = n[has] >> np.uint32(8 * k) & np.uint32(0xFF)
    return control.astype(np.uint8).tobytes(), data.tobytes()


def decode_numbers(control: bytes, data: bytes, n: int) -> np.ndarray:
    size = _LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    place = np.cumsum(size) - size
    raw = np.frombuffer(data, np.uint8)
    out = raw[place].astype(np.uint32) if n else np.zeros(0, np.uint32)
    for k in range(1, 4):
        has = np.flatnonzero(size > k)
        if not len(has):
            break
        out[has] |= raw[place[has] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def _block(file: int, block: int, ids: list[int | None], found: list[np.ndarray]) -> tuple:
    flat = np.concatenate(found)
    seen, back, often = np.unique(flat, return_inverse=True, return_counts=True)
    order = np.lexsort((seen, -often))
    rank = np.empty(len(seen), np.uint32)
    rank[order] = np.arange(len(seen), dtype=np.uint32)
    control, data = encode_numbers(rank[back])
    return file, block, ids, [len(x) for x in found], len(flat), seen[order].astype("<u4").tobytes(), control, data


_ARROW = pa.schema([("file", pa.int32()), ("block", pa.int32()), ("doc_ids", pa.list_(pa.int64())),
                    ("counts", pa.list_(pa.int32())), ("n_ids", pa.int64()), ("ids_by_rank", pa.binary()),
                    ("control", pa.binary()), ("data", pa.binary())])


def write_tokens(docs: DataFrame, path: str, tokenizer_file: str) -> None:
    """Encode every whole text of ``docs`` (doc_id, text), end id after each, and write the files at ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, block, ids, found, size = TaskContext.get().partitionId(), 0, [], [], 0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([dict(zip(_ARROW.names, _block(file, block, ids, found)))], _ARROW)

        for batch in batches:
            for doc_id, own in zip(batch.column("doc_id").to_pylist(),
                                   tokens.encode_column(batch.column("text"), tokenizer_file)):
                if found and size + len(own) > BLOCK_IDS:
                    yield row()
                    block, ids, found, size = block + 1, [], [], 0
                ids.append(doc_id)
                found.append(own)
                size += len(own)
        if found:
            yield row()

    scan.ship(docs.sparkSession)
    ordered = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").repartitionByRange("doc_id")
    ordered.sortWithinPartitions("doc_id", "text").mapInArrow(run, SCHEMA).write.parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (little-endian unsigned 32-bit) from the files."""
    scan.ship(spark)
    blocks = spark.read.schema(SCHEMA).parquet(path)
    sizes = blocks.select("file", "block", "n_ids")
    per_file = sizes.groupBy("file").agg(F.sum("n_ids").alias("n"), F.count("*").alias("blocks"))
    # One row a file.
    before = per_file.select("file", (F.sum("n").over(W.orderBy("file")) - F.col("n")).alias("before"))
    inner = F.sum("n_ids").over(W.partitionBy("file").orderBy("block")) - F.col("n_ids")
    starts = sizes.join(before, "file").select("file", "block", (F.col("before") + inner).alias("first"))
    n_blocks = per_file.agg(F.sum("blocks")).first()[0] or 0
    placed = blocks.join(F.broadcast(starts) if n_blocks <= MOST_SENT_BLOCKS else starts, ["file", "block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                one = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                by_rank = np.frombuffer(one["ids_by_rank"], "<u4")
                ids = by_rank[decode_numbers(one["control"], one["data"], one["n_ids"])].tobytes()
                counts = np.array(one["counts"], np.int64)
                end = np.cumsum(counts)
                for lo in range(0, len(counts), 2_000):
                    hi = min(lo + 2_000, len(counts))
                    yield pa.RecordBatch.from_arrays([
                        pa.array(one["doc_ids"][lo:hi], pa.int64()),
                        pa.array(one["first"] + end[lo:hi] - counts[lo:hi]), pa.array(counts[lo:hi]),
                        pa.array([ids[4 * (e - c) : 4 * e] for e, c in zip(end[lo:hi], counts[lo:hi])], pa.binary()),
                    ], names=["doc_id", "start", "n_tokens", "ids"])

    return placed.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids binary")
