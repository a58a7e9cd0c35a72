"""Packing documents into training sequences of several lengths without padding.

Every document is cut into whole windows of the longest context and a rest. The rest goes to the smallest tier that
holds it; tiers are packed from the longest down, a window's gap is filled with the longest shorter rests that fit,
and only the last gap is filled by cutting a rest. What no rest is left for becomes sequences whose lengths are
powers of two, which need no padding. Each input partition is packed on its own, block by block, so nothing is
shuffled and no key can be hot; sequence ids hold the partition's number. Sequences of a block are dealt to step
groups of about equal numbers of tokens.

Nulls count as empty texts (the end id alone). Repeated rows are packed as separate documents. An empty table gives
no pieces. Other columns of the input are not kept.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from transitlapse.llm import scan, tokens

TIERS = (1024, 512, 256, 128)
BLOCK_IDS = 1_000_000
STEP_IDS = 64 * 1024

Piece = tuple[int, int, int]  # document's number in the block, start, length


def _powers(n: int) -> list[int]:
    return [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]


def _split(sequence: list[Piece], sizes: list[int]) -> Iterator[list[Piece]]:
    """Cut one sequence into several of the given sizes."""
    left = sequence[::-1]
    for size in sizes:
        part: list[Piece] = []
        while size:
            doc, start, n = left.pop()
            take = min(n, size)
            part.append((doc, start, take))
            if take < n:
                left.append((doc, start + take, n - take))
            size -= take
        yield part


def pack_lengths(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[list[Piece]]:
    """Sequences of pieces that hold each token of documents with these lengths once, in sizes that need no padding."""
    longest, out, rests = tiers[0], [], []
    for doc, n in enumerate(lengths):
        out += [[(doc, start, longest)] for start in range(0, n - longest + 1, longest)]
        if n % longest:
            rests.append((n % longest, doc, n - n % longest))
    rests.sort()
    while rests:
        n, doc, start = rests.pop()
        context = min(t for t in tiers if t >= n)
        sequence, gap = [(doc, start, n)], context - n
        while gap and rests:
            fits = bisect_right(rests, (gap, np.inf, np.inf))
            n, doc, start = rests.pop(fits - 1 if fits else 0)
            take = min(n, gap)
            sequence.append((doc, start, take))
            if take < n:
                insort(rests, (n - take, doc, start + take))
            gap -= take
        out += _split(sequence, _powers(context - gap)) if gap else [sequence]
    return out


def step_groups(sizes: list[int], step_ids: int = STEP_IDS) -> list[int]:
    """A group for each sequence, so that groups hold about equal numbers of tokens: the longest to the emptiest."""
    load = [(0, g) for g in range(max(1, -(-sum(sizes) // step_ids)))]
    group = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        n, g = heapq.heappop(load)
        group[i] = g
        heapq.heappush(load, (n + sizes[i], g))
    return group


_FIELDS = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()),
           ("sequence_id", pa.int64()), ("offset", pa.int64()), ("context", pa.int64()), ("step_group", pa.int64()),
           ("ids", pa.binary())]


def pack(docs: DataFrame, tokenizer_file: str, tiers: tuple[int, ...] = TIERS) -> DataFrame:
    """A row for each piece: doc_id, start, length, doc_tokens, sequence_id, offset, context, step_group, ids.

    ``context`` is the length of its sequence, ``ids`` the piece's ids as little-endian unsigned 32-bit numbers.
    """

    scan.ship(docs.sparkSession)

    def pack_block(first: int, group: int, doc_ids: list, ids: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        sequences = pack_lengths([len(x) for x in ids], tiers)
        sizes = [sum(n for _, _, n in s) for s in sequences]
        groups, rows = step_groups(sizes), []
        for number, sequence in enumerate(sequences):
            offset = 0
            for doc, start, n in sequence:
                rows.append((doc_ids[doc], start, n, len(ids[doc]), first + number, offset, sizes[number],
                             group + groups[number], ids[doc][start : start + n].astype("<u4").tobytes()))
                offset += n
        for lo in range(0, len(rows), 5_000):
            columns = zip(*rows[lo : lo + 5_000])
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(columns, _FIELDS)],
                                             names=[name for name, _ in _FIELDS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, sequences, groups, doc_ids, ids, size = TaskContext.get().partitionId() << 36, 0, 0, [], [], 0
        for batch in batches:
            for doc_id, own in zip(batch.column("doc_id").to_pylist(),
                                   tokens.encode_column(batch.column("text"), tokenizer_file)):
                doc_ids.append(doc_id)
                ids.append(own)
                size += len(own)
                if size >= BLOCK_IDS:
                    yield from pack_block(base + sequences, base + groups, doc_ids, ids)
                    sequences, groups = sequences + size, groups + size
                    doc_ids, ids, size = [], [], 0
        if ids:
            yield from pack_block(base + sequences, base + groups, doc_ids, ids)

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(
        run, "doc_id bigint, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, "
             "context bigint, step_group bigint, ids binary")
