"""Benchmark decontamination: words of training texts that lie in word windows of benchmark items.

Windows of ten consecutive item words (an item with fewer words is one window) are sent to every executor as a
sorted hash table; texts are scanned window by window, each hash hit is verified against the window's words, and
hit spans are removed or their documents dropped. The table is cut into slices of a fixed number of windows, one
scan after the other, so its size is bounded however large the benchmark is.

Null texts have no words. Repeated rows are judged alike; an empty benchmark hits nothing; an empty table stays empty.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from transitlapse.llm import scan
from transitlapse.session import cut_lineage

WINDOW = 10
#: Windows sent to the executors at once: about 100 bytes each.
SLICE_WINDOWS = 250_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_IS_WORD = np.isin(np.arange(256), list(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")) | (np.arange(256) >= 128)


def _words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, scan.Prefix]:
    """Lower-case bytes, word starts and ends, each text's first word, and the prefix hash over words."""
    low = _LOWER[buf]
    start, end, first = scan.words(low, offsets, _IS_WORD)
    return low, start, end, first, scan.Prefix(scan.Prefix(scan.BYTE_VALUES[low]).window(start, end))


def _joined(low: bytes, start: np.ndarray, end: np.ndarray, i: int, n: int) -> bytes:
    return b" ".join(low[start[j] : end[j]] for j in range(i, i + n))


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """n_words, hash, words of each distinct window and the item ids that hold it."""

    def run(batches):
        for batch in batches:
            items = batch.column("item_id").to_pylist()
            for row, _, buf, offsets in scan.chunks(batch.column("text")):
                low, start, end, first, prefix = _words(buf, offsets)
                raw, out = low.tobytes(), []
                for k in range(len(offsets) - 1):
                    a, b = int(first[k]), int(first[k + 1])
                    n = min(window, b - a)
                    for i in range(a, b - n + 1) if n else ():
                        key = int(prefix.window(np.array([i]), np.array([i + n]))[0].astype(np.int64))
                        out.append((n, key, _joined(raw, start, end, i, n), items[row + k]))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                        zip(*out), (pa.int32(), pa.int64(), pa.binary(), pa.string()))], names=["n", "key", "words", "item"])

    scan.ship(benchmark.sparkSession)
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").mapInArrow(
        run, "n int, key bigint, words binary, item string")
    return rows.groupBy("n", "key", "words").agg(F.collect_set("item").alias("items"))


class _Table:
    """Windows of one slice: sorted hashes by number of words, and the words and items of each hash."""

    def __init__(self, rows: list):
        self.found: dict[tuple[int, int], list[tuple[bytes, list[str]]]] = defaultdict(list)
        for r in rows:
            self.found[r["n"], r["key"]].append((bytes(r["words"]), r["items"]))
        sizes = {n for n, _ in self.found}
        self.keys = {n: np.array(sorted(k for m, k in self.found if m == n), np.int64).view(np.uint64) for n in sizes}
        self.keys = {n: np.sort(k) for n, k in self.keys.items()}


def _scan(column: pa.Array, table: _Table) -> list[pa.Array]:
    n_words, spans, items, hits = [], [], [], []
    for _, _, buf, offsets in scan.chunks(column):
        low, start, end, first, prefix = _words(buf, offsets)
        covered = np.zeros(len(start) + 1, np.int32)
        held: dict[int, set[str]] = defaultdict(set)
        raw = low.tobytes()
        for n, keys in table.keys.items():
            at = np.arange(max(0, len(start) - n + 1))
            if not len(at):
                continue
            text = np.searchsorted(first, at, "right")
            at = at[at + n <= first[text]]  # within one text
            key = prefix.window(at, at + n)
            near = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            for i, k in zip(at[keys[near] == key].tolist(), key[keys[near] == key].astype(np.int64).tolist()):
                words = _joined(raw, start, end, i, n)
                for known, names in table.found[n, k]:
                    if known == words:
                        covered[i] += 1
                        covered[i + n] -= 1
                        held[int(np.searchsorted(first, i, "right")) - 1].update(names)
        hit = np.cumsum(covered[:-1]) > 0
        for k in range(len(offsets) - 1):
            a, b = int(first[k]), int(first[k + 1])
            own = hit[a:b]
            n_words.append(b - a)
            hits.append(int(own.sum()))
            items.append(sorted(held.get(k, ())))
            edge = np.flatnonzero(np.diff(np.concatenate([[0], own.view(np.int8), [0]])))
            spans.append([{"start": int(start[a + x] - offsets[k]), "end": int(end[a + y - 1] - offsets[k])}
                          for x, y in zip(edge[::2], edge[1::2])])
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return [pa.array(n_words, pa.int64()), pa.array(hits, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(spans, kind)]


_SPAN = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_FIELDS = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
           T.StructField("items", T.ArrayType(T.StringType())), T.StructField("spans", _SPAN)]


def _merge_spans(a: list, b: list) -> list[dict]:
    out: list[dict] = []
    for s in sorted([*a, *b], key=lambda s: s["start"]):
        if out and s["start"] <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], s["end"])
        else:
            out.append(dict(s))
    return out


def find_contamination(docs: DataFrame, benchmark: DataFrame, keep: list[str], window: int = WINDOW,
                       text: str = "text", cut: bool = False) -> DataFrame:
    """``keep`` columns, n_words, n_hit (words inside any occurring window), items, spans (bytes, end exclusive).

    With ``cut`` also ``rest``: what is left of the texts that have spans.
    """
    spark = docs.sparkSession
    table = cut_lineage(benchmark_windows(benchmark, window))
    slices = max(1, -(-table.count() // SLICE_WINDOWS))
    out = None
    for s in range(slices):
        rows = table.where(F.pmod(F.xxhash64("words"), F.lit(slices)) == s).collect()  # SLICE_WINDOWS, about
        sent = spark.sparkContext.broadcast(_Table(rows))
        if out is None:
            # Later slices look at the same texts.
            held = keep if slices == 1 else [*keep, text]
            last = cut and slices == 1
            fields = [*_FIELDS, T.StructField("rest", T.StringType())] if last else _FIELDS

            def look(column: pa.Array, sent=sent, last=last) -> list[pa.Array]:
                found = _scan(column, sent.value)
                return [*found, _rests(column, found[-1].to_pylist())] if last else found

            out = scan.add_columns(docs, held, fields, look, text)
        else:
            out = _add_slice(out, sent, text, cut and s == slices - 1)
    return out.select(*[c for c in out.columns if c != text or text in keep])


def _add_slice(before: DataFrame, sent, text: str, cut: bool) -> DataFrame:
    """The findings of one more slice joined to those so far, row by row."""

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index
            columns = {c: batch.column(c) for c in batch.schema.names}
            _, _, items, spans = _scan(columns[text], sent.value)
            merged = [_merge_spans(a or [], b) for a, b in zip(columns["spans"].to_pylist(), spans.to_pylist())]
            both = [sorted({*(a or []), *b}) for a, b in zip(columns["items"].to_pylist(), items.to_pylist())]
            texts = columns[text].to_pylist()
            hit = [_count_words(t, m) for t, m in zip(texts, merged)]
            columns |= {"spans": pa.array(merged, batch.schema.field(at("spans")).type),
                        "items": pa.array(both, batch.schema.field(at("items")).type), "n_hit": pa.array(hit, pa.int64())}
            if cut:
                columns["rest"] = _rests(columns[text], merged)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return before.mapInArrow(run, T.StructType([*before.schema.fields, *[T.StructField("rest", T.StringType())] * cut]))


def _count_words(text: str | None, spans: list[dict]) -> int:
    raw = np.frombuffer((text or "").encode(), np.uint8)
    start, _, _ = scan.words(raw, np.array([0, len(raw)]), _IS_WORD)
    return int(sum(((start >= s["start"]) & (start < s["end"])).sum() for s in spans))


def remove_contamination(docs: DataFrame, benchmark: DataFrame, drop_share: float = 0.5) -> DataFrame:
    """``docs`` without hit spans; documents of which at least ``drop_share`` of the words are hit go."""
    columns = docs.columns
    plain, names, text = scan.numbered_columns(docs)
    found = find_contamination(plain, benchmark, names, text=text, cut=True)
    kept = found.where((F.col("n_hit") == 0) | (F.col("n_hit") < drop_share * F.col("n_words")))
    own = {c: F.col(n) for c, n in zip(columns, names)}
    hit = F.size("spans") > 0
    own["text"] = F.when(hit, F.col("rest")).otherwise(own["text"])
    if "n_chars" in own:
        own["n_chars"] = F.when(hit, F.char_length("rest").cast(docs.schema["n_chars"].dataType)).otherwise(own["n_chars"])
    return kept.select(*(own[c].alias(c) for c in columns))


def _rests(column: pa.Array, spans: list) -> pa.Array:
    """What is left of each text that has spans."""
    out: list[str | None] = [None] * len(spans)
    for i, cut in enumerate(spans):
        if cut:
            raw, edges = column[i].as_py().encode(), [0, *(x for s in cut for x in (s["start"], s["end"])), None]
            out[i] = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2])).decode()
    return pa.array(out, pa.string())
