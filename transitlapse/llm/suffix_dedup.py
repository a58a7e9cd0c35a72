"""Removal of repeated byte strings by suffix sorting, bucket by bucket, with a difference cover.

Looked for are all positions at which a string of ``length`` bytes starts that starts somewhere else too. Suffixes
are sorted to that depth only, and only those that can be tied so deep:

1. Buckets. Each window of ``length`` bytes has a minimiser, its smallest hash of so many bytes. Equal windows have
   equal minimisers at the same place, so only windows whose minimiser occurs at two places go on; no repeated window
   is lost. This is asked first of ``COARSE`` bytes over all texts, then of ``FINE`` bytes over what is left. Windows
   with one fine minimiser are a bucket: all share its bytes, and differ in the ``length - FINE`` bytes around it.
2. Difference cover. In a bucket the ``length - FINE`` bytes around the common ones are one short string a row. Its
   positions that lie, modulo ``PERIOD``, in a difference cover are the sample; sample suffixes are ranked once, by
   their first PERIOD bytes and then by doubling over the sample alone. All suffixes of the bucket are sorted at once:
   by the bytes before their next sample position, by the rank there and the rank whose reach ends last inside the
   window, and by the bytes behind it. So no sort holds more than a few numbers a suffix, however long a tie is, and
   equal neighbours are repeated windows. Windows that are equal lie alike around their minimiser, so a bucket never
   has to order suffixes of different offsets.
3. Surroundings that are equal are merged by aggregation before. A task sorts a few whole buckets at a time. A bucket
   of more than ``MOST_SORTED`` surroundings is cut by its next bytes: half of its suffixes share more bytes before
   the minimiser, the other half more bytes after it. Both halves are buckets again, told apart by these bytes, until
   each fits or holds one window only, which needs no sorting.

Texts are read in pieces of ``PIECE`` bytes that overlap by one window, so memory does not grow with a text's length.
Buckets are told apart by 128 bits. Equal texts are one text from the start; a text with copies is repeated as a
whole. Matches never cross texts. Null texts are empty, texts shorter than ``length`` lose nothing, repeated rows are
copies, an empty table gives an empty result, other columns are not kept.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from transitlapse.llm import scan
from transitlapse.session import cut_lineage

LENGTH = 400
COARSE = 128
FINE = 320
PERIOD = 13
# A perfect difference set; every residue but 0 is the difference of exactly one pair.
COVER = (0, 1, 3, 9)
#: Surroundings of a bucket that one task sorts; larger buckets are cut by their next bytes first.
MOST_SORTED = 5_000
PIECE = 1 << 18
#: How many numbers of 8 bytes are sent to every executor at most. Beyond, a shuffle takes the place of sending.
MOST_SENT = 8_000_000


def text_key(raw: bytes | np.ndarray) -> bytes:
    return hashlib.blake2b(raw, digest_size=16).digest()


def _sliding(x: np.ndarray, width: int, least) -> np.ndarray:
    """``least`` of every ``width`` neighbours, by doubling."""
    size = 1
    while size * 2 <= width:
        x, size = least(x[:-size], x[size:]), size * 2
    return least(x[: len(x) - (width - size)], x[width - size :]) if size < width else x


class _Chunk:
    """Minimisers of ``gram`` bytes of all windows of a chunk, and which windows lie in one text."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, length: int, gram: int):
        self.offsets, self.n, self.width = offsets, len(buf), length - gram + 1
        self.row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        self.prefix = scan.Prefix(scan.BYTE_VALUES[buf])
        if self.n < length:
            self.least, self.whole, self.gram = np.zeros(0, np.uint64), np.zeros(0, bool), np.zeros(0, np.uint64)
            return
        at = np.arange(self.n - gram + 1)
        self.gram = self.prefix.window(at, at + gram)
        self.least = _sliding(self.gram, self.width, np.minimum)
        self.whole = self.row[: self.n - length + 1] == self.row[length - 1 :]

    def anchors(self, windows: np.ndarray) -> np.ndarray:
        """Positions whose hash is the minimiser of one of ``windows`` around them."""
        if not windows.any():
            return np.zeros(0, np.int64)
        aside = np.zeros(self.width - 1, np.uint64)
        own = np.concatenate([aside, np.where(windows, self.least, np.uint64(0)), aside])
        top = _sliding(own, self.width, np.maximum)  # over the windows that hold the position
        return np.flatnonzero((top == self.gram) & (top > 0))

    def among(self, hashes: pa.Array, good: np.ndarray) -> np.ndarray:
        """Windows whose minimiser is among the hashes of their text, in texts that are ``good``."""
        n, texts = len(self.least), np.arange(len(self.offsets) - 1, dtype=np.uint64)
        if not n or not len(hashes.flatten()):
            return np.zeros(n, bool)
        tag = scan.mix(texts, 41)
        text = np.repeat(texts.astype(np.int64), hashes.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        known = np.sort(scan.mix(hashes.flatten().to_numpy(zero_copy_only=False).view(np.uint64) + tag[text], 42))
        row = self.row[:n]
        change = np.flatnonzero(np.concatenate([[True], (self.least[1:] != self.least[:-1]) | (row[1:] != row[:-1])]))
        key = scan.mix(self.least[change] + tag[row[change]], 42)
        near = np.minimum(np.searchsorted(known, key), len(known) - 1)
        return np.repeat((known[near] == key) & good[row[change]], np.diff(np.append(change, n))) & self.whole


def _keys(column: pa.Array) -> list[bytes]:
    data, offsets = scan.text_bytes(column)
    return [text_key(data[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]


def _pieces(column: pa.Array, overlap: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, int]]:
    """(first row, row after the last, bytes, offsets, bytes of the text before): whole texts, or a piece of a long one.

    Every string of at most ``overlap`` + 1 bytes of a long text starts in the first ``PIECE`` bytes of one piece.
    """
    for first, last, buf, offsets in scan.chunks(column, PIECE):
        if len(buf) <= PIECE + overlap:
            yield first, last, buf, offsets, 0
            continue
        for a in range(0, len(buf) - overlap, PIECE):
            part = buf[a : a + PIECE + overlap]
            yield first, last, part, np.array([0, len(part)]), a


def _anchor_column(length: int):
    def run(column: pa.Array) -> list[pa.Array]:
        sizes = scan.text_bytes(column)[1]
        found: list[list[np.ndarray]] = [[] for _ in range(len(column))]
        end = -1
        for first, last, buf, offsets, before in _pieces(column, length - 1):
            chunk = _Chunk(buf, offsets, length, COARSE)
            at = chunk.anchors(chunk.whole)
            if before:
                at = at[at + before > end]  # the piece before may have these
            cut = np.searchsorted(at, offsets)
            hashes = chunk.gram[at].view(np.int64) if len(at) else np.zeros(0, np.int64)
            for k in range(last - first):
                found[first + k].append(hashes[cut[k] : cut[k + 1]])
            end = at[-1] + before if len(at) else (end if before else -1)
        counts = [sum(map(len, own)) for own in found]
        values = np.concatenate([x for own in found for x in own] or [np.zeros(0, np.int64)])
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values))
        return [pa.array(_keys(column), pa.binary()), pa.array(np.diff(sizes)), lists]

    return run


def _sent(rows: DataFrame, numbers: Column) -> DataFrame:
    """``rows`` marked to be sent if all their ``numbers``, and a few for each row, stay below the bound."""
    total = rows.agg(F.sum(numbers + 8)).first()[0] or 0
    return F.broadcast(rows) if total <= MOST_SENT else rows


def _wanted_texts(docs: DataFrame, wanted: DataFrame, numbers: str) -> DataFrame:
    """Rows of ``docs`` by id with what ``wanted`` (doc_id, key, numbers) has for them, without moving texts if it is small."""
    small = _sent(wanted.select(F.col("doc_id").alias("id"), "key", numbers), F.size(numbers))
    return docs.join(small, F.col("doc_id").eqNullSafe(F.col("id"))).select("text", "key", numbers)


def _fine_anchors(given: DataFrame, length: int) -> DataFrame:
    """(key, at, rank): fine minimisers of the windows whose coarse one is among a text's ``hashes``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, hashes = batch.column("key").to_pylist(), batch.column("hashes")
            all_good = np.array([own == key for own, key in zip(_keys(batch.column("text")), keys)], bool)
            for first, last, buf, offsets, before in _pieces(batch.column("text"), length - 1):
                windows = _Chunk(buf, offsets, length, COARSE).among(hashes.slice(first, last - first), all_good[first:last])
                if not windows.any():
                    continue
                fine = _Chunk(buf, offsets, length, FINE)
                at = fine.anchors(windows)
                rank, cut = fine.gram[at].view(np.int64), np.searchsorted(at, offsets)
                use = np.flatnonzero(np.diff(cut))
                yield pa.RecordBatch.from_arrays([
                    pa.array([keys[first + k] for k in use], pa.binary()),
                    pa.array([(at[cut[k] : cut[k + 1]] - offsets[k] + before).astype(np.int64) for k in use], pa.list_(pa.int64())),
                    pa.array([rank[cut[k] : cut[k + 1]] for k in use], pa.list_(pa.int64())),
                ], names=["key", "at", "ranks"])

    made = given.select("text", "key", "hashes").mapInArrow(run, "key binary, at array<bigint>, ranks array<bigint>")
    return cut_lineage(made).select("key", F.explode(F.arrays_zip("at", "ranks")).alias("s")).select(
        "key", F.col("s.at").alias("at"), F.col("s.ranks").alias("rank"))


def _gram_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of the FINE bytes at each of the ascending positions ``at``, a stretch of ``data`` at a time."""
    rank, check = np.empty(len(at), np.int64), np.empty(len(at), np.int64)
    lo = 0
    while lo < len(at):
        hi = int(np.searchsorted(at, at[lo] + PIECE, "right"))
        part, own = data[at[lo] : at[hi - 1] + FINE], at[lo:hi] - at[lo]
        rank[lo:hi] = scan.Prefix(scan.BYTE_VALUES[part]).window(own, own + FINE).view(np.int64)
        check[lo:hi] = scan.Prefix(scan.BYTE_VALUES_2[part], 0xD1342543DE82EF95).window(own, own + FINE).view(np.int64)
        lo = hi
    return rank, check


def _surroundings(given: DataFrame, length: int) -> DataFrame:
    """(rank, check, left, right, key, at) of the fine minimisers ``at`` of each text: the bytes before and after them."""
    side = length - FINE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts = scan.text_bytes(batch.column("text"))
            keys, places = batch.column("key").to_pylist(), batch.column("at")
            good = np.array([own == key for own, key in zip(_keys(batch.column("text")), keys)], bool)
            text = np.repeat(np.arange(len(batch)), places.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            own = places.flatten().to_numpy(zero_copy_only=False)
            text, own = text[good[text]], own[good[text]]
            order = np.lexsort((own, text))
            text, own = text[order], own[order]
            place = own + starts[text]  # ascending, as texts lie one after the other
            for lo in range(0, len(place), 2_000):
                t, at = text[lo : lo + 2_000], place[lo : lo + 2_000]
                a, b = np.maximum(at - side, starts[t]), np.minimum(at + FINE + side, starts[t + 1])
                rank, check = _gram_hashes(data, at)
                yield pa.RecordBatch.from_arrays([
                    pa.array(rank), pa.array(check),
                    pa.array([data[x:y].tobytes() for x, y in zip(a.tolist(), at.tolist())], pa.binary()),
                    pa.array([data[x:y].tobytes() for x, y in zip((at + FINE).tolist(), b.tolist())], pa.binary()),
                    pa.array([keys[k] for k in t.tolist()], pa.binary()), pa.array(own[lo : lo + 2_000]),
                ], names=["rank", "check", "left", "right", "key", "at"])

    return given.select("text", "key", "at").mapInArrow(
        run, "rank bigint, check bigint, left binary, right binary, key binary, at bigint")


def _sides(left: list[bytes], right: list[bytes], side: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes before and after the minimiser as rows, and for each shift 0 .. side whether the row's window exists."""
    raw = b"".join(x.rjust(side, b"\0") + y.ljust(side, b"\0") for x, y in zip(left, right))
    shift = np.arange(side + 1)
    has = (shift <= np.array([len(x) for x in left])[:, None]) & (side - shift <= np.array([len(x) for x in right])[:, None])
    return np.frombuffer(raw, np.uint8).reshape(len(left), 2 * side), has


def _runs(flags: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
    return [{"a": int(a), "b": int(b) - 1} for a, b in zip(edge[::2], edge[1::2])]


def _ranked(numbers: np.ndarray) -> np.ndarray:
    return np.unique(numbers, return_inverse=True)[1].reshape(numbers.shape)


def _packed(rows: np.ndarray, row: np.ndarray, at: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first ``count`` (below PERIOD) bytes of each of ``row`` from column ``at`` on, as two numbers."""
    out = []
    for part in (range(6), range(6, PERIOD - 1)):
        number = np.zeros(len(row), np.int64)
        for k in part:
            byte = rows[row, np.minimum(at + k, rows.shape[1] - 1)].astype(np.int64)
            number = number * 257 + np.where(k < count, byte + 1, 0)
        out.append(number)
    return out[0], out[1]


class _Sample:
    """Ranks of the sample suffixes of short strings, for each depth PERIOD, 2 PERIOD, 4 PERIOD ... that fits."""

    def __init__(self, bucket: np.ndarray, rows: np.ndarray, depth: int):
        n, width = rows.shape
        self.at = np.array([q for q in range(width) if q % PERIOD in COVER])
        self.column = np.full(width + PERIOD, -1)
        self.column[self.at] = np.arange(len(self.at))
        padded = np.concatenate([rows, np.zeros((n, PERIOD), np.uint8)], axis=1)
        rank = np.repeat(bucket[:, None], len(self.at), axis=1)
        for lo in range(0, PERIOD, 4):  # four bytes more at a time
            more = np.zeros(rank.shape, np.int64)
            for k in range(lo, min(lo + 4, PERIOD)):
                more = more << 8 | padded[:, self.at + k]
            rank = _ranked(rank << 32 | more)
        self.reach = PERIOD
        while self.reach * 2 <= depth:
            next_at = self.at + self.reach
            there = np.where(next_at < width, self.column[np.minimum(next_at, width - 1)], -1)
            rank = _ranked(rank << 31 | np.where(there >= 0, rank[:, there] + 1, 0))
            self.reach *= 2
        self.rank = rank


def _sort_buckets(side: int, own: list[list]) -> pa.RecordBatch:
    """Shifts of each row, between its ``lo`` and ``hi``, at which another row of its bucket has the same window."""
    b1, b2, ranks, checks, left, right, many, lo, hi = own
    rows, has = _sides(left, right, side)
    bucket = np.unique(np.array([b1, b2], np.int64), axis=1, return_inverse=True)[1].ravel()
    shifts = np.arange(side + 1)
    has &= (shifts >= np.array(lo)[:, None]) & (shifts <= np.array(hi)[:, None])
    sample = _Sample(bucket, rows, side - PERIOD + 1)
    step = np.array([next(j for j in range(PERIOD) if (side - s + j) % PERIOD in COVER) for s in shifts])
    again = (side - step - sample.reach) // PERIOD * PERIOD  # from the first rank to the last one inside the window
    row, shift = np.nonzero(has)
    first = side - shift + step[shift]
    second = first + again[shift]
    ranked = (shift << 50) | sample.rank[row, sample.column[first]]
    twice = np.zeros(has.shape, bool)
    key = _ranked(_ranked(ranked) << 31 | sample.rank[row, sample.column[second]])
    tied = np.bincount(key, minlength=1)[key] > 1  # the rest is alone already by its ranks
    row, shift, key, second = row[tied], shift[tied], key[tied], second[tied]
    behind = second + sample.reach
    columns = [*_packed(rows, row, side - shift, step[shift]), key, *_packed(rows, row, behind, 2 * side - shift - behind)]
    order = np.lexsort(columns[::-1])
    same = np.ones(max(0, len(order) - 1), bool)
    for column in columns:
        same &= column[order[1:]] == column[order[:-1]]
    found = np.zeros(len(order), bool)
    found[1:] |= same
    found[:-1] |= same
    twice[row[order[found]], shift[order[found]]] = True
    twice = (twice | np.array(many, bool)[:, None]) & has
    return pa.RecordBatch.from_arrays([
        pa.array(ranks, pa.int64()), pa.array(checks, pa.int64()), pa.array(left, pa.binary()), pa.array(right, pa.binary()),
        pa.array([_runs(r) for r in twice], pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))),
    ], names=["rank", "check", "left", "right", "shifts"])


_BUCKET = ["rank", "check", "left", "right"]
_SORTED = ["b1", "b2", *_BUCKET, "many", "lo", "hi"]
_SHIFTS = "rank bigint, check bigint, left binary, right binary, shifts array<struct<a:int,b:int>>"


def _sorted_buckets(side: int, group: int = 2_000):
    """Rows come by bucket: whole buckets, about ``group`` rows at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[] for _ in _SORTED]
        for batch in batches:
            for at in range(0, len(batch), group):
                part = batch.slice(at, group)
                for own, name in zip(held, _SORTED):
                    own += part.column(name).to_pylist()
                if len(held[0]) >= group:
                    end = len(held[0])
                    while end and held[0][end - 1] == held[0][-1]:  # the last bucket may go on
                        end -= 1
                    if end:
                        yield _sort_buckets(side, [own[:end] for own in held])
                        held = [own[end:] for own in held]
        if held[0]:
            yield _sort_buckets(side, held)

    return run


def _cut_in_two(buckets: DataFrame, side: int) -> DataFrame:
    """The suffixes of shift ``lo`` to ``hi`` in two halves, each with a bucket for the bytes that all its windows hold."""
    middle, halves = "cast((lo + hi) div 2 as int)", []
    for x, y in (("lo", middle), (f"{middle} + 1", "hi")):
        halves.append(f"""case when greatest({x}, {side} - octet_length(right)) <= least({y}, octet_length(left)) then
            struct({x} as lo, {y} as hi,
                concat(substring(left, octet_length(left) - ({x}) + 1, {x}), substring(right, 1, {side} - ({y}))) as common) end""")
    cut = buckets.select("b1", "b2", *_BUCKET, "many", F.explode(F.array_compact(F.expr(f"array({', '.join(halves)})"))).alias("half"))
    key = [F.col("b1"), F.col("b2"), F.col("half.lo"), F.col("half.common")]
    return cut.select(F.xxhash64(F.lit(1), *key).alias("b1"), F.xxhash64(F.lit(2), *key).alias("b2"), *_BUCKET, "many",
                      F.col("half.lo").alias("lo"), F.col("half.hi").alias("hi"))


def _repeated_shifts(surroundings: DataFrame, side: int) -> DataFrame:
    """(rank, check, left, right, shifts): how far before a minimiser in these surroundings repeated windows start.

    One row for each of the surroundings, so that joining them to their places makes no more rows than places.
    """
    place = F.xxhash64("key", "at")
    merged = surroundings.groupBy(*_BUCKET).agg(F.min(place).alias("low"), F.max(place).alias("high"))
    merged = cut_lineage(merged.select(*_BUCKET, (F.col("low") != F.col("high")).alias("many")))
    rest = merged.select(F.col("rank").alias("b1"), F.col("check").alias("b2"), *_BUCKET, "many",
                         F.lit(0).alias("lo"), F.lit(side).alias("hi"))
    fitting, alone = [], []
    while True:  # each turn halves the range of shifts: at most log2(side + 1) turns after the first
        sizes = rest.groupBy("b1", "b2").agg(F.count("*").alias("n"))
        large = cut_lineage(sizes.where(F.col("n") > MOST_SORTED).select("b1", "b2"))
        if not large.count():
            fitting.append(rest)
            break
        fitting.append(rest.join(large, ["b1", "b2"], "left_anti"))
        cut = rest.join(large, ["b1", "b2"])
        alone.append(cut.where("lo = hi").select(  # a bucket of one window, which several rows have
            *_BUCKET, F.array(F.struct(F.col("lo").alias("a"), F.col("hi").alias("b"))).alias("shifts")))
        rest = cut_lineage(_cut_in_two(cut.where("lo < hi"), side))
    sort = functools.reduce(DataFrame.unionByName, fitting).select(*_SORTED)
    found = sort.repartition("b1").sortWithinPartitions("b1").mapInArrow(_sorted_buckets(side), _SHIFTS)
    shifts = functools.reduce(DataFrame.unionByName, alone, found.where(F.size("shifts") > 0))
    ranges = F.array_sort(F.flatten(F.collect_list("shifts")))  # at most one for each shift
    return shifts.groupBy(*_BUCKET).agg(ranges.alias("shifts")).withColumn("shifts", F.expr("""
        aggregate(shifts, cast(array() as array<struct<a:int,b:int>>), (done, x) -> case
            when try_element_at(done, -1).b + 1 >= x.a then concat(slice(done, 1, size(done) - 1), array(named_struct(
                'a', try_element_at(done, -1).a, 'b', greatest(try_element_at(done, -1).b, x.b))))
            else concat(done, array(x)) end)"""))


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, key, n_bytes) of ``docs``, and (key, spans): the bytes of each text that repeated windows cover."""
    scan.ship(docs.sparkSession)
    docs = docs.selectExpr("cast(doc_id as bigint) doc_id", "text")
    fields = [T.StructField("key", T.BinaryType()), T.StructField("n_bytes", T.LongType()),
              T.StructField("hashes", T.ArrayType(T.LongType()))]
    made = cut_lineage(scan.add_columns(docs, ["doc_id"], fields, _anchor_column(length)))
    texts = cut_lineage(made.groupBy("key").agg(
        F.min("doc_id").alias("doc_id"), F.count("*").alias("n"), F.max("n_bytes").alias("n_bytes"), F.first("hashes").alias("hashes")))

    anchors = texts.select("key", F.posexplode("hashes").alias("i", "hash"))
    place = F.xxhash64("key", "i")
    often = anchors.groupBy("hash").agg(F.min(place).alias("low"), F.max(place).alias("high")).where("low <> high")
    shared = anchors.join(often.select("hash"), "hash").groupBy("key").agg(F.collect_set("hash").alias("hashes"))
    wanted = cut_lineage(shared.join(texts.select("doc_id", "key"), "key"))

    fine = _fine_anchors(_wanted_texts(docs, wanted, "hashes"), length)
    place = F.xxhash64("key", "at")
    tied = fine.groupBy("rank").agg(F.min(place).alias("low"), F.max(place).alias("high")).where("low <> high")
    at = fine.join(tied.select("rank"), "rank").groupBy("key").agg(F.collect_set("at").alias("at"))
    chosen = cut_lineage(at.join(wanted.select("doc_id", "key"), "key"))
    around = cut_lineage(_surroundings(_wanted_texts(docs, chosen, "at"), length))
    found = around.join(_repeated_shifts(around, length - FINE), _BUCKET)
    one = found.select("key", "at", F.explode("shifts").alias("s")).select(
        "key", F.struct((F.col("at") - F.col("s.b")).alias("first"), (F.col("at") - F.col("s.a")).alias("last")).alias("range"))
    copies = texts.where((F.col("n") > 1) & (F.col("n_bytes") >= length)).select(
        "key", F.struct(F.lit(0).cast("bigint").alias("first"), (F.col("n_bytes") - length).alias("last")).alias("range"))
    ranges = one.unionByName(copies).groupBy("key").agg(F.collect_set("range").alias("ranges"))
    spans = ranges.mapInArrow(_merged(length), "key binary, spans array<struct<start:bigint,end:bigint>>")
    return made.select("doc_id", "key", "n_bytes"), cut_lineage(spans)


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _merged(length: int):
    """The bytes that the windows of each text cover, as few spans."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = []
            for ranges in batch.column("ranges").to_pylist():
                out: list[dict] = []
                for a, b in sorted((r["first"], r["last"] + length) for r in ranges):
                    if out and a <= out[-1]["end"]:
                        out[-1]["end"] = max(out[-1]["end"], b)
                    else:
                        out.append({"start": a, "end": b})
                spans.append(out)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(spans, _SPANS)], names=["key", "spans"])

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, spans (removed bytes, end exclusive) and kept (the bytes left) of every row."""
    rows, spans = repeated_spans(docs, length)
    by_id = rows.select("doc_id", "key").distinct().join(spans, "key").groupBy("doc_id").agg(
        F.collect_list(F.struct("key", "spans")).alias("found"))
    by_id = cut_lineage(by_id.withColumnRenamed("doc_id", "id"))
    small = _sent(by_id, F.aggregate("found", F.lit(0), lambda total, f: total + 2 * F.size(f["spans"]) + 4))
    plain = docs.selectExpr("cast(doc_id as bigint) doc_id", "text")
    joined = plain.join(small, F.col("doc_id").eqNullSafe(F.col("id")), "left").select("doc_id", "text", "found")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, sizes, spans, kept = batch.column("found").to_pylist(), [], [], []
            data, offsets = scan.text_bytes(batch.column("text"))
            for i, own in enumerate(found):
                raw = data[offsets[i] : offsets[i + 1]].tobytes()
                key = text_key(raw) if own else None
                cut = next((f["spans"] for f in own or () if f["key"] == key), [])
                edges = [0, *(x for s in cut for x in (s["start"], s["end"])), len(raw)]
                sizes.append(len(raw))
                spans.append(cut)
                kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2])) if cut else raw)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(spans, _SPANS), pa.array(kept, pa.binary())],
                names=["doc_id", "n_bytes", "spans", "kept"])

    return joined.mapInArrow(run, "doc_id bigint, n_bytes bigint, spans array<struct<start:bigint,end:bigint>>, kept binary")
