"""Alignment of two tokenizers over a corpus: linked token pairs, their document counts, and scores of documents.

Both tokenizers encode each text with a space before it. Where a token of either ends at the same byte, the text is
cut; tokens of one such group are linked, every occurrence with every occurrence of the other side.

Links are kept inverted. Documents are numbered inside containers (whole texts of one partition, some 16 MB at most
unless one text is longer); for each container and id pair there are bit planes over its documents: plane p holds the
documents whose number of links has bit p. A plane is compressed to its non-zero bytes with their places. Planes of
parts of a container are merged by OR. A pair's document count is the popcount of its planes' OR, its link count the
sum of popcounts weighted by 2^p, both summed over containers. The counts go back to the containers that hold the
pair, where the planes return them to the documents.

What moves: a row for each pair and container, and planes once. A pair that every text holds is one row a container,
without its planes; a container is a bounded group. Results are those of whole texts.

Texts that are null or empty, or whose tokens do not spell the text (characters that the second tokenizer reads as a
space), have no tokens: zeros and an empty groups_sha256. Special tokens' strings are plain text. Each row is a
document of its own, also with an equal or a null doc_id. An empty table gives an empty result. Kept columns named like
a result are replaced; others do not matter.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from transitlapse.llm import scan, tokens
from transitlapse.session import cut_lineage

CONTAINER_BYTES = 16 << 20
CONTAINER_DOCS = 1 << 15
#: Links are expanded so many at a time.
SLICE_LINKS = 1 << 21
_SPACE = "▁"  # how the second tokenizer writes a space

RESULT = T.StructType([*(T.StructField(n, T.LongType()) for n in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")),
                       T.StructField("groups_sha256", T.StringType())])
_POSTINGS = T.StructType([T.StructField("container", T.LongType()), T.StructField("pair", T.LongType()),
                          T.StructField("planes", T.ArrayType(T.BinaryType()))])


class PieceEncoder(tokens.Encoder):
    """Ids of whole texts with a piece model.

    No piece of such a model holds a space after another character, or a line break, so texts are cut before spaces
    that follow other characters and before line breaks; each distinct part is encoded once. Ids of texts that hold the
    model's own mark of a space may differ, but such texts are not spelled by their tokens in any case.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any(_SPACE in p.lstrip(_SPACE) or "\n" in p for p in pieces):
            raise ValueError("this model has pieces across words")
        self._forget()

    def _encode(self, pieces: list[bytes], plain: bool) -> tuple[np.ndarray, np.ndarray]:
        """A part starts with a space, which the model adds itself, or with a line break; one more break ends it."""
        texts = [(p[1:] if p[:1] == b" " else p).decode(errors="replace") + "\n" for p in pieces]
        ids = [np.array(x[p[:1] != b" " : -1], np.uint32) for p, x in zip(pieces, self.model.encode(texts, num_threads=1))]
        return np.concatenate([np.zeros(0, np.uint32), *ids]), np.array([len(x) for x in ids], np.int64)

    def encode(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts of a chunk, each of which is empty or starts with a space; the n + 1 offsets of each text's ids."""
        if not len(buf):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        cut = buf == 10
        cut[1:] |= (buf[1:] == 32) & (buf[:-1] != 32)
        cut[offsets[:-1][np.diff(offsets) > 0]] = True
        begin = np.flatnonzero(cut)
        end = np.append(begin[1:], len(buf))
        keys, at, back = np.unique(scan.Prefix(scan.BYTE_VALUES[buf]).window(begin, end), return_index=True, return_inverse=True)
        number = self._find(keys)
        if (fresh := np.flatnonzero(number < 0)).size:
            if len(self.begin) + len(fresh) > tokens._MOST_KNOWN:
                self._forget()
                fresh = np.arange(len(keys))
            raw, pick = buf.tobytes(), at[fresh]
            number[fresh] = self._learn(keys[fresh], [raw[a:b] for a, b in zip(begin[pick].tolist(), end[pick].tolist())], True)
        number = number[back]
        size = self.begin[number + 1] - self.begin[number]
        place = np.concatenate([[0], np.cumsum(size)])
        take = np.arange(place[-1]) + np.repeat(self.begin[number] - place[:-1], size)
        return self.ids[take], place[np.searchsorted(begin, offsets)]


class Vocabulary:
    """The bytes of every id, one after the other, and the decimal text of every id."""

    def __init__(self, entries: list[bytes]):
        self.size = np.array([len(e) for e in entries], np.int64)
        self.begin = np.concatenate([[0], np.cumsum(self.size)])
        self.data = np.frombuffer(b"".join(entries), np.uint8)

    def spelled(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        end = np.cumsum(size)
        return self.data[np.arange(end[-1] if len(end) else 0) + np.repeat(self.begin[ids] - end + size, size)]


def _byte_characters() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies: itself, or the next free from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(c): b for c, b in [*zip(shown, shown), *zip(range(256, 256 + len(hidden)), hidden)]}


@functools.lru_cache(maxsize=2)
def _coders(a_file: str, b_file: str):
    """Encoder and vocabulary of either side, once a worker."""
    a, b = tokens.Encoder(a_file), PieceEncoder(b_file)
    a.tokenizer.encode_special_tokens = True
    byte = _byte_characters()
    entries = [a.tokenizer.id_to_token(i) or "" for i in range(max(a.tokenizer.get_vocab().values()) + 1)]
    a_bytes = [bytes(byte[c] for c in e) if all(c in byte for c in e) else e.encode() for e in entries]
    b_bytes = [bytes([int(b.model.id_to_piece(i)[3:5], 16)]) if b.model.is_byte(i) else b.model.id_to_piece(i).replace(_SPACE, " ").encode()
               for i in range(b.model.get_piece_size())]
    return a, Vocabulary(a_bytes), b, Vocabulary(b_bytes)


def _texts_of(spelled: np.ndarray, size: np.ndarray, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which texts equal what their tokens spell; ``size`` is the length that is spelled for each text."""
    want = np.diff(offsets)
    same = size == want
    got, own = (spelled, buf) if same.all() else (spelled[np.repeat(same, size)], buf[np.repeat(same, want)])
    row = np.repeat(np.flatnonzero(same), want[same])
    same[row[got != own]] = False
    return same


@dataclass
class Groups:
    """Groups of some texts: ids of either side by text, the group of each id, and which ids are their group's last."""

    a: np.ndarray
    b: np.ndarray
    a_place: np.ndarray  # n + 1 offsets of the texts' ids
    b_place: np.ndarray
    a_group: np.ndarray
    b_group: np.ndarray
    a_last: np.ndarray
    b_last: np.ndarray

    def first(self, group: np.ndarray) -> np.ndarray:
        """The first id of every group, and the number of ids."""
        n = int(self.a_last.sum())
        return np.searchsorted(group, np.arange(n + 1))


def groups(buf: np.ndarray, offsets: np.ndarray, a_file: str, b_file: str) -> Groups:
    """Groups of the texts of a chunk, each of which is empty or starts with a space; texts that fail have no ids."""
    a_coder, a_words, b_coder, b_words = _coders(a_file, b_file)
    (a, a_place), (b, b_place) = a_coder.encode(buf, offsets), b_coder.encode(buf, offsets)
    fits = np.ones(len(offsets) - 1, bool)
    for ids, place, words in ((a, a_place, a_words), (b, b_place, b_words)):
        total = np.concatenate([[0], np.cumsum(words.size[ids])])
        fits &= _texts_of(words.spelled(ids), np.diff(total[place]), buf, offsets)
    if not fits.all():
        a, b = (x[np.repeat(fits, np.diff(p))] for x, p in ((a, a_place), (b, b_place)))
        a_place, b_place = (np.concatenate([[0], np.cumsum(np.diff(p) * fits)]) for p in (a_place, b_place))
    a_end, b_end = np.cumsum(a_words.size[a]), np.cumsum(b_words.size[b])
    ends = np.zeros((a_end[-1] if len(a_end) else 0) + 1, bool)
    ends[b_end] = True
    a_last = ends[a_end]
    ends[:] = False
    ends[a_end] = True
    b_last = ends[b_end]
    return Groups(a, b, a_place, b_place, np.cumsum(a_last) - a_last, np.cumsum(b_last) - b_last, a_last, b_last)


def links(g: Groups, b_size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(pair, text, number of links), distinct within each slice; a pair is the first id * ``b_size`` + the second."""
    b_first = g.first(g.b_group)
    partners = np.diff(b_first)[g.a_group]
    upto = np.cumsum(partners)
    text = np.repeat(np.arange(len(g.a_place) - 1), np.diff(g.a_place))
    at = 0
    while at < len(g.a):
        before = upto[at] - partners[at]
        last = max(at + 1, int(np.searchsorted(upto, before + SLICE_LINKS, "right")))
        n = partners[at:last]
        which = np.repeat(np.arange(at, last), n)
        other = np.arange(len(which)) + np.repeat(b_first[g.a_group[at:last]] - (upto[at:last] - n - before), n)
        pair = g.a[which].astype(np.int64) * b_size + g.b[other]
        # Pairs are below 2^31 for vocabularies of such sizes, texts of a chunk below 2^32.
        key, count = np.unique((pair << 32) | text[which], return_counts=True)
        yield key >> 32, key & 0xFFFFFFFF, count
        at = last


def groups_text(g: Groups, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The groups of all texts written out, `a1,a2|b1;a3|b2,b3`, one text after the other, and their n + 1 offsets."""
    shown = [str(i).encode() for i in range(most)]
    width = len(shown[-1]) + 1
    table = np.frombuffer(b"".join(s.ljust(width) for s in shown), np.uint8).reshape(most, width)
    length = np.array([len(s) for s in shown])
    n = len(g.a) + len(g.b)
    a_at = np.arange(len(g.a)) + g.first(g.b_group)[g.a_group]
    b_at = np.arange(len(g.b)) + g.first(g.a_group)[g.b_group + 1]
    ids, mark = np.empty(n, np.int64), np.full(n, ord(","), np.uint8)
    ids[a_at], ids[b_at] = g.a, g.b
    mark[a_at[g.a_last]], mark[b_at[g.b_last]] = ord("|"), ord(";")
    size = length[ids] + 1
    place = g.a_place + g.b_place
    size[place[1:][np.diff(place) > 0] - 1] -= 1  # nothing follows a text's last group
    rows = table[ids]
    rows[np.arange(n), length[ids]] = mark
    return rows[np.arange(width) < size[:, None]], np.concatenate([[0], np.cumsum(size)])[place]


class Container:
    """Links of some whole texts as bit planes: (pair, plane, place of a byte, bits), merged by OR."""

    def __init__(self):
        self.docs, self.size, self.parts = 0, 0, []

    def add(self, g: Groups, b_size: int, size: int) -> None:
        found = [np.concatenate(x) for x in zip(*links(g, b_size))]
        n = len(g.a_place) - 1
        if found:
            # A pair of one text may stand in two slices: add up before bits are taken.
            key, back = np.unique((found[0] << 32) | found[1], return_inverse=True)
            count = np.zeros(len(key), np.int64)
            np.add.at(count, back, found[2])
            self.parts.append(self._planes(key >> 32, (key & 0xFFFFFFFF) + self.docs, count))
        self.docs, self.size = self.docs + n, self.size + size

    @staticmethod
    def _merged(key: np.ndarray, low: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Entries with equal key and low become one; sorted by both."""
        order = np.lexsort((low, key))
        key, low, bits = key[order], low[order], bits[order]
        edge = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (low[1:] != low[:-1])])) if len(key) else order
        return key[edge], low[edge], np.bitwise_or.reduceat(bits, edge) if len(edge) else bits

    @classmethod
    def _planes(cls, pair: np.ndarray, doc: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Entries of texts that are sorted within each pair."""
        parts = []
        for plane in range(int(count.max()).bit_length()):
            has = (count >> plane) & 1 == 1
            parts.append((pair[has], (plane << 32) | (doc[has] >> 3), (1 << (doc[has] & 7)).astype(np.uint8)))
        return cls._merged(*(np.concatenate(x) for x in zip(*parts)))

    def postings(self) -> tuple[pa.Array, pa.Array]:
        """pair and its planes, each the little-endian numbers place * 256 + bits of its non-zero bytes."""
        none = np.zeros(0, np.int64)
        pair, low, bits = self._merged(*(np.concatenate(x) for x in zip(*self.parts))) if self.parts else (none, none, none.astype(np.uint8))
        plane, entry = low >> 32, (((low & 0xFFFFFFFF) << 8) | bits).astype("<u4")
        own, first, row = np.unique(pair, return_index=True, return_inverse=True)
        depth = np.maximum.reduceat(plane, first) + 1 if len(first) else none
        begin = np.concatenate([[0], np.cumsum(depth)])
        size = np.bincount(begin[row] + plane, minlength=begin[-1]) * 4
        data = pa.Array.from_buffers(pa.binary(), int(begin[-1]), [
            None, pa.py_buffer(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.py_buffer(entry)])
        return pa.array(own), pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), data)


def _entries(planes: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, plane, place and bits of every entry of a column of planes."""
    lists = np.asarray(planes.offsets, np.int64)
    flat = planes.values.slice(lists[0], lists[-1] - lists[0])
    data, offsets = scan.text_bytes(flat)
    entry = data[offsets[0] : offsets[-1]].view("<u4") if len(flat) else np.zeros(0, "<u4")
    depth = np.diff(lists)
    row = np.repeat(np.arange(len(planes)), depth)
    plane = np.arange(len(row)) - np.repeat(lists[:-1] - lists[0], depth)
    n = np.diff(offsets) // 4
    return np.repeat(row, n), np.repeat(plane, n), (entry >> 8).astype(np.int64), (entry & 0xFF).astype(np.uint8)


_POPCOUNT = np.array([i.bit_count() for i in range(256)], np.int64)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """pair, n_docs and n_links of every posting: popcounts of the OR of its planes, and of each plane."""
    for batch in batches:
        row, plane, place, bits = _entries(batch.column("planes"))
        n = batch.num_rows
        n_links = np.zeros(n, np.int64)
        np.add.at(n_links, row, _POPCOUNT[bits] << plane)
        row, _, bits = Container._merged(row, place, bits)
        docs = np.zeros(n, np.int64)
        np.add.at(docs, row, _POPCOUNT[bits])
        yield pa.RecordBatch.from_arrays([batch.column("pair"), pa.array(docs), pa.array(n_links)], names=["pair", "n_docs", "n_links"])


def _scores(postings: pa.Table, counts: pa.Table) -> pa.Table:
    """What the pairs of one container return to its texts: links that are best, and the sum of their counts."""
    postings, counts = postings.sort_by("pair").combine_chunks(), counts.sort_by("held")
    row, plane, place, bits = _entries(postings.column("planes").chunk(0))
    n_docs, best = (counts.column(c).to_numpy().astype(np.int64) for c in ("n_docs", "best"))
    each = np.unpackbits(bits[:, None], axis=1, bitorder="little")
    entry, bit = np.nonzero(each)
    doc = place[entry] * 8 + bit
    size = int(doc.max()) + 1
    out = []
    for value in (best, n_docs):
        total = np.zeros(size, np.int64)
        np.add.at(total, doc, value[row[entry]] << plane[entry])
        out.append(total)
    own = np.unique(doc)
    container = postings.column("container")[0].as_py()
    return pa.table({"container": pa.array(np.full(len(own), container)), "number": pa.array(own), "n_best": pa.array(out[0][own]),
                     "count_sum": pa.array(out[1][own])})


@dataclass
class Alignment:
    """documents: kept columns and results of each text; pairs: a, b, n_docs, n_links, best of every linked id pair."""

    documents: DataFrame
    pairs: DataFrame


def align(docs: DataFrame, a_file: str, b_file: str, keep: list[str], text: str = "text") -> Alignment:
    """Link the tokens of ``a_file`` (byte-level, of the tokenizers library) with those of ``b_file`` (a piece model)."""
    scan.ship(docs.sparkSession)
    kept = [c for c in dict.fromkeys(keep) if c not in RESULT.names]
    spaced = F.when(F.length(text) > 0, F.concat(F.lit(" "), F.col(text)))
    given = docs.select(*(F.col(c).alias(f"_{i}") for i, c in enumerate(kept)), spaced.alias("text"))
    stats = T.StructType([*given.schema.fields[:-1], T.StructField("number", T.LongType()),
                          *(T.StructField(n, T.LongType()) for n in ("n_a", "n_b", "n_groups", "n_links")), T.StructField("groups_sha256", T.StringType())])
    schema = T.StructType([*_POSTINGS.fields, *stats.fields])

    def run(batches):
        _, a_words, _, b_words = _coders(a_file, b_file)
        b_size, most = len(b_words.size), max(len(a_words.size), len(b_words.size))
        named, container, base = None, Container(), TaskContext.get().partitionId() << 32

        def full(columns: dict[str, pa.Array], n: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in named], schema=named)

        def closed():
            pair, planes = container.postings()
            for at in range(0, len(pair), 20_000):
                part = pair.slice(at, 20_000)
                yield full({"container": pa.array(np.full(len(part), base)), "pair": part, "planes": planes.slice(at, 20_000)}, len(part))

        for batch in batches:
            named = named or pa.schema([("container", pa.int64()), ("pair", pa.int64()), ("planes", pa.list_(pa.binary())),
                                        *[batch.schema.field(f"_{i}") for i in range(len(kept))], ("number", pa.int64()), ("n_a", pa.int64()),
                                        ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string())])
            for first, last, buf, offsets in scan.chunks(batch.column("text")):
                if container.docs and (container.size + len(buf) > CONTAINER_BYTES or container.docs + last - first > CONTAINER_DOCS):
                    yield from closed()
                    container, base = Container(), base + 1
                g = groups(buf, offsets, a_file, b_file)
                number = container.docs + np.arange(last - first)
                container.add(g, b_size, len(buf))
                n_a, n_b = np.diff(g.a_place), np.diff(g.b_place)
                ends = np.concatenate([[0], np.cumsum(g.a_last)])[g.a_place]
                both = np.concatenate([[0], np.cumsum(np.diff(g.first(g.a_group)) * np.diff(g.first(g.b_group)))])
                written, place = groups_text(g, most)
                hashed = [hashlib.sha256(written[x:y]).hexdigest() if x < y else "" for x, y in zip(place[:-1].tolist(), place[1:].tolist())]
                yield full({"container": pa.array(np.full(last - first, base)), "number": pa.array(number), "n_a": pa.array(n_a), "n_b": pa.array(n_b),
                            "n_groups": pa.array(np.diff(ends)), "n_links": pa.array(np.diff(both[ends])), "groups_sha256": pa.array(hashed, pa.string()),
                            **{f"_{i}": batch.column(f"_{i}").slice(first, last - first) for i in range(len(kept))}}, last - first)
        if named:
            yield from closed()

    table = cut_lineage(given.mapInArrow(run, schema))
    postings = table.where(F.col("pair").isNotNull()).select("container", "pair", "planes")
    b_size = len(_coders(a_file, b_file)[3].size)
    counted = postings.select("pair", "planes").mapInArrow(_counts, "pair bigint, n_docs bigint, n_links bigint")
    pairs = counted.groupBy("pair").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_links").alias("n_links"))
    a, b = F.expr(f"pair div {b_size}"), F.col("pair") % b_size
    pairs = cut_lineage(pairs.withColumn("a", a).withColumn("b", b).withColumn(
        "best", F.col("n_docs") == F.max("n_docs").over(Window.partitionBy("a"))))  # at most b_size pairs an id
    held = postings.select(F.col("container").alias("home"), F.col("pair").alias("held"))
    told = held.join(pairs.select("pair", "n_docs", "best"), F.col("held") == F.col("pair")).select("home", "held", "n_docs", "best")
    scores = postings.groupBy("container").cogroup(told.groupBy("home")).applyInArrow(
        _scores, "container bigint, number bigint, n_best bigint, count_sum bigint")
    found = table.where(F.col("number").isNotNull()).drop("pair", "planes").join(scores, ["container", "number"], "left")
    zero = [F.coalesce(n, F.lit(0)).cast("bigint").alias(n) if n in ("n_best", "count_sum") else F.col(n) for n in RESULT.names]
    documents = found.select(*(F.col(f"_{i}").alias(c) for i, c in enumerate(kept)), *zero)
    return Alignment(documents, pairs.select("a", "b", "n_docs", "n_links", "best"))
