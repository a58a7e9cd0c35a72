"""Near-duplicate texts by order MinHash, verified by banded alignment.

A text is its sequence of lower-case words. Its runs of a few words (three; two and one in short texts) are labelled
with their occurrence number; for each of 48 hash functions the two smallest runs, in the order they have in the text,
make one sketch, so two texts share a sketch more often the more edit-similar they are. Texts with equal word sequences
are one node from the start.

Members of a sketch's bucket are first compared with the bucket's smallest and largest node: each node with the leader
it shares most sketches with, then the pairs that are still in different classes. Then all other pairs of a bucket that
are in different classes, as far as their lengths, the places of the shared sketch and the number of words they can have
in common allow a link; that number is bounded from above by bit maps of the words, so no link is lost. A pair is linked if
the edit distance of the word sequences is at most a fifth of the longer one, found by alignment in a band that is
widened as needed. Classes are the connected components of links.

Of pairs that share a sketch none is left out. Pairs just at the similarity, with a fifth of the words exchanged at
random, share one with a probability of 0.96 to 1 (``tests/llm/test_near_dedup.py`` measures it by length); at 0.85 it is
above 0.995.

Texts without words are equal if their characters are; null counts as empty. A class's id is its smallest doc_id
(null if no document has one). Repeated rows are one node. An empty table gives empty results; other columns are not
kept by ``classes`` and all kept by ``one_of_each``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from transitlapse.llm import scan
from transitlapse.operators.linking import connected_components
from transitlapse.session import cut_lineage

#: Words of a run, and the least and the most words of the texts that are sketched with it. Two texts at the similarity
#: differ in length by a quarter at most, so they always have a length of runs in common. Shorter texts than the least
#: have no partner but equal ones.
RUNS = ((1, 4, 12), (2, 10, 37), (3, 30, 1 << 62))
PICK = 2
SKETCHES = 48
SIMILARITY = 0.8
#: Numbers of 64 bits in the bit map of a text's words.
MARKS = 16
#: Ids of candidates are sent to every executor up to this many (about 60 bytes each), joined by shuffle beyond.
MOST_SENT = 1_000_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_IS_WORD = np.isin(np.arange(256), list(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")) | (np.arange(256) >= 128)
_MANY = scan.mix(np.arange(SKETCHES, dtype=np.uint64), 21) | np.uint64(1)
_SHIFT = scan.mix(np.arange(SKETCHES, dtype=np.uint64), 22)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def _words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word and each text's first word."""
    low = _LOWER[buf]
    start, end, first = scan.words(low, offsets, _IS_WORD)
    return scan.Prefix(scan.BYTE_VALUES[low]).window(start, end), first


def _keys(buf: np.ndarray, offsets: np.ndarray, word: np.ndarray, first: np.ndarray) -> list[bytes]:
    """128-bit identity of each text's word sequence; of its bytes where it has no words."""
    parts = []
    for base, salt in ((0x9E3779B97F4A7C15, 31), (0xD1342543DE82EF95, 32)):
        by_word = scan.Prefix(scan.mix(word, salt), base).window(first[:-1], first[1:])
        by_byte = scan.Prefix(scan.mix(scan.BYTE_VALUES_2[buf], salt), base).window(offsets[:-1], offsets[1:])
        n = np.diff(first).astype(np.uint64)
        parts.append(scan.mix(np.where(n > 0, by_word + n, by_byte + np.diff(offsets).astype(np.uint64)), salt))
    raw = np.stack(parts, 1).astype("<u8").tobytes()
    return [raw[16 * i : 16 * i + 16] for i in range(len(offsets) - 1)]


def sketches(word: np.ndarray, first: np.ndarray, words_a_run: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Order MinHash of texts with at least ``words_a_run`` words each: sketches, and the place of each one's first run."""
    count = np.diff(first)
    runs = count - words_a_run + 1
    place = np.concatenate([[0], np.cumsum(runs)])
    text = np.repeat(np.arange(len(count)), runs)
    at = np.arange(place[-1]) - place[text] + first[text]
    run = scan.Prefix(word).window(at, at + words_a_run)
    # The occurrence number of each run in its text.
    own = scan.mix(run + scan.mix(text.astype(np.uint64), 23))
    order = np.argsort(own, kind="stable")
    new = np.concatenate([[True], own[order][1:] != own[order][:-1]])
    number = np.empty(len(run), np.uint64)
    number[order] = np.arange(len(run)) - np.maximum.accumulate(np.where(new, np.arange(len(run)), 0))
    run = scan.mix(run + number * np.uint64(0x2545F4914F6CDD1D), salt)
    begin = place[:-1]
    out, places = np.zeros((len(count), SKETCHES), np.uint64), np.zeros((len(count), SKETCHES), np.int32)
    for k in range(SKETCHES):
        value = (run ^ _SHIFT[k]) * _MANY[k]
        value ^= value >> np.uint64(32)
        picked = []
        for _ in range(PICK):
            least = np.minimum.reduceat(value, begin)
            hit = np.flatnonzero(value == least[text])
            where = np.full(len(count), -1, np.int64)
            where[text[hit[::-1]]] = hit[::-1]
            picked.append(np.where(least == _NONE, -1, where))
            value[hit] = _NONE
        sketch = np.full(len(count), salt * SKETCHES + k, np.uint64)
        picked = np.sort(np.stack(picked), axis=0)
        for place_of in picked:
            sketch = scan.mix(sketch * np.uint64(5) + np.where(place_of < 0, np.uint64(0), run[place_of]), 25)
        out[:, k] = sketch
        places[:, k] = np.where(picked < 0, len(run), picked).min(axis=0) - begin
    return out, places


def text_sketches(word: np.ndarray, first: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Sketches and places of every text, of each length of runs that is for its number of words."""
    count = np.diff(first)
    out: list[list[np.ndarray]] = [[] for _ in count]
    at: list[list[np.ndarray]] = [[] for _ in count]
    for words_a_run, least, most in RUNS:
        some = np.flatnonzero((count >= least) & (count <= most))
        if len(some):
            take = np.concatenate([np.arange(first[i], first[i + 1]) for i in some])
            own = np.concatenate([[0], np.cumsum(count[some])])
            for i, x, y in zip(some, *sketches(word[take], own, words_a_run, 24 + words_a_run)):
                out[i].append(x)
                at[i].append(y)
    none = np.zeros(0, np.uint64), np.zeros(0, np.int32)
    return [np.concatenate(x) if x else none[0] for x in out], [np.concatenate(x) if x else none[1] for x in at]


def word_marks(code: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Bit map of each text's words, each word told apart by its occurrence number.

    A word that only one of two texts has sets at most one bit that only that one has, so the bits in common and the
    lesser of the two numbers of words that set no bit of their own bound the words in common from above.
    """
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    own = scan.mix(code.astype(np.uint64) + scan.mix(text.astype(np.uint64), 26))
    order = np.argsort(own, kind="stable")
    new = np.ones(len(own), bool)
    new[1:] = own[order][1:] != own[order][:-1]
    number = np.empty(len(own), np.uint64)
    number[order] = np.arange(len(own)) - np.maximum.accumulate(np.where(new, np.arange(len(own)), 0))
    bit = scan.mix(code.astype(np.uint64) + number * np.uint64(0x2545F4914F6CDD1D), 27) % np.uint64(64 * MARKS)
    out = np.zeros((len(first) - 1, MARKS), np.uint64)
    np.bitwise_or.at(out, (text, (bit >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (bit & np.uint64(63)))
    return out


def _sketch_column(column: pa.Array) -> list[pa.Array]:
    keys, found, at, words, marks, spare = [], [], [], [], [], []
    for _, _, buf, offsets in scan.chunks(column, 2 * scan.CHUNK_BYTES):
        word, first = _words(buf, offsets)
        keys += _keys(buf, offsets, word, first)
        own, places = text_sketches(word, first)
        found += [x.view(np.int64) for x in own]
        at += places
        words += np.diff(first).tolist()
        own = word_marks(word >> np.uint64(32), first)
        marks += list(own.view(np.int64))
        spare += (np.diff(first) - np.bitwise_count(own).sum(axis=1, dtype=np.int64)).tolist()
    return [pa.array(keys, pa.binary()), pa.array(found, pa.list_(pa.int64())), pa.array(at, pa.list_(pa.int32())),
            pa.array(words, pa.int32()), pa.array(marks, pa.list_(pa.int64())), pa.array(spare, pa.int32())]


def _key_column(column: pa.Array) -> list[pa.Array]:
    keys = []
    for _, _, buf, offsets in scan.chunks(column):
        keys += _keys(buf, offsets, *_words(buf, offsets))
    return [pa.array(keys, pa.binary())]


def _code_column(column: pa.Array) -> list[pa.Array]:
    """Key, and the words as 32-bit numbers."""
    keys, codes = [], []
    for _, _, buf, offsets in scan.chunks(column):
        word, first = _words(buf, offsets)
        keys += _keys(buf, offsets, word, first)
        raw = (word >> np.uint64(32)).astype("<u4")
        codes += [raw[a:b].tobytes() for a, b in zip(first[:-1], first[1:])]
    return [pa.array(keys, pa.binary()), pa.array(codes, pa.binary())]


def banded_distances(pairs: list[tuple[np.ndarray, np.ndarray]], band: int) -> np.ndarray:
    """Edit distance of each pair as far as an alignment stays ``band`` off the diagonal; right where it is at most ``band``."""
    width, far = 2 * band + 1, 1 << 29
    rows = max(len(a) for a, _ in pairs)
    left = np.full((len(pairs), rows), -2, np.int64)
    right = np.full((len(pairs), rows + width + max(len(b) for _, b in pairs)), -1, np.int64)
    for i, (a, b) in enumerate(pairs):
        left[i, : len(a)] = a
        right[i, band : band + len(b)] = b
    size = np.array([len(a) for a, _ in pairs])
    last = np.array([len(b) - len(a) + band for a, b in pairs])
    reached = (last >= 0) & (last < width)
    step = np.arange(width, dtype=np.int32)
    row = np.broadcast_to(np.where(step >= band, step - band, far).astype(np.int32), (len(pairs), width)).copy()
    out = np.full(len(pairs), far)
    ends: dict[int, list[int]] = {}
    for i in np.flatnonzero(reached):
        ends.setdefault(int(size[i]), []).append(int(i))
    for i in range(rows + 1):
        if i:
            best = row + (left[:, i - 1 : i] != right[:, i - 1 : i - 1 + width])
            best[:, :-1] = np.minimum(best[:, :-1], row[:, 1:] + 1)
            row = np.minimum.accumulate(best - step, axis=1) + step
        for p in ends.get(i, ()):
            out[p] = row[p, last[p]]
    return out


def similar(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, int] | bool:
    """Whether two word sequences are linked where that is plain; else what is left to align and the edits allowed."""
    longer = max(len(a), len(b))
    allowed = int((1 - SIMILARITY) * longer + 1e-9)
    if abs(len(a) - len(b)) > allowed:
        return False
    # The multisets of words bound the distance from below.
    words, n = np.unique(np.concatenate([a, b]), return_inverse=True)
    common = np.minimum(np.bincount(n[: len(a)], minlength=len(words)), np.bincount(n[len(a) :], minlength=len(words))).sum()
    if longer - common > allowed:
        return False
    short = min(len(a), len(b))
    differ = np.flatnonzero(a[:short] != b[:short])
    head = int(differ[0]) if len(differ) else short
    a, b, short = a[head:], b[head:], short - head
    differ = np.flatnonzero(a[len(a) - short :][::-1] != b[len(b) - short :][::-1])
    tail = int(differ[0]) if len(differ) else short
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    return max(len(a), len(b)) <= allowed or (a, b, allowed)


def _groups(pairs: list[tuple], band: int, numbers: int) -> Iterator[list[tuple]]:
    """Pairs of like length, so many that their padded rows hold about ``numbers`` numbers."""
    pairs.sort(key=lambda t: max(len(t[1]), len(t[2])))
    part: list[tuple] = []
    for t in pairs:
        if part and (len(part) + 1) * (max(len(t[1]), len(t[2])) + 2 * band + 1) > numbers:
            yield part
            part = []
        part.append(t)
    if part:
        yield part


def linked(pairs: list[tuple[np.ndarray, np.ndarray]], numbers: int = 1 << 18) -> np.ndarray:
    """For each pair of word sequences whether its edit similarity is at least ``SIMILARITY``."""
    out, todo = np.zeros(len(pairs), bool), []
    for i, (a, b) in enumerate(pairs):
        found = similar(a, b)
        if isinstance(found, bool):
            out[i] = found
        else:
            todo.append((i, *found))
    band = 8
    while todo:
        left: list[tuple] = []
        for part in _groups(todo, band, numbers):
            for (i, a, b, allowed), d in zip(part, banded_distances([(a, b) for _, a, b, _ in part], band)):
                if d <= min(band, allowed):
                    out[i] = True
                elif band < allowed:
                    left.append((i, a, b, allowed))
        todo, band = left, band * 4
    return out


def _verified(pairs: DataFrame, codes: DataFrame) -> DataFrame:
    """The pairs (a, b) of keys whose texts are linked."""
    side = lambda x: codes.select(F.col("key").alias(x), F.col("codes").alias(f"codes_{x}"))
    both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")

    def run(batches):
        for batch in batches:
            for lo in range(0, len(batch), 500):
                part = batch.slice(lo, 500)
                sides = [[np.frombuffer(x, "<u4") for x in part.column(f"codes_{s}").to_pylist()] for s in "ab"]
                yield part.filter(pa.array(linked(list(zip(*sides))))).select(["a", "b"])

    return both.select("a", "b", "codes_a", "codes_b").mapInArrow(run, "a binary, b binary")


def _labels(links: DataFrame) -> DataFrame:
    return cut_lineage(connected_components(links.select(F.col("a").alias("src"), F.col("b").alias("dst"))))


def _apart(members: DataFrame, label: DataFrame) -> DataFrame:
    """``members`` with the class of each node, of the sketches that several classes have, without their leaders."""
    of = label.select(F.col("node").alias("key"), F.col("component").alias("of"))
    placed = members.join(of, "key", "left").withColumn("of", F.coalesce("of", "key"))
    several = placed.groupBy("sketch").agg(F.min("of").alias("x"), F.max("of").alias("y"), F.min("key").alias("low"),
                                           F.max("key").alias("high")).where("x <> y").select("sketch", "low", "high")
    return placed.join(several, "sketch").where("key <> low AND key <> high").drop("low", "high").distinct()


#: Whether the sides a and b of a shared sketch can be linked: lengths, places and words in common within the edits
#: allowed. Side b is the one in the longer band; in one band both see each other, so there the keys decide.
_CAN = f"""a.sketch = b.sketch AND a.near = b.band AND a.near_cell = b.cell AND a.of <> b.of
    AND (a.band < b.band OR a.key < b.key)
    AND abs(a.words - b.words) <= floor(greatest(a.words, b.words) * 0.2 + 1e-9)
    AND abs(a.place - b.place) <= floor(greatest(a.words, b.words) * 0.2 + 1e-9)
    AND {" + ".join(f"bit_count(a.m{i} & b.m{i})" for i in range(MARKS))} + least(a.spare, b.spare)
        >= greatest(a.words, b.words) - floor(greatest(a.words, b.words) * 0.2 + 1e-9)"""


def _rest_of_buckets(members: DataFrame, marks: DataFrame, label: DataFrame) -> DataFrame:
    """All pairs (a, b) of one bucket in different classes, leaders apart, that may be linked by ``_CAN``.

    A bucket is split before it is joined: by bands of length, a factor of 1.25 each, so that partners are at most a
    band apart, and by the place of the sketch in cells twice as wide as the edits allowed in the band.
    """
    left = cut_lineage(_apart(members, label))
    nodes = left.select("key").distinct()
    own = cut_lineage(marks.join(nodes, "key", "left_semi").dropDuplicates(["key"]).select(
        "key", "spare", *[F.col("marks")[i].alias(f"m{i}") for i in range(MARKS)]))
    left = left.join(own, "key").withColumn("band", F.floor(F.log(F.col("words").cast("double")) / F.log(F.lit(1.25))))
    edits = lambda b: F.lit(0.25) * F.pow(F.lit(1.25), b) + F.lit(1e-6)
    cell = lambda place, b: F.floor(place / (2 * edits(b)))
    a = left.withColumn("near", F.explode(F.sequence("band", F.col("band") + 1))).withColumn("near_cell", F.explode(
        F.sequence(cell(F.col("place") - edits(F.col("near")), F.col("near")), cell(F.col("place") + edits(F.col("near")), F.col("near")))))
    b = left.withColumn("cell", cell(F.col("place"), F.col("band")))
    return a.alias("a").join(b.alias("b"), F.expr(_CAN)).select(
        F.least("a.key", "b.key").alias("a"), F.greatest("a.key", "b.key").alias("b")).distinct()


def _sent(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= MOST_SENT else df


def _codes(docs: DataFrame, made: DataFrame, pairs: DataFrame) -> DataFrame:
    """Key and codes of the texts that the pairs (a, b) name."""
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    wanted = cut_lineage(made.select("key", "doc_id").join(nodes, "key").groupBy("key").agg(F.min("doc_id").alias("doc_id")))
    n = wanted.count()
    ids = _sent(wanted.select(F.col("doc_id").alias("id")).distinct(), n)
    texts = docs.selectExpr("cast(doc_id as bigint) doc_id", "text")
    texts = texts.join(ids, F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")
    fields = [T.StructField("key", T.BinaryType()), T.StructField("codes", T.BinaryType())]
    codes = scan.add_columns(texts, ["doc_id"], fields, _code_column).join(
        _sent(wanted.select("key", F.col("doc_id").alias("id")), n), "key").where(
        F.col("doc_id").eqNullSafe(F.col("id"))).select("key", "codes")
    return cut_lineage(codes.dropDuplicates(["key"]))


def _node_classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key) of every document, and (node, component) of every linked key."""
    fields = [T.StructField("key", T.BinaryType()), T.StructField("sketches", T.ArrayType(T.LongType())),
              T.StructField("places", T.ArrayType(T.IntegerType())), T.StructField("words", T.IntegerType()),
              T.StructField("marks", T.ArrayType(T.LongType())), T.StructField("spare", T.IntegerType())]
    made = cut_lineage(scan.add_columns(docs.selectExpr("cast(doc_id as bigint) doc_id", "text"), ["doc_id"], fields, _sketch_column))
    members = made.select("key", "words", F.explode(F.arrays_zip("sketches", "places")).alias("s")).select(
        "key", "words", F.col("s.sketches").alias("sketch"), F.col("s.places").alias("place"))
    buckets = members.groupBy("sketch").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low <> high")
    near = members.join(buckets, "sketch").select("key", F.explode(F.array("low", "high")).alias("leader")).where("key <> leader")
    pairs = near.select(F.least("key", "leader").alias("a"), F.greatest("key", "leader").alias("b"))
    pairs = cut_lineage(pairs.groupBy("a", "b").agg(F.count("*").alias("votes")))

    codes = _codes(docs, made, pairs)

    # Each node with the neighbour it shares most sketches with, then what is still apart.
    ends = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("key"), F.struct("votes", "a", "b").alias("pair")),
                                          F.struct(F.col("b").alias("key"), F.struct("votes", "a", "b").alias("pair")))).alias("e"))
    best = ends.groupBy("e.key").agg(F.max("e.pair").alias("pair")).select("pair.a", "pair.b").distinct()
    sure = cut_lineage(_verified(best, codes))
    label = _labels(sure)
    of = lambda x: label.select(F.col("node").alias(x), F.col("component").alias(f"of_{x}"))
    apart = pairs.join(best.withColumn("done", F.lit(True)), ["a", "b"], "left").where("done is null")
    apart = apart.join(of("a"), "a", "left").join(of("b"), "b", "left").where(
        F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b")
    more = cut_lineage(_verified(cut_lineage(apart), codes))
    links = sure.unionByName(more)
    if more.limit(1).count():
        label = _labels(links)

    # What the leaders leave apart: every other pair of a bucket.
    rest = cut_lineage(_rest_of_buckets(members, made.select("key", "marks", "spare"), label).join(pairs.select("a", "b"), ["a", "b"], "left_anti"))
    if rest.limit(1).count():
        found = cut_lineage(_verified(rest, _codes(docs, made, rest)))
        if found.limit(1).count():
            label = _labels(links.unionByName(found))
    return made.select("doc_id", "key"), label


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (the smallest doc_id of its class), class_size (documents) of every row of ``docs``."""
    rows, label = _node_classes(docs)
    per_key = rows.groupBy("key").agg(F.min("doc_id").alias("low"), F.count("*").alias("n"))
    placed = per_key.join(label.withColumnRenamed("node", "key"), "key", "left")
    placed = cut_lineage(placed.select("key", F.coalesce("component", "key").alias("component"), "low", "n"))
    whole = placed.groupBy("component").agg(F.min("low").alias("class_id"), F.sum("n").alias("class_size"))
    return rows.join(placed.join(whole, "component").select("key", "class_id", "class_size"), "key").select(
        "doc_id", "class_id", "class_size")


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each class: its smallest doc_id; of rows that share that id and text, one."""
    rows, label = _node_classes(docs)
    per_key = rows.groupBy("key").agg(F.min("doc_id").alias("low"), F.count("*").alias("n"))
    placed = per_key.join(label.withColumnRenamed("node", "key"), "key", "left")
    placed = cut_lineage(placed.select("key", F.coalesce("component", "key").alias("component"), "low", "n"))
    first = placed.groupBy("component").agg(F.min(F.struct(F.col("low").isNull(), "low", "key")).alias("first"))
    placed = placed.join(first, "component").select(
        "key", (F.col("key") == F.col("first.key")).alias("chosen"), "low", "n").where("not chosen or n > 1")
    placed = cut_lineage(placed.select("key", F.when(F.col("chosen"), "keep").otherwise("drop").alias("fate"), "low"))
    plain, names, text = scan.numbered_columns(docs)
    tagged = scan.add_columns(plain, names, [T.StructField("key", T.BinaryType())], _key_column, text)
    own_id = F.col(names[docs.columns.index("doc_id")])
    given = [F.col(n).alias(c) for n, c in zip(names, docs.columns)]
    fate = _sent(placed.select("key", "fate", "low"), placed.count())
    kept = tagged.join(fate, "key", "left").where(
        F.col("fate").isNull() | ((F.col("fate") == "keep") & own_id.eqNullSafe(F.col("low"))))
    alone = kept.where("fate is null").select(*given)
    # Exact copies whose smallest id occurs in several rows: one row of each.
    copied = rows.join(placed.where("fate = 'keep'"), "key").where(F.col("doc_id").eqNullSafe(F.col("low")))
    if copied.groupBy("key").count().where("count > 1").limit(1).count():
        return alone.unionByName(kept.where("fate is not null").dropDuplicates(["key"]).select(*given))
    return kept.select(*given)
