"""Personal data by patterns and a skip-chain conditional random field.

Base spans are the leftmost matches of four patterns (e-mail, IP address, card, phone), found from runs of bytes in
linear time. A conditional random field over the tokens that hold a digit or an ``@`` adds what the patterns miss: a
number written without its plus sign, a card next to other digits, a repeated mention with a typing error. Tokens
that follow each other directly are linked; distant tokens that are equal or similar are linked through one shared
node for each group, so a group of n tokens costs n links. Tokens in base spans are given, and so are the shared nodes of their
groups; loopy message passing
carries their labels to the others. A fixed number of rounds makes a text's result independent of its neighbours.

The weights are trained on ``sample_docs`` documents at most (those with the smallest hash of their text, of at most
``MOST_TOKENS`` such tokens): half of their base spans are hidden, and the gradient is the difference of expected
features with all labels given and with the visible ones given. Where there is nothing to learn from, the links keep
their prior weights and nothing is added.

Positions are code points. Null counts as an empty text; empty texts have no spans. Equal texts get equal spans, an
added span never overlaps a base span, spans of equal start are ordered by kind. An empty table gives an empty result.
Kept columns named like a result are replaced. A text is worked on whole, in arrays of some 40 bytes a byte of text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from transitlapse.llm import scan

KINDS = ("email", "ip", "card", "phone")
SAMPLE_DOCS = 3_000
MOST_TOKENS = 500
ROUNDS = 15
SURE = 0.5

SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()),
                                  T.StructField("end", T.IntegerType()), T.StructField("base", T.BooleanType())]))

_BYTES = np.arange(256)
_DIGIT = np.isin(_BYTES, list(b"0123456789"))
_LETTER = np.isin(_BYTES, list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"))
_LOCAL = _DIGIT | _LETTER | np.isin(_BYTES, list(b"._%+-"))
_PHONE = _DIGIT | np.isin(_BYTES, list(b" ().-"))
_HOST = re.compile(rb"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: Tokens end at white space, control characters and these marks.
_TOKEN = (_BYTES > 32) & ~np.isin(_BYTES, list(b",;=|\"'<>[]{}\x7f"))


def luhn(digits: np.ndarray) -> bool:
    """Whether the check sum of digits (0..9) is divisible by ten."""
    turned = digits[::-1].astype(np.int64)
    twice = turned[1::2] * 2
    return int(turned[::2].sum() + (twice - 9 * (twice > 9)).sum()) % 10 == 0


def _chains(start: np.ndarray, end: np.ndarray, linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last run of each chain; ``linked[i]`` joins run i to run i + 1."""
    if not len(start):
        return start, start
    edge = np.concatenate([[True], ~linked])
    first = np.flatnonzero(edge)
    return first, np.append(first[1:], len(start)) - 1


def base_spans(buf: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int]]:
    """(kind, start, end) in bytes of the chunk, by kind and start."""
    found: list[tuple[int, int, int]] = []
    raw = buf.tobytes()
    text_end = lambda at: int(offsets[np.searchsorted(offsets, at, "right")])
    if b"@" in raw:
        start, end, _ = scan.words(buf, offsets, _LOCAL)
        at = np.searchsorted(end, np.flatnonzero(buf == ord("@")))
        done = 0
        for begin, sign in zip(start[at[at < len(end)]].tolist(), end[at[at < len(end)]].tolist()):
            begin = max(begin, done)
            if raw[sign : sign + 1] == b"@" and begin < sign < (stop := text_end(sign - 1)) and (m := _HOST.match(raw, sign + 1, stop)):
                found.append((0, begin, m.end()))
                done = m.end()
    start, end, of_text = scan.words(buf, offsets, _DIGIT)
    text = np.searchsorted(offsets, start, "right")
    if len(start) > 1:
        near = (start[1:] - end[:-1] == 1) & (text[1:] == text[:-1])
        between = np.where(near, buf[np.minimum(end[:-1], len(buf) - 1)], 0)
        # IP: chains of runs with single dots, four runs at a time.
        first, last = _chains(start, end, between == ord("."))
        for a, b in zip(first[last - first >= 3].tolist(), last[last - first >= 3].tolist()):
            for i in range(a, b - 2, 4):
                parts = [raw[x:y].lstrip(b"0") or b"0" for x, y in zip(start[i : i + 4].tolist(), end[i : i + 4].tolist())]
                if all(len(p) <= 3 and int(p) <= 255 for p in parts):
                    found.append((1, int(start[i]), int(end[i + 3])))
        first, last = _chains(start, end, (between == ord(" ")) | (between == ord("-")) | (start[1:] == end[:-1]) & near)
    else:
        first = last = np.arange(len(start))
    upto = np.concatenate([np.zeros(1, np.int32), np.cumsum(_DIGIT[buf], dtype=np.int32)])
    n = upto[end[last]] - upto[start[first]] if len(first) else first
    for a, b in zip(first[(n >= 13) & (n <= 19)].tolist(), last[(n >= 13) & (n <= 19)].tolist()):
        own = buf[start[a] : end[b]]
        if luhn(own[_DIGIT[own]] - 48):
            found.append((2, int(start[a]), int(end[b])))
    plus = np.flatnonzero(buf == ord("+"))
    plus = plus[(plus + 1 < len(buf)) & _DIGIT[buf[np.minimum(plus + 1, len(buf) - 1)]]]
    plus = plus[np.searchsorted(offsets, plus, "right") == np.searchsorted(offsets, plus + 1, "right")]  # in one text
    if len(plus):
        start, end, _ = scan.words(buf, offsets, _PHONE)
        last_digit = np.maximum.accumulate(np.where(_DIGIT[buf], np.arange(len(buf)), -1))
        for sign in plus.tolist():
            run = np.searchsorted(start, sign + 1)
            if run < len(start) and start[run] == sign + 1:
                stop = int(last_digit[end[run] - 1]) + 1
                if stop >= sign + 4 and 9 <= upto[stop] - upto[sign] <= 15:
                    found.append((3, sign, stop))
    return sorted(found)


FEATURES = ("bias", "no digit", "1-2 digits", "3 digits", "4 digits", "5-6 digits", "7 digits", "8-12 digits", "13-19 digits",
            "20 or more digits", "letters", "address", "at sign", "four parts", "check sum", "hyphen", "three and four",
            "parenthesis", "plus", "other marks")
_N_DIGITS = np.array([0, 1, 3, 4, 5, 7, 8, 13, 20])


@dataclass
class Graph:
    """Tokens of some texts as nodes, then the shared nodes of their groups; links by kind (chain, equal, similar)."""

    start: np.ndarray
    end: np.ndarray
    features: np.ndarray
    label: np.ndarray  # of the base span that the token touches (1 + kind), else 0
    nodes: int
    source: np.ndarray
    target: np.ndarray
    kind: np.ndarray
    follows: np.ndarray  # whether the token follows the one before directly
    text: np.ndarray


def _trimmed(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Without marks around: from the first letter, digit, plus or opening parenthesis to the last letter, digit or closing one."""
    plain, at = _DIGIT | _LETTER, np.arange(len(buf))
    opening = np.where((plain | np.isin(_BYTES, list(b"+(")))[buf], at, len(buf))
    closing = np.where((plain | (_BYTES == ord(")")))[buf], at, -1)
    return np.minimum.accumulate(opening[::-1])[::-1][start], np.maximum.accumulate(closing)[end - 1] + 1


def graph(buf: np.ndarray, offsets: np.ndarray, spans: list[tuple[int, int, int]]) -> Graph:
    """The graph of a chunk's texts."""
    start, end, _ = scan.words(buf, offsets, _TOKEN)
    count = lambda mask: np.concatenate([np.zeros(1, np.int32), np.cumsum(mask, dtype=np.int32)])
    inside = lambda upto: upto[end] - upto[start]
    digits = count(_DIGIT[buf])
    signs = count(buf == ord("@"))
    pick = (inside(digits) > 0) | (inside(signs) > 0) & (inside(count(_LETTER[buf])) > 0)
    left, right = start[pick], end[pick]
    start, end = _trimmed(buf, left, right) if len(left) else (left, right)
    n, n_digits = len(start), inside(digits)
    letters, dots, hyphens = (inside(count(m)) for m in (_LETTER[buf], buf == ord("."), buf == ord("-")))
    x = np.zeros((n, len(FEATURES)))
    x[:, 0] = 1
    x[np.arange(n), 1 + np.searchsorted(_N_DIGITS, n_digits, "right") - 1] = 1
    x[:, FEATURES.index("letters")] = letters > 0
    x[:, FEATURES.index("at sign")] = inside(signs) > 0
    x[:, FEATURES.index("hyphen")] = hyphens > 0
    x[:, FEATURES.index("parenthesis")] = inside(count((buf == ord("(")) | (buf == ord(")")))) > 0
    x[:, FEATURES.index("plus")] = inside(count(buf == ord("+"))) > 0
    x[:, FEATURES.index("other marks")] = end - start > n_digits + letters + dots + hyphens
    raw = buf.tobytes()
    keys: list[tuple[int, int, bytes]] = []  # token, kind of link, key of its group
    for i, (a, b, d, sign) in enumerate(zip(start.tolist(), end.tolist(), n_digits.tolist(), (inside(signs) > 0).tolist())):
        token = raw[a:b]
        if sign and (m := _HOST.match(token, token.rindex(b"@") + 1)) and m.end() == len(token) and not token.startswith(b"@"):
            x[i, FEATURES.index("address")] = 1
        own = bytes(c for c in token.lower() if _DIGIT[c] or _LETTER[c])
        if d == len(own) and d in (7, 10) and token[-5:-4] == b"-":
            x[i, FEATURES.index("three and four")] = 1
        if dots[i] == 3 and d + 3 == b - a and all(0 < len(p) <= 3 and int(p) <= 255 for p in token.split(b".")):
            x[i, FEATURES.index("four parts")] = 1
        if 13 <= d <= 19 and d == len(own) and luhn(np.frombuffer(own, np.uint8) - 48):
            x[i, FEATURES.index("check sum")] = 1
        if len(own) >= 6:
            keys.append((i, 1, own))
        local = bytes(c for c in token.lower().partition(b"@")[0] if _DIGIT[c] or _LETTER[c])
        if len(local) >= 4 and len(local) > sum(_DIGIT[c] for c in local):
            keys.append((i, 2, b"@" + local))
        if d == len(own) and d >= 8:  # one wrong digit leaves one half as it is
            half = d // 2
            keys += [(i, 2, b"%d<" % d + own[:half]), (i, 2, b"%d>" % d + own[half:])]
    text = np.searchsorted(offsets, start, "right")
    label = np.zeros(n, np.int64)
    for kind, a, b in spans:
        label[np.searchsorted(end, a, "right") : np.searchsorted(start, b)] = 1 + kind
    follows = np.zeros(n, bool)
    follows[1:] = (text[1:] == text[:-1]) & (left[1:] - right[:-1] <= 2)
    groups: dict[tuple[int, int, bytes], list[int]] = {}
    for i, kind, key in keys:
        groups.setdefault((int(text[i]), kind, key), []).append(i)
    source, target, kinds = [np.flatnonzero(follows) - 1], [np.flatnonzero(follows)], [np.zeros(int(follows.sum()), np.int64)]
    nodes = n
    for (_, kind, _), members in groups.items():
        if len(members) > 1:
            source.append(np.array(members))
            target.append(np.full(len(members), nodes))
            kinds.append(np.full(len(members), kind))
            nodes += 1
    return Graph(start, end, x, label, nodes, np.concatenate(source), np.concatenate(target), np.concatenate(kinds), follows, text)


LABELS = 1 + len(KINDS)


@dataclass
class Model:
    """unary: feature x label; chain: label x label; agree: what equal and similar tokens gain with one label."""

    unary: np.ndarray = field(default_factory=lambda: np.where(np.arange(LABELS) == 0, 1.0, 0.0) * (np.array(FEATURES) == "bias")[:, None] * 3)
    chain: np.ndarray = field(default_factory=lambda: np.zeros((LABELS, LABELS)))
    agree: np.ndarray = field(default_factory=lambda: np.array([2.0, 1.0]))

    def potentials(self) -> np.ndarray:
        return np.exp(np.stack([self.chain, *(w * np.eye(LABELS) for w in self.agree)]))


def infer(g: Graph, model: Model, given: np.ndarray, x: np.ndarray | None = None, rounds: int = ROUNDS) -> tuple[np.ndarray, list[np.ndarray]]:
    """Marginals of the tokens and, for each kind of link, the sum of its joint marginals.

    ``given`` is each token's known label or -1. The shared node of a group with known tokens has their labels, in
    their proportion, however many others there are. Messages go along all links at once, halfway to their new values.
    """
    n, links = len(g.label), len(g.source)
    own = np.zeros((g.nodes, LABELS))
    own[:n] = (g.features if x is None else x) @ model.unary
    own[:n][given >= 0] = -40.0
    own[np.flatnonzero(given >= 0), given[given >= 0]] = 0.0
    known = (g.kind > 0) & (given[np.minimum(g.source, n - 1)] >= 0)
    seen = np.zeros((g.nodes, LABELS))
    np.add.at(seen, (g.target[known], given[g.source[known]]), 1.0)
    shared = np.flatnonzero(seen.any(axis=1))
    own[shared] = np.log(np.maximum(seen[shared] / seen[shared].sum(axis=1, keepdims=True), 1e-12))
    fixed = np.zeros(g.nodes, bool)
    fixed[:n], fixed[shared] = given >= 0, True
    psi = model.potentials()
    table = np.concatenate([psi[g.kind], psi[g.kind].transpose(0, 2, 1)])
    source, target = np.concatenate([g.source, g.target]), np.concatenate([g.target, g.source])
    back = np.concatenate([np.arange(links) + links, np.arange(links)])
    message = np.zeros((2 * links, LABELS))

    def beliefs() -> np.ndarray:
        return own + np.stack([np.bincount(target, message[:, k], g.nodes) for k in range(LABELS)], axis=1)

    def outgoing(total: np.ndarray) -> np.ndarray:
        out = np.where(fixed[source, None], own[source], total[source] - message[back])
        return np.exp(out - out.max(axis=1, keepdims=True))

    for _ in range(rounds if links else 0):
        new = np.log(np.einsum("el,elm->em", outgoing(beliefs()), table) + 1e-30)
        message = (message + new - new.max(axis=1, keepdims=True)) / 2
    total = beliefs()
    out = outgoing(total)
    joint = out[:links, :, None] * table[:links] * out[links:, None, :]
    joint /= joint.sum(axis=(1, 2), keepdims=True)
    marginal = np.exp(total[:n] - total[:n].max(axis=1, keepdims=True))
    return marginal / marginal.sum(axis=1, keepdims=True), [joint[g.kind == k].sum(axis=0) for k in range(3)]


def added_spans(g: Graph, marginal: np.ndarray, buf: np.ndarray) -> list[tuple[int, int, int]]:
    """Runs of tokens with one label that no base span touches; a phone number needs seven digits, a card thirteen."""
    found = marginal.argmax(axis=1)
    found[(g.label > 0) | (marginal.max(axis=1) < SURE)] = 0
    linked = g.follows[1:] & (found[1:] == found[:-1]) & (found[1:] == LABELS - 1) if len(found) else g.follows
    first, last = _chains(g.start, g.end, linked)
    spans = []
    for a, b in zip(first[found[first] > 0].tolist(), last[found[first] > 0].tolist()):
        kind, start, end = int(found[a]) - 1, int(g.start[a]), int(g.end[b])
        digits = int(_DIGIT[buf[start:end]].sum())
        if digits >= {"phone": 7, "card": 13}.get(KINDS[kind], 0):
            spans.append((kind, start, end))
    return spans


def _joined(graphs: list[Graph]) -> Graph:
    """Graphs side by side, tokens first."""
    tokens = np.cumsum([0, *(len(g.label) for g in graphs)])
    shared = tokens[-1] + np.cumsum([0, *(g.nodes - len(g.label) for g in graphs)])
    to = lambda at, g, i: np.where(at < len(g.label), at + tokens[i], at - len(g.label) + shared[i])
    cat = lambda name: np.concatenate([getattr(g, name) for g in graphs])
    return Graph(cat("start"), cat("end"), cat("features"), cat("label"), int(shared[-1]),
                 np.concatenate([to(g.source, g, i) for i, g in enumerate(graphs)]),
                 np.concatenate([to(g.target, g, i) for i, g in enumerate(graphs)]), cat("kind"), cat("follows"), cat("text"))


def fit(g: Graph, steps: int = 80, seed: int = 5) -> Model:
    """Weights from a graph with base labels: half of the labelled runs are hidden, and some of these lose their marks."""
    prior, rng = Model(), np.random.default_rng(seed)
    model = Model()
    run = np.cumsum(~(g.follows & np.concatenate([[False], g.label[1:] == g.label[:-1]])))
    hidden = (rng.random(run[-1] + 1 if len(run) else 0) < 0.5)[run] if len(run) else np.zeros(0, bool)
    x = g.features.copy()
    blind = hidden & (g.label > 0) & (rng.random(len(g.label)) < 0.5)
    twice = np.zeros(len(g.label), bool)
    twice[g.source[g.kind > 0]] = True
    marks = [FEATURES.index(f) for f in ("check sum", "four parts", "plus", "address")]
    # A mark can be missing where another mention tells; a missing plus can be anywhere.
    x[np.ix_(blind & twice, marks)] = 0
    x[blind, FEATURES.index("plus")] = 0
    given = np.where((g.label > 0) & ~hidden, g.label, -1)
    # What carries a mark but no base span, as cards that stand side by side, is no example of a clean token.
    unsure = (g.label == 0) & g.features[:, [FEATURES.index(f) for f in ("check sum", "four parts", "address")]].any(axis=1)
    labelled = np.where(unsure, -1, g.label)
    moment = [np.zeros_like(w) for w in (model.unary, model.chain, model.agree)]
    n = max(1, len(g.label))
    for step in range(steps):
        want_node, want_link = infer(g, model, labelled, x)
        have_node, have_link = infer(g, model, given, x)
        slope = [x.T @ (want_node - have_node), want_link[0] - have_link[0],
                 np.array([np.trace(want_link[k] - have_link[k]) for k in (1, 2)])]
        for i, name in enumerate(("unary", "chain", "agree")):
            w = getattr(model, name)
            d = slope[i] / n * 50 - 0.02 * (w - getattr(prior, name))
            moment[i] = 0.9 * moment[i] + 0.1 * d * d
            setattr(model, name, w + 0.3 / (1 + step / 20) * d / (np.sqrt(moment[i]) + 0.01))
    model.agree = np.maximum(model.agree, prior.agree)  # links never speak against one label
    return model


def train(docs: DataFrame, text: str = "text", sample_docs: int = SAMPLE_DOCS) -> Model:
    """A model of ``docs``: the driver gets the tokens of ``sample_docs`` documents, not their texts."""
    scan.ship(docs.sparkSession)
    mine = docs.select(F.col(text).alias("text")).where(F.col("text").rlike("[0-9@]"))
    hashed = F.xxhash64("text")
    some = mine.select(hashed.alias("hash")).distinct().orderBy("hash").limit(sample_docs)
    chosen = mine.withColumn("hash", hashed).join(F.broadcast(some), "hash")  # sample_docs numbers
    parts = ("start", "end", "features", "label", "source", "target", "kind", "follows", "text")

    def run(batches):
        for batch in batches:
            for first, last, buf, offsets in scan.chunks(batch.column("text"), 1):  # one text at a time
                g = graph(buf, offsets, base_spans(buf, offsets))
                if 0 < len(g.label) <= MOST_TOKENS:
                    packed = [pa.array([getattr(g, p).astype("<f4" if p == "features" else "<i4").tobytes()], pa.binary()) for p in parts]
                    yield pa.RecordBatch.from_arrays([batch.column("hash").slice(first, 1), pa.array([g.nodes]), *packed], names=["hash", "nodes", *parts])

    schema = "hash bigint, nodes bigint, " + ", ".join(f"`{p}` binary" for p in parts)
    # Repeated texts have equal graphs: one row of each hash.
    rows = chosen.mapInArrow(run, schema).groupBy("hash").agg(F.max(F.struct("nodes", *(F.col(f"`{p}`") for p in parts))).alias("g")).orderBy("hash").collect()
    graphs = []
    for r in rows:
        own = {p: np.frombuffer(r["g"][p], "<f4" if p == "features" else "<i4").astype(np.float64 if p == "features" else np.int64) for p in parts}
        own["features"], own["follows"] = own["features"].reshape(-1, len(FEATURES)), own["follows"].astype(bool)
        graphs.append(Graph(nodes=r["g"]["nodes"], **own))
    return fit(_joined(graphs)) if graphs else Model()


def _spans_of(column: pa.Array, model: Model) -> list[list[tuple[int, int, int, bool]]]:
    """(kind, start, end, base) of every text, in code points, by kind and start."""
    out: list[list[tuple[int, int, int, bool]]] = []
    for first, last, buf, offsets in scan.chunks(column):
        base = base_spans(buf, offsets)
        g = graph(buf, offsets, base)
        if len(g.label) and (g.label == 0).any():
            marginal, _ = infer(g, model, np.where(g.label > 0, g.label, -1))
            added = added_spans(g, marginal, buf)
        else:
            added = []
        point = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
        rows: list[list[tuple[int, int, int, bool]]] = [[] for _ in range(first, last)]
        for own, is_base in ((base, True), (added, False)):
            for kind, a, b in own:
                row = int(np.searchsorted(offsets, a, "right")) - 1
                zero = point[offsets[row]]
                rows[row].append((kind, int(point[a] - zero), int(point[b] - zero), is_base))
        out += [sorted(r) for r in rows]
    return out


def find_personal(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns and ``spans``: kind, start, end and whether a pattern found it, by kind as listed, then start."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # (features + labels + 1) * labels numbers

    def run(column: pa.Array) -> list[pa.Array]:
        rows = _spans_of(column, sent.value)
        kinds = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))
        return [pa.array([[{"kind": KINDS[k], "start": a, "end": b, "base": is_base} for k, a, b, is_base in r] for r in rows], kinds)]

    return scan.add_columns(docs, keep, [T.StructField("spans", SPANS)], run, text)


def redact(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with each span of its texts replaced by the kind in angle brackets; null stays null."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    plain, names, text = scan.numbered_columns(docs)

    def run(column: pa.Array) -> list[pa.Array]:
        out = []
        for value, spans in zip(column.to_pylist(), _spans_of(column, sent.value)):
            at, parts = 0, []
            for a, b, kind in sorted((a, b, k) for k, a, b, _ in spans):
                if b > at:  # spans of two kinds may overlap: the later start only adds what is left
                    parts.append((value[at : max(a, at)], f"<{KINDS[kind]}>" if a >= at else ""))
                    at = b
            out.append(None if value is None else "".join(x + y for x, y in parts) + value[at:])
        return [pa.array(out, pa.string())]

    made = scan.add_columns(plain, [n for n in names if n != text], [T.StructField("masked", T.StringType())], run, text)
    return made.select(*(F.col("masked" if n == text else n).alias(c) for n, c in zip(names, docs.columns)))
