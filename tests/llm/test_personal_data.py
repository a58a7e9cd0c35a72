"""Personal data: base spans against the patterns themselves, message passing against enumeration, planted mentions."""

import itertools
import random
import re
import sys
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, str(Path(__file__).parent))
import cases  # noqa: E402

from transitlapse.llm import personal_data, scan  # noqa: E402
from transitlapse.llm.queries import QUERIES  # noqa: E402

PATTERNS = [re.compile(p) for p in (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")]


def sums_up(digits):
    twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(d - 9 * (d > 9) for d in twice) % 10 == 0


def plain(text):
    out = []
    for kind, pattern in zip(personal_data.KINDS, PATTERNS):
        for m in pattern.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")),
                    "card": 13 <= len(digits) <= 19 and sums_up(digits), "phone": 9 <= len(digits) <= 15}[kind]:
                out.append((kind, m.start(), m.end()))
    return out


def spans(texts, model, base):
    return [[(personal_data.KINDS[k], a, b) for k, a, b, own in row if own is base] for row in personal_data._spans_of(pa.array(texts), model)]


def card(rng):
    digits = "4" + "".join(rng.choice("0123456789") for _ in range(14))
    return next(digits + c for c in "0123456789" if sums_up(digits + c))


def corpus(n, seed):
    rng = random.Random(seed)
    number = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    kinds = [lambda: f"+1 ({number(3)}) 555-{number(4)}", lambda: card(rng), lambda: f"{rng.choice(['ann', 'joe', 'mia'])}.{number(2)}@mail{number(1)}.example.com",
             lambda: ".".join(str(rng.randrange(256)) for _ in range(4)), lambda: number(rng.choice([1, 2, 4, 5])), lambda: number(16), lambda: number(16), lambda: number(3) + "." + number(2),
             lambda: f"v{number(1)}.{number(1)}", lambda: f"{number(4)}-{number(2)}-{number(2)}"]
    out = []
    for _ in range(n):
        words = [rng.choice(["the", "note", "and", "Überall", "ciónque", "end."]) for _ in range(rng.randrange(5, 60))]
        for made in rng.sample(kinds, rng.randrange(3)):
            x = made()
            for _ in range(rng.choice([1, 1, 2, 3])):
                words.insert(rng.randrange(len(words)), x)
        out.append(" ".join(words))
    return out


@pytest.fixture(scope="module")
def model(spark):
    return personal_data.train(cases.docs(spark, corpus(600, 1)))


def test_base_spans_of_any_text():
    rng = random.Random(2)
    bits = ["1", "22", "255", "256", "007", "+", "-", " ", ".", "@", "a", "b.c", "é", "(", ")", "\n", "4111111111111111", "x@y.z", "\x00"]
    texts = [*cases.ODD, *corpus(50, 3), *("".join(rng.choice(bits) for _ in range(rng.randrange(40))) for _ in range(4000)),
             "a@b.c@d.e", "1.2.3.4.5.6.7.8.9", "4111 1111-1111 1111", "+1" + "-" * 50 + "2345678901", "0.0.0.256", "%@a.b", "a@b", "@", "+", "9" * 5000]
    assert spans(texts, personal_data.Model(), True) == [plain(t) for t in texts]
    assert not any(spans(texts[: len(cases.ODD)], personal_data.Model(), False))


def test_messages_equal_enumeration():
    """On a graph without loops the marginals are exact; rounds are as many as its depth needs."""
    rng = np.random.default_rng(4)
    n, labels = 4, personal_data.LABELS  # three tokens in a chain, the outer two with a shared node: a tree
    g = personal_data.Graph(np.arange(n), np.arange(n) + 1, rng.normal(size=(n, len(personal_data.FEATURES))), np.zeros(n, int), n + 1,
                            np.array([0, 1, 2, 3]), np.array([1, 2, 4, 4]), np.array([0, 0, 1, 1]), np.zeros(n, bool), np.zeros(n, int))
    m = personal_data.Model(rng.normal(size=(len(personal_data.FEATURES), labels)) / 3, rng.normal(size=(labels, labels)), np.array([1.5, 1.0]))
    given = np.array([-1, -1, -1, 2])
    got, joint = personal_data.infer(g, m, given, rounds=60)
    want, pair, psi, own = np.zeros((n, labels)), np.zeros((labels, labels)), np.log(m.potentials()), g.features @ m.unary
    for y in itertools.product(range(labels), repeat=n + 1):
        if y[3] == y[4] == 2:  # the shared node of a given token is given
            p = np.exp(sum(own[i, y[i]] for i in range(3)) + sum(psi[k, y[a], y[b]] for a, b, k in zip(g.source, g.target, g.kind)))
            want[range(n), y[:n]] += p
            pair[y[0], y[1]] += p
            pair[y[1], y[2]] += p
    assert np.allclose(got, want / want.sum(axis=1, keepdims=True), atol=1e-6)
    assert np.allclose(joint[0], 2 * pair / pair.sum(), atol=1e-6)


def test_messages_equal_plain_loops():
    """The array form against a plain walk over links, on a graph with loops."""
    text = pa.array(["555-7209 and 555-7209, (487) 555-7209; ann.55@mail.example.com ann.55 4111111111111111 4111111111111112"])
    _, _, buf, offsets = next(scan.chunks(text))
    g = personal_data.graph(buf, offsets, personal_data.base_spans(buf, offsets))
    rng = np.random.default_rng(6)
    m = personal_data.Model(rng.normal(size=personal_data.Model().unary.shape) / 4, rng.normal(size=personal_data.Model().chain.shape), np.array([1.0, 0.5]))
    given = np.where(g.label > 0, g.label, -1)
    n, psi, labels = len(g.label), m.potentials(), personal_data.LABELS
    own = [[(0.0 if k == given[i] else -40.0) if given[i] >= 0 else float(g.features[i] @ m.unary[:, k]) for k in range(labels)] for i in range(n)]
    fixed = set(np.flatnonzero(given >= 0).tolist())
    for i in range(n, g.nodes):
        known = [int(given[a]) for a, b in zip(g.source, g.target) if b == i and given[a] >= 0]
        own.append([float(np.log(max(known.count(k) / len(known), 1e-12))) if known else 0.0 for k in range(labels)])
        fixed |= {i} if known else set()
    links = [(int(a), int(b), psi[k]) for a, b, k in zip(g.source, g.target, g.kind)]
    links = [(a, b, t, i + len(links)) for i, (a, b, t) in enumerate(links)] + [(b, a, t.T, i) for i, (a, b, t) in enumerate(links)]
    message = [[0.0] * labels for _ in links]
    belief = lambda i: [own[i][k] + sum(message[e][k] for e, x in enumerate(links) if x[1] == i) for k in range(labels)]
    for _ in range(personal_data.ROUNDS):
        at, new = [belief(i) for i in range(g.nodes)], []
        for a, b, t, back in links:
            told = own[a] if a in fixed else [at[a][j] - message[back][j] for j in range(labels)]
            out = [np.log(sum(np.exp(told[j]) * t[j][k] for j in range(labels))) for k in range(labels)]
            new.append([x - max(out) for x in out])
        message = [[(x + y) / 2 for x, y in zip(p, q)] for p, q in zip(message, new)]
    want = np.exp([belief(i) for i in range(n)])
    got, _ = personal_data.infer(g, m, given)
    assert len(links) >= 16 and np.allclose(got, want / want.sum(axis=1, keepdims=True), atol=1e-6)


def test_distant_mentions_agree(model):
    rng = random.Random(7)
    filler = " ".join(["and the note"] * 200)
    good = card(rng)
    typo = good[:9] + str((int(good[9]) + 1) % 10) + good[10:]
    assert not sums_up(typo)
    found = lambda *texts: spans(list(texts), model, False)
    text = f"pay {good} {filler} card {typo} ok"
    assert found(text) == [[("card", text.index(typo), text.index(typo) + 16)]]
    assert found(f"order {typo} ok") == [[]]
    text = f"call +1 (487) 555-7209 {filler} or (487) 555-7209 soon"
    at = text.rindex("(487)")
    assert found(text) == [[("phone", at, at + 14)]]
    text = f"mail joe.smith77@mail3.example.com {filler} as joe.smith77 wrote"
    at = text.rindex("joe.smith77")
    assert found(text) in ([[("email", at, at + 11)]], [[]])  # a name alone is weaker evidence
    other = card(rng)
    text = f"twice {good} {other} there"  # one run of 32 digits to the pattern
    assert [s[0] for s in found(text)[0]] == ["card", "card"]


def test_mentions_without_their_marks(spark, model):
    """Held out: of numbers that stand twice, one loses its plus sign or a digit; nothing is added to clean texts."""
    rng, texts, want = random.Random(8), [], []
    for _ in range(120):
        good = card(rng)
        phone = f"({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}"
        first, second = rng.choice([(good, good[:3] + str((int(good[3]) + 3) % 10) + good[4:]), ("+1 " + phone, phone)])
        text = f"with {first} there and the note on {second} here"
        texts.append(text)
        want.append((text.rindex(second), text.rindex(second) + len(second)))
    got = spans(texts, model, False)
    assert sum((w in [s[1:] for s in g]) for g, w in zip(got, want)) >= 0.9 * len(texts)
    clean = [f"in {rng.randrange(1900, 2030)} there were {rng.randrange(99)} of {rng.randrange(10**5)} and {rng.random():.3f} on 20{rng.randrange(10, 30)}-0{rng.randrange(1, 9)}-1{rng.randrange(9)} v1.{rng.randrange(9)}" for _ in range(200)]
    assert not any(spans(clean, model, False)) and not any(spans(clean, model, True))


def test_many_mentions_and_neighbours(model):
    """A third of all tokens in one group costs a link each; a text's result does not depend on the texts around it."""
    text = "+1 (487) 555-7209 " + "x 555-7209 " * 3000
    _, _, buf, offsets = next(scan.chunks(pa.array([text])))
    g = personal_data.graph(buf, offsets, [])
    assert len(g.source) < 2 * len(g.label)
    alone = personal_data._spans_of(pa.array([text]), model)
    assert len(alone[0]) > 2900 and personal_data._spans_of(pa.array(["a 1", text, *corpus(20, 9)]), model)[1] == alone[0]


def test_odd_rows_and_clashing_columns(spark, model):
    texts = [*cases.ODD, *corpus(60, 10), "é +1 (487) 555-7209", "é +1 (487) 555-7209"]
    docs = cases.docs(spark, texts, schema=cases.CLASH)
    got = {r["doc_id"]: r for r in personal_data.find_personal(docs, model, ["doc_id", "spans", "n_words"]).collect()}
    assert got[0].asDict().keys() == {"doc_id", "n_words", "spans"}
    for i, t in enumerate(texts):
        assert [(s["kind"], s["start"], s["end"]) for s in got[i]["spans"] if s["base"]] == plain(t)
    assert personal_data.find_personal(cases.docs(spark, []), personal_data.train(cases.docs(spark, [])), ["doc_id"]).collect() == []
    masked = {r["doc_id"]: r["text"] for r in personal_data.redact(docs, model).collect()}
    assert masked[len(texts) - 1] == "é <phone>" and masked[0] is None and masked[1] == ""
    assert personal_data.redact(docs, model).columns == docs.columns


def test_query(spark, tmp_path):
    import hashlib

    texts = [*cases.ODD, *corpus(300, 11), f"{card(random.Random(1))} {card(random.Random(2))}"]
    cases.docs(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    for r in QUERIES["op12_personal_data"](spark, str(tmp_path)).collect():
        base = plain(texts[r["doc_id"]])
        written = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert [r[f"n_{k}"] for k in personal_data.KINDS] == [sum(s[0] == k for s in base) for k in personal_data.KINDS]
        assert r["base_sha256"] == hashlib.sha256(written.encode()).hexdigest()
        told = [s.split(":") for s in r["spans"].split(",") if s]
        assert told == sorted(told, key=lambda s: (personal_data.KINDS.index(s[0]), int(s[1]))) and set(written.split(",")) - {""} <= set(r["spans"].split(","))
