"""Repeated strings against a plain table of all windows."""

import hashlib
import random
import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
import cases  # noqa: E402

from transitlapse.llm import scan, suffix_dedup  # noqa: E402

N = suffix_dedup.LENGTH


def brute(texts):
    seen = {}
    raws = [(t or "").encode() for t in texts]
    for d, raw in enumerate(raws):
        for i in range(len(raw) - N + 1):
            seen.setdefault(hashlib.blake2b(raw[i : i + N], digest_size=20).digest(), []).append((d, i))
    gone = [bytearray(len(raw)) for raw in raws]
    for at in seen.values():
        if len(at) > 1:
            for d, i in at:
                gone[d][i : i + N] = b"\1" * N
    out = []
    for raw, g in zip(raws, gone):
        spans, i = [], 0
        while i < len(g):
            if g[i]:
                j = i
                while j < len(g) and g[j]:
                    j += 1
                spans.append((i, j))
                i = j
            else:
                i += 1
        out.append((len(raw), spans, bytes(b for b, x in zip(raw, g) if not x)))
    return out


def sample(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(rng.randrange(60, 260)) for _ in range(6)]
    texts = [*cases.ODD, "ab" * 450, "x" * 399, "x" * 401, ("period of fourteen " * 60)]
    for _ in range(40):
        parts = [prose(rng.randrange(0, 60)) for _ in range(3)]
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages)
            a = rng.randrange(0, max(1, len(p) - 380))
            parts.insert(rng.randrange(4), p[a : a + rng.randrange(380, 900)])
        texts.append("".join(parts))
    base = prose(300)
    for _ in range(30):  # near copies with single letters changed
        t = list(base)
        for _ in range(rng.randrange(4)):
            t[rng.randrange(len(t))] = "#"
        texts.append("".join(t))
    texts += [base, base, texts[-1]]
    return texts


def test_cover_is_a_difference_cover():
    pairs = {(a - b) % suffix_dedup.PERIOD for a in suffix_dedup.COVER for b in suffix_dedup.COVER}
    assert pairs == set(range(suffix_dedup.PERIOD))


@pytest.mark.parametrize("seed,most_sorted,most_sent", [(1, 5_000, 10**6), (2, 1, 10**6), (3, 5_000, 0)])
def test_against_all_windows(spark, monkeypatch, seed, most_sorted, most_sent):
    monkeypatch.setattr(suffix_dedup, "MOST_SORTED", most_sorted)
    monkeypatch.setattr(suffix_dedup, "MOST_SENT", most_sent)
    texts = sample(seed)
    ids = list(range(len(texts)))
    ids[2], ids[20], ids[21] = None, 7, 7
    rows = suffix_dedup.remove_repeats(cases.docs(spark, texts, ids, cases.CLASH)).collect()
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_bytes"], tuple((s["start"], s["end"]) for s in r["spans"]), bytes(r["kept"]))
                 for r in rows)
    want = sorted((-1 if i is None else i, n, tuple(spans), kept) for i, (n, spans, kept) in zip(ids, brute(texts)))
    assert got == want
    assert sum(bool(w[2]) for w in want) > 30


def test_nothing_to_do(spark):
    assert suffix_dedup.remove_repeats(cases.docs(spark, [])).count() == 0
    rows = suffix_dedup.remove_repeats(cases.docs(spark, [None, "", "short"])).collect()
    assert [(r["n_bytes"], len(r["spans"])) for r in sorted(rows, key=lambda r: r["doc_id"])] == [(0, 0), (0, 0), (5, 0)]


def spans_of(spark, texts):
    rows = suffix_dedup.remove_repeats(cases.docs(spark, texts)).collect()
    return {r["doc_id"]: [(s["start"], s["end"]) for s in r["spans"]] for r in rows}


def test_a_text_of_several_pieces(spark):
    rng = random.Random(5)
    passage = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    p, q, r = passage(700), passage(450), passage(400)
    piece = suffix_dedup.PIECE
    long = passage(piece - 300) + p + passage(2000) + q + passage(piece - 3000) + r + passage(1000)  # p and r lie on edges
    texts = [long, q + passage(50), passage(30) + p[100:650], passage(999), r, "x" + r + "y"]
    assert len(long) > 2 * piece - 2000
    assert spans_of(spark, texts) == {i: w[1] for i, w in enumerate(brute(texts))}


def test_a_bucket_larger_than_a_task_sorts(spark):
    rng = random.Random(6)
    draw = lambda n: "".join(rng.choice("abcd") for _ in range(n))
    gram = lambda t: scan.Prefix(scan.BYTE_VALUES[np.frombuffer(t.encode(), np.uint8)]).window(np.array([0]), np.array([len(t)]))[0]
    middle = min((draw(suffix_dedup.FINE) for _ in range(2000)), key=gram)  # the minimiser of nearly all windows around it
    lefts, rights = ([draw(80) for _ in range(90)] for _ in "lr")
    lefts += [draw(40) + lefts[0][40:] for _ in range(40)]
    rights += [rights[0][:25] + draw(55) for _ in range(40)]
    texts = list({rng.choice(lefts) + middle + rng.choice(rights) for _ in range(9000)}) + [draw(80) + middle + draw(80)]
    assert len(texts) > suffix_dedup.MOST_SORTED
    assert spans_of(spark, texts) == {i: w[1] for i, w in enumerate(brute(texts))}
