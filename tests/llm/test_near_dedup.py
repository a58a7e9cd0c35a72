"""Near-duplicates against plain edit distance, and planted families."""

import random
import sys
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

sys.path.insert(0, str(Path(__file__).parent))
import cases  # noqa: E402

from transitlapse.llm import near_dedup  # noqa: E402


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            old, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, old + (x != y))
    return row[-1]


sequence = st.lists(st.integers(0, 4), max_size=30)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(sequence, sequence), min_size=1, max_size=6), st.sampled_from([1, 4, 40]))
def test_banded_distances(pairs, band):
    got = near_dedup.banded_distances([(np.array(a, int), np.array(b, int)) for a, b in pairs], band)
    for (a, b), d in zip(pairs, got):
        real = distance(a, b)
        assert d == real if real <= band else d > band


def edited(rng, words, share):
    out = list(words)
    for _ in range(int(share * len(words))):
        i = rng.randrange(len(out))
        kind = rng.randrange(3)
        if kind == 0:
            out[i] = "new%d" % rng.randrange(10**6)
        elif kind == 1:
            out.insert(i, "ins%d" % rng.randrange(10**6))
        else:
            del out[i]
    return out


def test_links_are_edit_similarity():
    rng = random.Random(1)
    pairs, want = [], []
    for _ in range(120):
        a = [rng.randrange(2**32) for _ in range(rng.randrange(1, 300))]
        b = [x if rng.random() > 0.18 else rng.randrange(2**32) for x in a] if rng.random() < 0.8 else a[rng.randrange(len(a)) :]
        pairs.append((np.array(a, np.uint32), np.array(b, np.uint32)))
        want.append(1 - distance(a, b) / max(len(a), len(b)) >= 0.8 - 1e-9)
    assert near_dedup.linked(pairs).tolist() == want and 10 < sum(want) < 110


@pytest.fixture(scope="module")
def families():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    shared = [word() for _ in range(60)]
    texts, family = [], []
    for f in range(40):
        base = [word() for _ in range(rng.choice([6, 40, 150, 600]))]
        if f % 4 == 0:
            base = base + shared + [word() for _ in range(200)]
        for c in range(rng.choice([1, 2, 3, 25])):
            texts.append(" ".join(base if c % 3 == 0 else edited(rng, base, 0.04)))
            family.append(f)
    return texts, family


def test_families(spark, families):
    texts, family = families
    rows = near_dedup.classes(cases.docs(spark, texts, schema=cases.CLASH)).collect()
    assert len(rows) == len(texts)
    got = {r["doc_id"]: r["class_id"] for r in rows}
    want = {i: family.index(f) for i, f in enumerate(family)}
    assert got == want
    assert all(r["class_size"] == family.count(family[r["doc_id"]]) for r in rows)
    kept = near_dedup.one_of_each(cases.docs(spark, texts, schema=cases.CLASH))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want.values()))
    assert kept.columns == cases.docs(spark, [], schema=cases.CLASH).columns


def test_odd_rows(spark):
    ids = [*range(len(cases.ODD))]
    ids[1], ids[4] = None, None
    texts = [*cases.ODD, cases.ODD[9], cases.ODD[9]]
    docs = cases.docs(spark, texts, [*ids, 9, 9])
    rows = near_dedup.classes(docs).collect()
    assert len(rows) == len(texts)
    by = {r["doc_id"]: (r["class_id"], r["class_size"]) for r in rows if r["doc_id"] is not None}
    assert by[0] == (0, 2) and by[9] == by[10] == (9, 4) and by[2] == (2, 1) and by[3] == (3, 1)
    assert sorted((r["class_id"] is None, r["class_size"]) for r in rows if r["doc_id"] is None) == [(False, 2), (True, 1)]
    kept = [r["text"] for r in near_dedup.one_of_each(docs).collect()]
    assert len(kept) == len(set(cases.ODD)) - 1 and kept.count(cases.ODD[9]) == 1
    none = cases.docs(spark, [])
    assert near_dedup.classes(none).count() == 0 and near_dedup.one_of_each(none).count() == 0


def brute_classes(texts):
    """The smallest index of each text's class, by the plain edit distance of all pairs."""
    words = [t.split() for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(words):
        for j, b in enumerate(words[:i]):
            longer = max(len(a), len(b))
            if 5 * abs(len(a) - len(b)) <= longer and find(i) != find(j) and 5 * distance(a, b) <= longer:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [find(i) for i in range(len(texts))]


def test_texts_of_a_passage_in_longer_documents(spark):
    rng = random.Random(4)
    word = lambda: "w%d" % rng.randrange(10**6)
    passage = [word() for _ in range(60)]
    # With this seed no bucket that the first two share has one of them as its leader.
    texts = [" ".join(passage + [word() for _ in range(6)]) for _ in range(2)]
    texts += [" ".join([word() for _ in range(40)] + passage + [word() for _ in range(40)]) for _ in range(600)]
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(cases.docs(spark, texts)).collect()}
    assert got == {i: max(0, i - 1) and i for i in range(len(texts))}


def test_recall_at_the_least_similarity(spark):
    rng = random.Random(5)
    word = lambda: "w%d" % rng.randrange(300)
    texts = []
    for n in (4, 5, 8, 10, 11, 12, 13, 15, 16, 20, 40, 60):
        for share in (0.2, 0.2, 0.15, 0.1):
            base = [word() for _ in range(n)]
            other = list(base)
            kind = rng.randrange(3)
            for i in sorted(rng.sample(range(n), int(share * n)), reverse=True):
                if kind == 0:
                    other[i] = word()
                elif kind == 1:
                    del other[i]
                else:
                    other.insert(i, word())
            texts += [" ".join(base), " ".join(other)]
    want = brute_classes(texts)
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(cases.docs(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == want
    assert sum(i != w for i, w in enumerate(want)) > 30


@pytest.mark.parametrize("n", [5, 9, 12, 15, 25, 33, 40, 100, 300, 1500])
def test_pairs_at_the_least_similarity_share_a_sketch(n):
    """Of pairs with a share of words exchanged, in texts of distinct words, nearly all have a sketch in common."""
    rng = np.random.default_rng(n)
    for similarity, least in ((0.8, 0.93), (0.85, 0.97), (0.9, 0.99)):
        met = 0
        for _ in range(150):
            a = rng.integers(0, 2**63, n).astype(np.uint64)
            b = a.copy()
            edits = int((1 - similarity) * n + 1e-9)
            b[rng.choice(n, edits, replace=False)] = rng.integers(0, 2**63, edits).astype(np.uint64)
            (x, y), _ = near_dedup.text_sketches(np.concatenate([a, b]), np.array([0, n, 2 * n]))
            met += bool(np.isin(x, y).any())
        assert met >= least * 150, (similarity, met)


def test_unlike_texts_of_a_passage_are_not_aligned_pair_by_pair(spark, monkeypatch):
    rng = random.Random(12)
    word = lambda: "w%d" % rng.randrange(10**6)
    passage = [word() for _ in range(40)]
    texts = [" ".join(passage + [word() for _ in range(50)]) for _ in range(150)]
    aligned, verified = [], near_dedup._verified
    monkeypatch.setattr(near_dedup, "_verified", lambda pairs, codes: aligned.append(pairs.count()) or verified(pairs, codes))
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(cases.docs(spark, texts)).collect()}
    assert got == {i: i for i in range(150)}
    assert sum(aligned) < 2 * near_dedup.SKETCHES * 150 and sum(aligned[2:]) < 150


def test_marks_bound_the_words_in_common():
    from collections import Counter

    rng = np.random.default_rng(3)
    for n in (0, 1, 5, 80, 900, 5000):
        a = rng.integers(0, max(1, n // 2), n).astype(np.uint64)
        b = np.where(rng.random(n) < 0.2, rng.integers(0, 2**40, n).astype(np.uint64), a)
        marks = near_dedup.word_marks(np.concatenate([a, b]), np.array([0, n, n, 2 * n]))
        assert not marks[1].any()
        bits = lambda x: int(np.bitwise_count(x).sum())
        common = sum((Counter(a.tolist()) & Counter(b.tolist())).values())
        assert bits(marks[0]) <= n
        assert common <= bits(marks[0] & marks[2]) + min(n - bits(marks[0]), n - bits(marks[2]))
