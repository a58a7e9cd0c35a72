"""Decontamination against a plain search of every window."""

import random
import re
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
import cases  # noqa: E402

from transitlapse.llm import decontaminate  # noqa: E402

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def brute(texts, items):
    windows = []
    for item, text in items:
        w = WORD.findall(lower(text))
        n = min(10, len(w))
        windows += [(tuple(w[i : i + n]), str(item)) for i in range(len(w) - n + 1) if n]
    out = []
    for t in texts:
        w = WORD.findall(lower(t))
        hit, names = set(), set()
        for win, item in windows:
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i : i + len(win)]) == win:
                    hit.update(range(i, i + len(win)))
                    names.add(item)
        out.append((len(w), len(hit), sorted(names)))
    return out


@pytest.fixture(scope="module")
def fixture():
    rng = random.Random(5)
    vocabulary = ["the", "Of", "é1", "x-y", "ünd", "42", "lorem", "日本"]
    line = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(1, line(14)), (2, line(10)), (3, "short item here"), (4, None), (5, ""), (10, "..."), (6, line(25)), (7, line(25))]
    items.append((8, items[1][1].upper()))
    texts = [*cases.ODD]
    for _ in range(60):
        parts = [line(rng.randrange(0, 12)) for _ in range(3)]
        at = rng.choice(items)[1] or ""
        words = at.split()
        parts.insert(rng.randrange(4), rng.choice([at, at.upper(), " ".join(words[3:14]), " ".join(words[:-1]), ",, ".join(words)]))
        texts.append(" ".join(parts))
    return texts, items


@pytest.mark.parametrize("slice_windows", [250_000, 7])
def test_against_search(spark, fixture, monkeypatch, slice_windows):
    monkeypatch.setattr(decontaminate, "SLICE_WINDOWS", slice_windows)
    texts, items = fixture
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    rows = decontaminate.find_contamination(cases.docs(spark, texts, schema=cases.CLASH), bench, ["doc_id"]).collect()
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], list(r["items"])) for r in rows}
    assert [got[i] for i in range(len(texts))] == brute(texts, items)
    for r in rows:
        raw = lower(texts[r["doc_id"]]).encode()
        inside = [w for s in r["spans"] for w in WORD.findall(raw[s["start"] : s["end"]].decode())]
        assert len(inside) == r["n_hit"]


@pytest.mark.parametrize("slice_windows", [250_000, 1])
def test_removal(spark, monkeypatch, slice_windows):
    monkeypatch.setattr(decontaminate, "SLICE_WINDOWS", slice_windows)
    passage = "one two three four five six seven eight nine ten eleven"
    texts = [None, "", "clean text stays as it is.", "Clean head " * 12 + passage.upper() + ", clean tail.", passage, passage + " x"]
    bench = spark.createDataFrame([(1, passage)], "item_id bigint, text string")
    docs = cases.docs(spark, texts, schema=cases.CLASH)
    got = {r["doc_id"]: r for r in decontaminate.remove_contamination(docs, bench).collect()}
    assert sorted(got) == [0, 1, 2, 3]
    assert got[2]["text"] == texts[2] and got[0]["text"] is None
    assert got[3]["text"] == "Clean head " * 12 + ", clean tail." and got[3]["n_chars"] == len(got[3]["text"])
    assert decontaminate.remove_contamination(docs, bench.limit(0)).count() == len(texts)
    assert decontaminate.remove_contamination(docs.limit(0), bench).count() == 0
    assert decontaminate.remove_contamination(docs, bench).columns == docs.columns
