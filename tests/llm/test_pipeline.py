"""The pipeline's stages, one after the other, against brute force on a small input."""

import os
import re
import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
import cases  # noqa: E402

import corpus_pipeline  # noqa: E402
from transitlapse.llm import secrets  # noqa: E402
from transitlapse.llm.queries import tokenizer_file  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="given tables not present")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def test_stages(spark, tmp_path):
    docs = given = spark.read.parquet(f"{SF}/documents.parquet")
    kept = []
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{number}")
        docs = spark.read.parquet(f"{tmp_path}/{number}")
        kept.append({r["doc_id"]: r for r in docs.collect()} if number < 4 else docs.collect())
        if number < 4:
            assert docs.columns == given.columns and len(kept[-1]) == docs.count()
    first = {r["doc_id"]: r for r in given.collect()}
    good, single, clean, masked, pieces = kept
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert all(good[i] == first[i] for i in good)
    assert np.mean([i in good for i, q in labels.items() if q == 1 and i in first]) > 0.98
    assert len({tuple(words(r["text"])) for r in good.values()}) >= len(single)
    assert {tuple(words(r["text"])) for r in single.values()} <= {tuple(words(r["text"])) for r in good.values()}
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = words(r["text"])
        n = min(10, len(w))
        windows |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1) if n}
    holds = lambda t: any(tuple(w[i : i + 10]) in windows for w in [words(t)] for i in range(len(w) - 9))
    assert all(clean[i] == single[i] for i in clean if not holds(single[i]["text"]))
    assert all(i in clean for i in single if not holds(single[i]["text"]))
    assert any(holds(r["text"]) for r in single.values()) and not any(holds(r["text"]) for r in clean.values())
    assert set(masked) == set(clean)
    assert all((masked[i]["text"] == clean[i]["text"]) != (secrets.MARK in masked[i]["text"]) for i in clean)
    leak = cases.docs(spark, ["a b password=hunter2222 c"])
    assert corpus_pipeline.mask_secrets(spark, leak, SF).first()["text"] == f"a b {secrets.MARK} c"
    assert all(r["n_chars"] == len(r["text"]) for r in masked.values())
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_file())
    by = {}
    for p in pieces:
        by.setdefault(p["doc_id"], []).append(p)
    assert set(by) == set(masked)
    for i, own in by.items():
        ids = np.frombuffer(b"".join(p["ids"] for p in sorted(own, key=lambda p: p["start"])), "<u4").tolist()
        assert ids == [*t.encode(masked[i]["text"], add_special_tokens=False).ids, 0]


def test_odd_rows_pass(spark):
    docs = cases.docs(spark, [*cases.ODD, *("clean text number %d is here and it is all of its own" % i for i in range(5))], schema=cases.CLASH)
    for _, stage in corpus_pipeline.STAGES[1:4]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), cases.CLASH)
    assert docs.columns == cases.CLASH.names and docs.count() > 15
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, cases.docs(spark, []), SF).count() == 0
