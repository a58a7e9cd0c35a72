"""Quality classifier and language identification: held-out accuracy and odd rows."""

import os
import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
import cases  # noqa: E402

from transitlapse.llm import language_id, quality_classifier  # noqa: E402
from transitlapse.llm.queries import QUERIES  # noqa: E402

SF = "/root/testdata/sf0.01"
given = pytest.mark.skipif(not os.path.isdir(SF), reason="given tables not present")


@given
def test_quality_of_held_out_documents(spark):
    got = QUERIES["op3_quality_classifier"](spark, SF)
    rows = got.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").collect()
    right = [r["predicted"] == r["quality"] for r in rows]
    assert len(rows) > 50 and np.mean(right) > 0.93
    good = [r["predicted"] for r in rows if r["quality"] == 1]
    assert np.mean(good) > 0.98
    assert got.count() == spark.read.parquet(f"{SF}/documents.parquet").count()


@given
def test_language_of_held_out_documents(spark):
    rows = QUERIES["op6_language_id"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id").where("held_out").collect()
    assert len(rows) > 200 and np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.99


def test_scores_of_odd_rows(spark):
    few = cases.docs(spark, ["good words here"] * 3 + ["### !!! ###"] * 3)
    weights = quality_classifier.train(few.unionByName(few), few.selectExpr("doc_id", "cast(doc_id < 3 as int) quality"))
    rows = quality_classifier.score(cases.docs(spark, cases.ODD, schema=cases.CLASH), weights, ["doc_id", "score"]).collect()
    assert len(rows) == len(cases.ODD) and all(0 <= r["score"] <= 1 for r in rows)
    by = {r["doc_id"]: r["score"] for r in rows}
    assert by[0] == by[1] == by[2] and by[9] == by[10]
    none = few.limit(0)
    untrained = quality_classifier.train(few, none.selectExpr("doc_id", "1 quality"))
    assert {r["score"] for r in quality_classifier.score(cases.docs(spark, ["a", None]), untrained, ["doc_id"]).collect()} == {0.5}
    assert quality_classifier.score(cases.docs(spark, []), weights, ["doc_id"]).count() == 0


def test_vectors_do_not_depend_on_the_chunk():
    import pyarrow as pa

    from transitlapse.llm import scan

    texts = ["a b $$ a b", "", "Über | zwei", "a a a"]
    (_, _, buf, offsets), = scan.chunks(pa.array(texts))
    row, bucket, value = quality_classifier.vectors(buf, offsets)
    for i, t in enumerate(texts):
        own = [x for c in scan.chunks(pa.array([t])) for x in [quality_classifier.vectors(c[2], c[3])]]
        assert (bucket[row == i] == own[0][1]).all() and np.allclose(value[row == i], own[0][2])


def test_mixture_finds_its_languages():
    rng = np.random.default_rng(2)
    p = rng.dirichlet(np.full(50, 0.2), 4).T + 1e-4
    p /= p.sum(axis=0)
    for want in ({1: 1.0}, {0: 0.7, 3: 0.3}):
        count = rng.multinomial(4000, sum(w * p[:, k] for k, w in want.items())).astype(float)
        got = language_id.shares(p, count)
        assert set(got) == set(want) and all(abs(got[k] - want[k]) < 0.05 for k in want)


def test_languages_of_odd_rows(spark):
    docs = cases.docs(spark, ["the cat and the hat", "der hund und die katze", None, "abc"]).selectExpr(
        "doc_id", "text", "case doc_id when 0 then 'en' when 1 then 'de' when 2 then 'en' end lang")
    model = language_id.train(docs)
    assert model.languages == ["de", "en"]
    rows = {r["doc_id"]: r for r in language_id.predict(cases.docs(spark, [*cases.ODD, "12 34", "the hat", "und die"], schema=cases.CLASH),
                                                        model, ["doc_id", "score"]).collect()}
    n = len(cases.ODD)
    assert [rows[i]["lang_pred"] for i in (0, 1, 2, n, n + 1, n + 2)] == ["und"] * 4 + ["en", "de"]
    assert all(0 <= r["score"] <= 1 for r in rows.values())
    empty = language_id.train(docs.limit(0))
    assert {r["lang_pred"] for r in language_id.predict(cases.docs(spark, ["the"]), empty, ["doc_id"]).collect()} == {"und"}
    assert language_id.predict(cases.docs(spark, []), model, ["doc_id"]).count() == 0


def test_every_text_with_a_letter_has_a_language(spark):
    docs = cases.docs(spark, ["a", "zu", "a b"]).selectExpr("doc_id", "text", "case doc_id when 1 then 'de' else 'en' end lang")
    model = language_id.train(docs)
    texts = ["a", "1a!", " Z ", "é", "日", "1", "", "...", None, "a" * 3_000_000]
    rows = {r["doc_id"]: r for r in language_id.predict(cases.docs(spark, texts), model, ["doc_id"]).collect()}
    assert [rows[i]["lang_pred"] != "und" for i in range(len(texts))] == [True] * 5 + [False] * 4 + [True]
    assert rows[0]["lang_pred"] == "en" and rows[5]["score"] == 0.0


def plain_grams(text):
    """Bytes of letters in lower case, other bytes as breaks, a break on both sides; n-grams that begin with two breaks are none."""
    shown = [32, *(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in text.encode()), 32]
    return [bytes(shown[i : i + k]) for k in (2, 3, 4) for i in range(len(shown) - k + 1) if shown[i : i + 2] != [32, 32]]


def test_grams_and_language_sets_against_plain_ones():
    import pyarrow as pa

    from transitlapse.llm import scan

    rng = np.random.default_rng(5)
    texts = ["", "a", "  ", "Ab1c", "über die", "a", *("".join(rng.choice(list("aB 1é"), 30)) for _ in range(40))]
    (_, _, buf, offsets), = scan.chunks(pa.array(texts))
    row, _, n = language_id.grams(buf, offsets)
    assert [int(n[row == i].sum()) for i in range(len(texts))] == [len(plain_grams(t)) for t in texts]
    for t in set(texts):
        kinds = len(set(plain_grams(t)))  # n-grams may share a bucket
        assert 0.9 * kinds <= len(n[row == texts.index(t)]) <= kinds
    # Sets and shares against expectation maximisation of every pair, followed for very long.
    for _ in range(10):
        p = rng.dirichlet(np.full(30, 0.5), 4).T + 1e-3
        p /= p.sum(axis=0)
        w = rng.dirichlet(np.full(4, 0.3))
        count = rng.multinomial(300, p @ w).astype(float)

        def likely(chosen):
            s = np.full(len(chosen), 1 / len(chosen))
            for _ in range(5_000):
                s = s * (p[:, chosen].T @ (count / (p[:, chosen] @ s))) / count.sum()
            return count @ np.log(p[:, chosen] @ s), s

        chosen = [max(range(4), key=lambda k: likely([k])[0])]
        while len(chosen) < 4:
            k = max((k for k in range(4) if k not in chosen), key=lambda k: likely([*chosen, k])[0])
            if likely([*chosen, k])[0] - likely(chosen)[0] <= language_id.PENALTY * np.log(301):
                break
            chosen.append(k)
        got = language_id.shares(p, count)
        assert list(got) == chosen
        assert all(abs(got[k] - s) < 0.05 for k, s in zip(chosen, likely(chosen)[1]))
