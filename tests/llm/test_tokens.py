"""Token files and packing against the tokenizer itself."""

import sys
import zlib
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

sys.path.insert(0, str(Path(__file__).parent))
import cases  # noqa: E402

from transitlapse.llm import packing, token_files, tokens  # noqa: E402
from transitlapse.llm.queries import tokenizer_file  # noqa: E402


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_file())
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 0]


def test_ids_equal_whole_text_encoding(reference):
    import pyarrow as pa

    got = tokens.encode_column(pa.array(cases.ODD), tokenizer_file())
    assert [x.tolist() for x in got] == [reference(t) for t in cases.ODD]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=" \n\t.,'abAé 　1!", max_size=25), min_size=1, max_size=4))
def test_ids_of_any_text(texts):
    import pyarrow as pa
    from tokenizers import Tokenizer

    t = tokens.encoder(tokenizer_file()).tokenizer
    assert isinstance(t, Tokenizer)
    got = tokens.encode_column(pa.array(texts), tokenizer_file())
    assert [x.tolist()[:-1] for x in got] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_number_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 5, 1000):
        x = (rng.integers(0, 2**32, n, dtype=np.uint64) >> rng.integers(0, 32, n, dtype=np.uint64)).astype(np.uint32)
        assert (token_files.decode_numbers(*token_files.encode_numbers(x), n) == x).all()


def test_files_round_trip(spark, tmp_path, reference, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_IDS", 900)
    ids = [*range(len(cases.ODD), 0, -1)]
    ids[3] = None
    ids[5] = ids[4]
    token_files.write_tokens(cases.docs(spark, cases.ODD, ids, cases.CLASH), f"{tmp_path}/t", tokenizer_file())
    got = sorted(token_files.read_tokens(spark, f"{tmp_path}/t").collect(), key=lambda r: r["start"])
    order = sorted(zip(ids, cases.ODD), key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or ""))
    assert [r["doc_id"] for r in got] == [i for i, _ in order]
    assert [np.frombuffer(r["ids"], "<u4").tolist() for r in got] == [reference(t) for _, t in order]
    at = 0
    for r in got:
        assert r["start"] == at and r["n_tokens"] * 4 == len(r["ids"])
        at += r["n_tokens"]


def test_empty_tables(spark, tmp_path):
    none = cases.docs(spark, [])
    token_files.write_tokens(none, f"{tmp_path}/e", tokenizer_file())
    assert token_files.read_tokens(spark, f"{tmp_path}/e").count() == 0
    assert packing.pack(none, tokenizer_file()).count() == 0


def test_packing_whole(spark, reference):
    texts = [*cases.ODD, *(f"text {i} " * (i * 7) for i in range(60))]
    rows = packing.pack(cases.docs(spark, texts, schema=cases.CLASH), tokenizer_file()).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for i, t in enumerate(texts):
        pieces = sorted(by_doc[i], key=lambda r: r["start"])
        whole = b"".join(r["ids"] for r in pieces)
        assert np.frombuffer(whole, "<u4").tolist() == reference(t)
        assert [r["start"] for r in pieces] == list(np.cumsum([0, *(r["length"] for r in pieces)])[:-1])
        assert {r["doc_tokens"] for r in pieces} == {len(reference(t))}
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in pieces] == list(np.cumsum([0, *(r["length"] for r in pieces)])[:-1])
        size = sum(r["length"] for r in pieces)
        assert size <= 1024 and size & (size - 1) == 0 and {r["context"] for r in pieces} == {size}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 3000), max_size=40))
def test_packed_lengths(lengths):
    sequences = packing.pack_lengths(lengths)
    seen = {}
    for s in sequences:
        size = sum(n for _, _, n in s)
        assert size <= 1024 and size & (size - 1) == 0
        for doc, start, n in s:
            seen.setdefault(doc, []).append((start, n))
    for doc, n in enumerate(lengths):
        at = 0
        for start, size in sorted(seen[doc]):
            assert start == at
            at += size
        assert at == n


def test_step_groups_are_balanced():
    sizes = [1024] * 100 + [512] * 33 + [128] * 70
    load = {}
    for s, g in zip(sizes, packing.step_groups(sizes, 16 * 1024)):
        load[g] = load.get(g, 0) + s
    assert max(load.values()) - min(load.values()) <= 1024


def test_crc_is_the_contracts(spark):
    from pyspark.sql import functions as F

    row = packing.pack(cases.docs(spark, ["a b"]), tokenizer_file()).select("ids", F.crc32("ids").alias("c")).first()
    assert row["c"] == zlib.crc32(bytes(row["ids"]))


def test_encoding_needs_little_memory_beside_the_texts():
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(2)
    some = ["word%d" % i for i in range(500)]
    column = pa.array([" ".join(rng.choice(some, 1500)) for _ in range(250)])
    size = sum(len(x) for x in tokens.encode_column(column, tokenizer_file()))  # the worker knows its pieces now
    tracemalloc.start()
    assert sum(len(x) for x in tokens.encode_column(column, tokenizer_file())) == size
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30 << 20, peak
