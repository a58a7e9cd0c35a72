"""Token alignment against a plain version that walks over every group."""

import hashlib
import random
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

sys.path.insert(0, str(Path(__file__).parent))
import cases  # noqa: E402

from transitlapse.llm import scan, token_alignment  # noqa: E402
from transitlapse.llm.queries import QUERIES, tokenizer_file  # noqa: E402

A, B = tokenizer_file(), tokenizer_file("piece_bpe_32k.model")
TEXTS = [*cases.ODD, "<s> <unk> </s> <0x0A> <|endoftext|>", "a▁b", "▁", " ▁ ", "\x00\x01", "   three  spaces\n\n \n x", "é ﬁ ½ Å",
         "internationalization, tokenization & co-operation!" * 30, "\r\n\t\t  　x", "12345678901234567890 3.14159", "🙂🙃" * 50, " ", "\n a",
         "𝔘𝔫𝔦𝔠𝔬𝔡𝔢 ॐ नमस्ते สวัสดี", "x" * 200 + " " * 200 + "é" * 200]


@pytest.fixture(scope="module")
def coders():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    byte = token_alignment._byte_characters()
    spell = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    return (lambda t: [(i, bytes(byte[c] for c in a.id_to_token(i))) for i in a.encode(t, add_special_tokens=False).ids],
            lambda t: [(i, spell(i)) for i in b.encode(t)])


def plain_groups(text, coders):
    """[(a ids, b ids)] of a text."""
    if not text:
        return []
    whole = (" " + text).encode()
    sides = coders[0](" " + text), coders[1](text)
    if any(b"".join(x for _, x in side) != whole for side in sides):
        return []
    ends = [set(np.cumsum([len(x) for _, x in side]).tolist()) for side in sides]
    cuts = sorted(ends[0] & ends[1])
    out = [([], []) for _ in cuts]
    for n, side in enumerate(sides):
        at, group = 0, 0
        for i, x in side:
            at += len(x)
            out[group][n].append(i)
            group += at == cuts[group]
    return out


def plain(texts, coders):
    grouped = [plain_groups(t, coders) for t in texts]
    linked = [Counter((a, b) for x, y in g for a in x for b in y) for g in grouped]
    count = Counter(p for own in linked for p in own)
    best = {}
    for (a, _), n in count.items():
        best[a] = max(best.get(a, 0), n)
    out = []
    for g, own in zip(grouped, linked):
        written = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
        out.append((sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), sum(own.values()),
                    sum(n for p, n in own.items() if count[p] == best[p[0]]), sum(n * count[p] for p, n in own.items()),
                    hashlib.sha256(written.encode()).hexdigest() if g else ""))
    return out, count, sum(linked, Counter())


def prose(n, seed):
    rng = random.Random(seed)
    words = ["the", "Überraschung", "tokenizer", "naïve", "of", "antidisestablishment", "ciónque", "x1y2", "3.50", "end.\n", "—", "don't", "日本"]
    return [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 60))) for _ in range(n)]


def test_equals_plain_version(spark, coders, monkeypatch):
    texts = [*TEXTS, *prose(150, 1), TEXTS[-1]]
    monkeypatch.setattr(token_alignment, "CONTAINER_DOCS", 20)
    monkeypatch.setattr(scan, "CHUNK_BYTES", 3000)
    docs = cases.docs(spark, texts, schema=cases.CLASH).repartition(3)
    found = token_alignment.align(docs, A, B, ["doc_id", "source", "n_words"])
    want, count, links = plain(texts, coders)
    assert sorted(map(tuple, found.documents.collect())) == sorted((i, "s", "x", *w) for i, w in enumerate(want))
    assert sorted(tuple(r)[:4] for r in found.pairs.collect()) == sorted((*p, n, links[p]) for p, n in count.items())


def test_repeated_rows_and_slices(spark, coders, monkeypatch):
    """Rows with one id are documents of their own; groups are expanded in slices, with the same numbers of links."""
    texts = ["again and again", "again and again", None, "again", "é" * 300]
    want, _, _ = plain(texts, coders)
    docs = cases.docs(spark, texts, [7, 7, 7, None, 8]).coalesce(1)
    got = token_alignment.align(docs, A, B, ["doc_id"]).documents.collect()
    assert Counter(map(tuple, got)) == Counter((i, *w) for i, w in zip([7, 7, 7, None, 8], want))
    size = len(token_alignment._coders(A, B)[3].size)
    buf = np.frombuffer(b"".join(b" " + t.encode() for t in texts if t), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) + 1 if t else 0 for t in texts])])
    g = token_alignment.groups(buf, offsets, A, B)
    sums = lambda: sum((Counter(dict(zip(zip(p.tolist(), d.tolist()), n.tolist()))) for p, d, n in token_alignment.links(g, size)), Counter())
    whole = sums()
    monkeypatch.setattr(token_alignment, "SLICE_LINKS", 3)
    assert sums() == whole and sum(whole.values()) == sum(w[3] for w in want)


def test_empty_table(spark):
    found = token_alignment.align(cases.docs(spark, []), A, B, ["doc_id"])
    assert found.documents.columns == ["doc_id", *token_alignment.RESULT.names] and not found.documents.collect() and not found.pairs.collect()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=" \n\t.,'abAé 　1!", max_size=25), min_size=1, max_size=4))
def test_pieces_of_any_text(texts):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=B)
    spaced = pa.array([" " + t if t else "" for t in texts])
    coder = token_alignment.PieceEncoder(B)
    for first, last, buf, offsets in scan.chunks(spaced):
        ids, place = coder.encode(buf, offsets)
        got = [ids[x:y].tolist() for x, y in zip(place[:-1], place[1:])]
        assert got == [model.encode(t) for t in texts[first:last]]


def test_planes_round_trip():
    rng = np.random.default_rng(3)
    n = 4000
    key = np.unique(rng.integers(0, 200, n) << 32 | rng.integers(0, 3000, n))
    pair, doc, count = key >> 32, key & 0xFFFFFFFF, rng.integers(1, 70_000, len(key))
    box = token_alignment.Container()
    for half in (key < key[n // 4], key >= key[n // 4]):  # parts of one container
        box.parts.append(box._planes(pair[half], doc[half], count[half]))
    pairs, planes = box.postings()
    row, plane, place, bits = token_alignment._entries(planes.slice(5))
    got = Counter()
    for r, p, at, b in zip(row.tolist(), plane.tolist(), place.tolist(), bits.tolist()):
        for i in range(8):
            if b >> i & 1:
                got[pairs[r + 5].as_py(), at * 8 + i] += 1 << p
    assert got == Counter({(p, d): c for p, d, c in zip(pair.tolist(), doc.tolist(), count.tolist()) if p >= pairs[5].as_py()})


def test_query_on_tables(spark, coders, tmp_path):
    texts = [*TEXTS, *prose(40, 5)]
    cases.docs(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op13_token_alignment"](spark, str(tmp_path))
    assert got.columns == ["doc_id", *token_alignment.RESULT.names]
    assert sorted(map(tuple, got.collect())) == [(i, *w) for i, w in enumerate(plain(texts, coders)[0])]
