"""Quality rules and secret scans against plain Python."""

import math
import random
import re
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
import cases  # noqa: E402

from transitlapse.llm import quality_rules, secrets  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen, inside = {}, set()
    for i in range(len(w) - 7):
        seen.setdefault(tuple(w[i : i + 8]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            inside.update(j for i in at for j in range(i, i + 8))
    failed = len(w) < 20 or 100 * len(inside) > 30 * len(w)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside), failed)


def texts():
    rng = random.Random(3)
    out = [*cases.ODD, "a b\x0bc\x0cd", "x\x85y z w", "|a | b |", "one line\none line\n\none line \n"]
    for _ in range(80):
        v = rng.choice([3, 40, 4000])
        w = ["w%d" % rng.randrange(v) for _ in range(rng.randrange(1, 300))]
        k = rng.randrange(len(w))
        out.append(rng.choice([" ", "\n", "  "]).join(w + w[k : k + rng.randrange(30)]))
    return out


def test_counts(spark):
    all_texts = texts()
    rows = quality_rules.judge(cases.docs(spark, all_texts, schema=cases.CLASH), ["doc_id", "n_words"]).collect()
    got = {r["doc_id"]: (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"])
           for r in rows}
    for i, t in enumerate(all_texts):
        assert got[i] == counts(t), t
    assert all(not r["kept"] for r in rows if r["base_failed"])
    assert quality_rules.judge(cases.docs(spark, []), ["doc_id"]).count() == 0


def test_rules_bind(spark):
    good = "the quick fox and the dog of that house went to the river with a friend and it was good for all of them. "
    bad = [" | ".join("word%d" % i for i in range(60)), " ".join("xq%dz" % i for i in range(80)),
           "\n".join(["the same line of words is here"] * 9 + ["and one that is not the same as the rest of it"])]
    rows = quality_rules.judge(cases.docs(spark, [good, *bad]), ["doc_id"]).orderBy("doc_id").collect()
    assert [r["kept"] for r in rows] == [True, False, False, False]


def base_spans(text):
    out = []
    for m in re.finditer(r"""((?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def entropy_spans(text, base):
    out = []
    for m in re.finditer(secrets.CANDIDATE, text):
        run = m[0]
        if any(re.search(p, run) for p in secrets.ALLOWED):
            continue
        least = next(b for shape, b in secrets.LEAST_BITS.items() if re.search(shape, run))
        words = list(re.finditer("example|sample|dummy|placeholder|xxxx|changeme|your_|0123456789|abcdefgh", run, re.I))
        hot = []
        for i in range(len(run) - secrets.WINDOW + 1):
            if any(i < w.end() and w.start() < i + secrets.WINDOW for w in words):
                continue
            part = run[i : i + secrets.WINDOW]
            bits = -sum(part.count(c) / len(part) * math.log2(part.count(c) / len(part)) for c in set(part))
            if bits >= least - 1e-9:
                hot.append(i)
        if hot:
            a, b = m.start() + hot[0], m.start() + hot[-1] + secrets.WINDOW
            if not any(x <= a and b <= y for x, _, y in base):
                out.append((a, 3, b))
    return out


def secret_texts():
    rng = random.Random(8)
    pieces = ["password=hunter22", "PassWd : 'abc.def-ghi'", "token=short", "secret=token:abcdefgh", "api_key=\"Zz9+/aa==\"", "apikey  =  k",
              "AKIA" + "Q" * 16, "AKIA" + "Q" * 15, "AKIAAKIA" + "7" * 14, "deadbeef" * 3, "deadbeef" * 4 + "g", "0" * 23,
              "é日本", "😀", " plain words ", "\n", "tokentoken=abcdef", "123e4567-e89b-12d3-a456-426614174000",
              "Xk9/Qm2+Lp7Zt4Wv8Rb1Nc6YhUj", "aaaaaaaaaaaaaaaaaaaaaaaaaaaa1B", "example" + "Xk9/Qm2+Lp7Zt4Wv8Rb1Nc6YhUj"]
    out = [*cases.ODD, *pieces]
    for _ in range(120):
        out.append(rng.choice(["", " ", ", "]).join(rng.choice(pieces) for _ in range(rng.randrange(1, 14))))
    out += ["Zx9Qw3Rt7Yp2Lm8Kd5Vb0123abcdef0123456789abcdefHn4Gj6Fs1Ua9Te3", "Zx9Qw3Rt7Yp2Lm8Kd5VbsampleHn4Gj6Fs1Ua9Te3Xk8Mv"]
    out.append(" ".join("token=value%05d" % i for i in range(900)))
    out.append("".join(rng.choice("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789") for _ in range(700)))
    return out


def test_spans(spark):
    all_texts = secret_texts()
    rows = secrets.find_secrets(cases.docs(spark, all_texts, schema=cases.CLASH), ["doc_id", "spans"]).collect()
    got = {r["doc_id"]: [(s["start"], s["kind"], s["end"]) for s in r["spans"]] for r in rows}
    n_hot = 0
    for i, t in enumerate(all_texts):
        base = base_spans(t or "")
        hot = entropy_spans(t or "", base)
        n_hot += len(hot)
        assert got[i] == sorted(base + hot), t
    assert n_hot > 10
    assert secrets.find_secrets(cases.docs(spark, []), ["doc_id"]).count() == 0


def test_redaction(spark):
    all_texts = secret_texts()
    docs = cases.docs(spark, all_texts, schema=cases.CLASH)
    out = {r["doc_id"]: r for r in secrets.redact(docs).collect()}
    assert secrets.redact(docs).columns == docs.columns
    for i, t in enumerate(all_texts):
        if t is None:
            assert out[i]["text"] is None
            continue
        base = base_spans(t)
        want, at = "", 0
        for a, _, b in sorted(base + entropy_spans(t, base)):
            if a >= at:
                want += t[at:a] + secrets.MARK
            at = max(at, b)
        assert out[i]["text"] == want + t[at:] and out[i]["n_chars"] == len(out[i]["text"])


def test_keys_around_patterns_and_allowed_words_go_whole(spark):
    keys = ["Zx9Qw3Rt7Yp2Lm8Kd5Vb0123abcdef0123456789abcdefHn4Gj6Fs1Ua9Te3", "Zx9Qw3Rt7Yp2Lm8Kd5VbsampleHn4Gj6Fs1Ua9Te3Xk8Mv",
            "Zx9Qw3Rt7Yp2Lm8Kd5VbdeadbeefdeadbeefdeadbeefHn4Gj6Fs1Ua9Te3"]
    quiet = ["Zx9Qw3Rt7Yp2sampleHn4Gj6Fs1U", "123e4567-e89b-12d3-a456-426614174000"]
    texts = [f"a {k} b" for k in keys + quiet]
    out = {r["doc_id"]: r["text"] for r in secrets.redact(cases.docs(spark, texts)).collect()}
    assert [out[i] for i in range(len(keys))] == [f"a {secrets.MARK} b"] * len(keys)
    assert [out[len(keys) + i] for i in range(len(quiet))] == texts[len(keys):]
