"""Secret scans: credential patterns, and strings whose sliding-window entropy is high for their character class.

Only built-in column expressions. Matches are placed by the lengths of the pieces between them. A candidate string
is a long run of key characters; its entropy over a sliding window is kept up from the counts of the window's
characters, one in and one out at each step, and the hot windows of a candidate make one span. Candidates of an
allowed shape (UUIDs, plain words, numbers) are left out; placeholder words are held against the windows: one that
touches such a word is never hot, the rest of a key around it still is. A span is dropped only if a pattern's span
contains it; spans may overlap else.

Spans are in code points, end exclusive. A null text has none; repeated rows get equal spans, an empty table an
empty result; a kept column named like a result is replaced by it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The patterns of the three kinds. Runs of hexadecimal digits and access keys are matched whole, so a
# least length in the pattern finds the same matches as dropping the short ones after.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{24,}"
ALLOWED_WORDS = "example sample dummy placeholder xxxx changeme your_ 0123456789 abcdefgh".split()
ALLOWED = (
    r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$",
    r"^[A-Za-z_/-]+$",
    r"^[0-9+/_=-]+$",
)
KINDS = ("assign", "access", "hex", "entropy")
WINDOW = 20
#: Least bits per character of a window, by the class of the candidate's characters.
LEAST_BITS = {r"^[0-9a-fA-F_=-]+$": 3.0, r"^[0-9a-z_=-]+$|^[0-9A-Z_=-]+$": 3.4, r"": 3.7}

MARK = "[SECRET]"
_SLOTS = ord("z") - ord("+") + 1
_BLOCK = 256
#: Stands for a character of an allowed word; no candidate holds it.
COVER = "."


def _place(d: DataFrame, own: list[str], patterns: dict[str, tuple[str, str]]) -> DataFrame:
    """For each name an array of (start, end, found): the matches of its pattern in ``body``, where the hint is found.

    A gap and the match after it make one step; running sums of the steps' lengths are the matches' ends. They are
    summed by blocks so that long arrays stay cheap. Each projection holds what the next uses more than once.
    """
    body, names = F.col("body"), list(patterns)
    found = {n: F.when(body.rlike(hint), F.regexp_extract_all(body, F.lit(p), F.lit(0))) for n, (p, hint) in patterns.items()}
    d = d.select(*own, "body", *(found[n].alias(f"{n}_hits") for n in names))
    gaps = {n: F.transform(F.split(body, p, -1), lambda x: F.char_length(x)) for n, (p, _) in patterns.items()}
    step = lambda n: F.zip_with(
        gaps[n], F.transform(f"{n}_hits", lambda x: F.char_length(x)), lambda a, b: a + F.coalesce(b, F.lit(0)))
    d = d.select(*own, "body", *(f"{n}_hits" for n in names),
                 *(F.when(F.size(f"{n}_hits") > 0, step(n)).alias(f"{n}_steps") for n in names))
    zero = F.array(F.lit(0))
    add = lambda total, v: F.concat(total, F.array(F.element_at(total, -1) + v))
    blocks = lambda n: F.transform(
        F.sequence(F.lit(0), F.floor((F.size(f"{n}_steps") - 1) / F.lit(_BLOCK)).cast("int")),
        lambda b: F.slice(F.aggregate(F.slice(f"{n}_steps", b * _BLOCK + 1, _BLOCK), zero, add), 2, _BLOCK))
    d = d.select(*own, "body", *(f"{n}_hits" for n in names), *(blocks(n).alias(f"{n}_inner") for n in names))
    base = lambda n: F.aggregate(f"{n}_inner", zero, lambda total, part: add(total, F.element_at(part, -1)))
    d = d.select(*own, "body", *(f"{n}_hits" for n in names), *(f"{n}_inner" for n in names),
                 *(base(n).alias(f"{n}_base") for n in names))
    ends = lambda n: F.flatten(F.transform(
        f"{n}_inner", lambda part, b: F.transform(part, lambda v: v + F.get(f"{n}_base", b))))
    d = d.select(*own, "body", *(f"{n}_hits" for n in names), *(ends(n).alias(f"{n}_ends") for n in names))
    placed = lambda n: F.transform(f"{n}_hits", lambda x, i: F.struct(
        (F.get(f"{n}_ends", i) - F.char_length(x)).alias("start"), F.get(f"{n}_ends", i).alias("end"), x.alias("found")))
    return d.select(*own, "body", *(placed(n).alias(n) for n in names))


def _bits(found: Column) -> Column:
    out = None
    for shape, bits in LEAST_BITS.items():
        out = F.when(found.rlike(shape), F.lit(bits)) if out is None else out.when(found.rlike(shape), F.lit(bits))
    return out


def _hot(codes: Column, least: Column) -> Column:
    """First and last position covered by a window of at least ``least`` bits a character, null if there is none."""
    table = F.array(*(F.lit(n * math.log2(n) if n else 0.0) for n in range(WINDOW + 2)))
    start = F.struct(F.array_repeat(F.lit(0), _SLOTS).alias("counts"), F.lit(0.0).alias("total"),
                     F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"))

    def step(state: Column, i: Column) -> Column:
        counts, new, old = state["counts"], F.get(codes, i), F.get(codes, i - WINDOW)
        n_new = F.get(counts, new)
        n_old = F.get(counts, old)
        grown = F.get(table, n_new + 1) - F.get(table, n_new)
        shrunk = F.coalesce(F.get(table, n_old) - F.get(table, n_old - 1), F.lit(0.0))
        total = F.when(F.coalesce(new == old, F.lit(False)), state["total"]).otherwise(state["total"] + grown - shrunk)
        kept = F.transform(counts, lambda c, k: c + (k == new).cast("int") - F.coalesce((k == old).cast("int"), F.lit(0)))
        bits = F.lit(math.log2(WINDOW)) - total / WINDOW
        hot = (i >= WINDOW - 1) & (bits >= least - 1e-9) & (F.get(kept, F.lit(ord(COVER) - ord("+"))) == 0)
        return F.struct(kept.alias("counts"), total.alias("total"),
                        F.coalesce(state["first"], F.when(hot, i - (WINDOW - 1))).alias("first"),
                        F.when(hot, i + 1).otherwise(state["last"]).alias("last"))

    return F.aggregate(F.sequence(F.lit(0), F.size(codes) - 1), start, step,
                       lambda s: F.struct(s["first"].alias("first"), s["last"].alias("last")))


def _allowed(found: Column) -> Column:
    out = F.lit(False)
    for pattern in ALLOWED:
        out = out | found.rlike(pattern)
    return out


def _covered(found: Column) -> Column:
    """``found`` with each character of an allowed word covered."""
    out = found
    for word in ALLOWED_WORDS:
        out = F.regexp_replace(out, f"(?i){word}", COVER * len(word))
    return F.when(found.rlike("(?i)" + "|".join(ALLOWED_WORDS)), out).otherwise(found)


def find_secrets(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns and ``spans``: array of (start, end, kind number), by start, then kind as in ``KINDS``."""
    kept = [c for c in dict.fromkeys(keep) if c != "spans"]
    own = [f"_{i}" for i in range(len(kept))]
    d = docs.select(*(F.col(c).alias(o) for c, o in zip(kept, own)), F.coalesce("text", F.lit("")).alias("body"))
    body = F.col("body")
    hint = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]"""
    d = _place(d, [*own], {"assign": (ASSIGN, hint), "access": (ACCESS, ACCESS), "hex": (HEX, HEX), "runs": (CANDIDATE, CANDIDATE)})
    none = F.array().cast("array<struct<start:int,end:int,found:string>>")
    codes = lambda x: F.filter(F.transform(F.split(x, ""), lambda c: F.ascii(c) - ord("+")), lambda c: c >= 0)
    runs = F.transform(F.filter("runs", lambda x: ~_allowed(x["found"])), lambda x: F.struct(
        x["start"].alias("start"), codes(_covered(x["found"])).alias("codes"), _bits(x["found"]).alias("least")))
    values = F.filter(F.regexp_extract_all(body, F.lit(ASSIGN), F.lit(2)), lambda x: x.isNotNull())
    d = d.select(*own, F.when(F.size("assign") > 0, values).alias("values"), runs.alias("runs"),
                 *(F.coalesce(n, none).alias(n) for n in ("assign", "access", "hex")))
    span = lambda x, kind: F.struct(x["start"].cast("int").alias("start"), F.lit(kind).alias("kind"), x["end"].cast("int").alias("end"))
    base = F.concat(
        F.transform(F.filter("assign", lambda x, i: F.char_length(F.get("values", i)) >= 6), lambda x: span(x, 0)),
        F.transform("access", lambda x: span(x, 1)), F.transform("hex", lambda x: span(x, 2)))
    d = d.select(*own, F.sort_array(base).alias("base"), F.coalesce(F.transform("runs", lambda x: F.struct(
        x["start"].alias("start"), _hot(x["codes"], x["least"]).alias("hot"))), F.array()).alias("hot"))
    more = F.transform(F.filter("hot", lambda x: x["hot"]["first"].isNotNull()), lambda x: F.struct(
        (x["start"] + x["hot"]["first"]).cast("int").alias("start"), F.lit(3).alias("kind"),
        (x["start"] + x["hot"]["last"]).cast("int").alias("end")))
    more = F.filter(more, lambda m: ~F.exists("base", lambda b: (b["start"] <= m["start"]) & (m["end"] <= b["end"])))
    return d.select(*(F.col(o).alias(c) for o, c in zip(own, kept)),
                    F.when(F.size("hot") == 0, F.col("base")).otherwise(F.sort_array(F.concat("base", more))).alias("spans"))


def spans_text(spans: Column) -> Column:
    """kind:start:end of all spans, comma-joined."""
    name = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(name, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of the text replaced by a mark; ``n_chars``, where there, follows."""
    columns = docs.columns
    found = find_secrets(docs.select(F.struct(*columns).alias("row"), "text"), ["row"])
    text = F.col("row")["text"]

    def step(state: Column, s: Column) -> Column:
        apart = s["start"] >= state["at"]
        piece = F.substring(text, state["at"] + 1, s["start"] - state["at"])
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.when(
            apart, F.concat(state["pieces"], F.array(piece))).otherwise(state["pieces"]).alias("pieces"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("pieces"))
    cut = F.aggregate("spans", start, step, lambda s: F.array_join(
        F.concat(s["pieces"], F.array(F.substring(text, s["at"] + 1, F.char_length(text)))), MARK))
    d = found.select("row", F.when(F.size("spans") > 0, cut).alias("cut"))
    new = {"text": F.coalesce("cut", text)}
    if "n_chars" in columns:
        new["n_chars"] = F.coalesce(F.char_length("cut"), F.col("row")["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return d.select(*(new.get(c, F.col("row")[c]).alias(c) for c in columns))
