"""Quality rules: one projection of length, symbol, stop-word and line ratios, held against a table of thresholds.

Only built-in column expressions. A word is a run of characters other than space and U+0009 to U+000D. Counted are
words, their characters, symbols, lines that repeat an earlier line, and words inside a run of eight words that
occurs twice or more in the text. Runs are compared by 64-bit hash; only texts that hold a repeated one sort them.

A null text has no words and fails. Every row is judged on its own: repeated rows get equal verdicts, an empty
table gives an empty result, and a kept column named like a result is replaced by it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RUN = 8
_BREAK = r"[\x20\x09-\x0D]+"

# Frequent function words of the four languages.
STOP_WORDS = (
    "the of and to in is was for that it with as on be by at are from or an this have not "
    "der die das und ist von zu mit den im ein eine nicht auf für sich des dem als auch "
    "le la les et de un une est que en du dans qui pour pas au sur par avec "
    "el los las y es del por con una su se no para como más"
).split()


@dataclass(frozen=True)
class Rule:
    """``ratio`` must lie between ``least`` and ``most``; texts below ``from_words`` words are not held to it."""

    ratio: str
    least: float | None = None
    most: float | None = None
    from_words: int = 0


RULES = (
    Rule("chars_per_word", least=2.0, most=14.0),
    Rule("symbols_per_word", most=0.2),
    Rule("stop_words_per_word", least=0.02, from_words=60),
    Rule("repeated_lines_per_line", most=0.5),
    Rule("bullet_lines_per_line", most=0.9),
    Rule("ellipsis_lines_per_line", most=0.5),
)


def compile_rules(rules: tuple[Rule, ...]) -> Column:
    """One boolean expression of the whole table."""
    out = F.lit(True)
    for r in rules:
        held = F.lit(True)
        if r.least is not None:
            held = held & (F.col(r.ratio) >= r.least)
        if r.most is not None:
            held = held & (F.col(r.ratio) <= r.most)
        out = out & (held if not r.from_words else held | (F.col("n_words") < r.from_words))
    return out


def _count(x: Column) -> Column:
    return x.cast("bigint")


def judge(docs: DataFrame, keep: list[str], rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``keep`` columns, counts, ratios, ``base_failed`` and ``kept`` of each document."""
    added = {"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_stop",
             "n_lines", *(r.ratio for r in RULES)}
    kept = [c for c in dict.fromkeys(keep) if c not in added]
    body = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select(*(F.col(c).alias(f"_{i}") for i, c in enumerate(kept)), body.alias("body"))
    own = [f"_{i}" for i in range(len(kept))]
    lines = F.filter(F.split("body", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = d.select(*own, F.array_remove(F.split("body", _BREAK), "").alias("words"), lines.alias("lines"),
                 _count(F.regexp_count("body", F.lit("[#*$%&|<>]"))).alias("n_symbols"))
    ends = lambda pattern: _count(F.size(F.filter("lines", lambda x: x.rlike(pattern))))
    d = d.select(
        *own, "n_symbols", _count(F.size("words")).alias("n_words"),
        _count(F.char_length(F.array_join("words", ""))).alias("word_chars"),
        _count(F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        _count(F.size("lines")).alias("n_lines"), ends(r"^\s*[*•-]\s").alias("n_bullets"),
        ends(r"(\.\.\.|…)\s*$").alias("n_ellipsis"),
        _count(F.size(F.filter("words", lambda w: F.lower(w).isin(STOP_WORDS)))).alias("n_stop"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("codes"))
    rest = [c for c in d.columns if c != "codes"]
    runs = F.transform(F.sequence(F.lit(0), F.size("codes") - RUN),
                       lambda i: F.xxhash64(*(F.get("codes", i + k) for k in range(RUN))))
    d = d.select(*rest, F.when(F.size("codes") >= RUN, runs).alias("runs"))
    placed = F.sort_array(F.transform("runs", lambda x, i: F.struct(x.alias("code"), i.alias("at"))))
    d = d.select(*rest, F.when(F.size(F.array_distinct("runs")) < F.size("runs"), placed).alias("placed"))
    code = lambda i: F.get("placed", i)["code"]
    twice = F.filter("placed", lambda x, i: F.coalesce(x["code"] == code(i - 1), F.lit(False))
                     | F.coalesce(x["code"] == code(i + 1), F.lit(False)))
    d = d.select(*rest, F.sort_array(F.transform(twice, lambda x: x["at"])).alias("at"))
    reach = F.transform("at", lambda x, i: F.least(F.lit(RUN), F.coalesce(F.get("at", i + 1) - x, F.lit(RUN))))
    covered = F.aggregate(reach, F.lit(0), lambda total, x: total + x)
    d = d.select(*rest, F.coalesce(_count(covered), F.lit(0).cast("bigint")).alias("n_repeat_words"))
    per = lambda name, by: F.col(name) / F.greatest(F.lit(1), F.col(by))
    d = d.withColumns({
        "chars_per_word": per("word_chars", "n_words"), "symbols_per_word": per("n_symbols", "n_words"),
        "stop_words_per_word": per("n_stop", "n_words"), "repeated_lines_per_line": per("n_dup_lines", "n_lines"),
        "bullet_lines_per_line": per("n_bullets", "n_lines"), "ellipsis_lines_per_line": per("n_ellipsis", "n_lines"),
        "base_failed": (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")),
    })
    return d.select(
        *(F.col(f"_{i}").alias(c) for i, c in enumerate(kept)), "n_words", "word_chars", "n_symbols", "n_dup_lines",
        "n_repeat_words", "base_failed", (~F.col("base_failed") & compile_rules(rules)).alias("kept"),
        *(r.ratio for r in RULES))
