"""DuckDB statements of the operators that SQL can express on whole tables."""

from __future__ import annotations

from transitlapse.llm import secrets
from transitlapse.llm.quality_rules import STOP_WORDS

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)

QUALITY_RULES = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
runs AS (SELECT doc_id, i, array_to_string(w[i:i + 7], chr(10)) AS s FROM d, unnest(range(1, len(w) - 6)) u(i)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM runs) WHERE n > 1),
inside AS (SELECT doc_id, count(DISTINCT p) AS n FROM twice, unnest(range(i, i + 8)) u(p) GROUP BY 1),
c AS (SELECT d.doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, len(l) AS n_lines,
    len(list_filter(w, lambda x: lower(x) IN ({_STOPS}))) AS n_stop, len(list_filter(l, lambda x: regexp_matches(x, '^\s*[*•-]\s'))) AS n_bullets,
    len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)\s*$'))) AS n_ellipsis FROM d LEFT JOIN inside USING (doc_id)),
r AS (SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
    CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    word_chars / greatest(1, n_words) AS chars_per_word, n_symbols / greatest(1, n_words) AS symbols_per_word, n_stop / greatest(1, n_words) AS stop_words_per_word,
    n_dup_lines / greatest(1, n_lines) AS repeated_lines_per_line, n_bullets / greatest(1, n_lines) AS bullet_lines_per_line,
    n_ellipsis / greatest(1, n_lines) AS ellipsis_lines_per_line FROM c)
SELECT *, NOT base_failed AND chars_per_word BETWEEN 2 AND 14 AND symbols_per_word <= 0.2 AND (stop_words_per_word >= 0.02 OR n_words < 60)
  AND repeated_lines_per_line <= 0.5 AND bullet_lines_per_line <= 0.9 AND ellipsis_lines_per_line <= 0.5 AS kept FROM r"""

_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
DECONTAMINATE = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS s
  FROM b, unnest(range(1, greatest(1, len(w) - 9) + 1)) u(i) WHERE len(w) > 0),
seen AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM d, (SELECT DISTINCT n FROM win), unnest(range(1, len(w) - n + 2)) u(i)),
hit AS (SELECT doc_id, i, n, item_id FROM seen JOIN win USING (n, s)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hit, unnest(range(i, i + n)) u(p) GROUP BY 1),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items,
  string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hit GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""



def _clustering(rounds: int = 5, k: int = 40, dimensions: int = 64) -> str:
    """Every round as one statement of its own: assignment (a) of all vectors, then centroids (c)."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (SELECT n, arg_min(c, (d, c)) AS c, min(d) AS d FROM (
  SELECT x.n, c.c, sum((x.v - c.v) * (x.v - c.v)) AS d FROM x JOIN c{r} c USING (j) GROUP BY ALL) GROUP BY n)""")
        if r < rounds:
            steps.append(f"""c{r + 1} AS MATERIALIZED (SELECT o.c, o.j, coalesce((s - ((s % m + m) % m)) // m, o.v) AS v FROM c{r} o LEFT JOIN (
  SELECT c, j, sum(v) AS s, count(*) AS m FROM a{r} JOIN x USING (n) GROUP BY ALL) USING (c, j))""")
    return f"""
WITH e AS (SELECT row_number() OVER () AS n, vec_id, embedding AS v FROM embeddings
  WHERE len(embedding) = {dimensions} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dimensions}),
x AS MATERIALIZED (SELECT n, j, CAST(floor(256 * CAST(v[j] AS DOUBLE)) AS HUGEINT) AS v FROM e, unnest(range(1, {dimensions + 1})) u(j)),
p AS (SELECT n, row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS c FROM e WHERE vec_id IS NOT NULL
  ORDER BY sha256('2:' || vec_id) LIMIT {k}),
c0 AS MATERIALIZED (SELECT c, j, v FROM p JOIN x USING (n)),
{", ".join(steps)},
h AS (SELECT c, sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY j)) AS h FROM c{rounds} GROUP BY c)
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, h AS centroid_sha256 FROM a{rounds} JOIN h USING (c) JOIN e USING (n)"""



def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _found(kind: int, pattern: str, group: str = "0") -> str:
    """doc_id, kind, number, start, end and text of every match; ``group`` is what ``value`` holds."""
    p = _quoted(pattern)
    before = "coalesce(list_sum(list_transform(g[1:k], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: length(x))), 0)"
    return f"""SELECT doc_id, {kind} AS kind, k, {before} AS a, {before} + length(m[k]) AS b, m[k] AS found, v[k] AS value FROM (
      SELECT doc_id, regexp_extract_all(t, {p}) AS m, regexp_extract_all(t, {p}, {group}) AS v, string_split_regex(t, {p}) AS g FROM d
      WHERE regexp_matches(t, {p})), unnest(range(1, len(m) + 1)) u(k)"""


_LEAST = "CASE " + " ".join(
    f"WHEN regexp_matches(found, {_quoted(shape)}) THEN {bits}e0" for shape, bits in secrets.LEAST_BITS.items()) + " END"
_BITS = """-list_sum(list_transform(list_distinct(chars), lambda c: len(list_filter(chars, lambda x: x = c)) / 20e0
  * log2(len(list_filter(chars, lambda x: x = c)) / 20e0)))"""
_ALLOW = " OR ".join(f"regexp_matches(found, {_quoted(p)})" for p in secrets.ALLOWED)
_COVERED = "found"
for _word in secrets.ALLOWED_WORDS:
    _COVERED = f"regexp_replace({_COVERED}, '{_word}', '{secrets.COVER * len(_word)}', 'gi')"
SECRETS = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
base AS (SELECT doc_id, kind, a, b FROM ({_found(0, secrets.ASSIGN, "2")}) WHERE length(value) >= 6
  UNION ALL SELECT doc_id, kind, a, b FROM ({_found(1, secrets.ACCESS)}) UNION ALL SELECT doc_id, kind, a, b FROM ({_found(2, secrets.HEX)})),
runs AS (SELECT * FROM ({_found(3, secrets.CANDIDATE)}) WHERE NOT ({_ALLOW})),
windows AS (SELECT doc_id, k, a, i, {_LEAST} AS least_bits, string_split(substr({_COVERED}, CAST(i + 1 AS INTEGER), 20), '') AS chars
  FROM runs, unnest(range(0, length(found) - 19)) u(i)),
hot AS (SELECT doc_id, 3 AS kind, a + min(i) AS a, a + max(i) + 20 AS b FROM windows WHERE {_BITS} >= least_bits - 1e-9 AND NOT list_contains(chars, '{secrets.COVER}') GROUP BY doc_id, k, windows.a),
spans AS (SELECT * FROM base UNION ALL SELECT h.* FROM hot h WHERE NOT EXISTS (SELECT 1 FROM base s WHERE s.doc_id = h.doc_id AND s.a <= h.a AND h.b <= s.b)),
told AS (SELECT doc_id, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex,
  string_agg(s, ',' ORDER BY a, kind) FILTER (WHERE kind < 3) AS base, string_agg(s, ',' ORDER BY a, kind) AS spans
  FROM (SELECT *, ['assign', 'access', 'hex', 'entropy'][kind + 1] || ':' || CAST(a AS BIGINT) || ':' || CAST(b AS BIGINT) AS s FROM spans) GROUP BY 1)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN told USING (doc_id)"""

ORACLES = {"op2_quality_rules": QUALITY_RULES, "op5_secret_scan": SECRETS, "op8_decontaminate": DECONTAMINATE,
           "op11_centroid_clusters": _clustering()}
