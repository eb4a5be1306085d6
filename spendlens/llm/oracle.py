"""DuckDB SQL with the rows of those queries that SQL can express.

The others have no SQL form: fuzzy matching (op1), trained models (op2, op9), XXH64 fingerprints
(op3), disguised identifiers (op5), token ids (op6, op11) and the runs of all periods (op13); tests/llm
holds them against brute force, held-out data or exact round trips.
"""

from __future__ import annotations

_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_ITEM_WORDS = rf"list_filter(string_split_regex(translate(coalesce(text, ''), {_LOWER}), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
_SPACE_WORD = r"[^\x20\x09-\x0D]+"

OP4 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, i, substr(h, 2 * i + 1, 200) AS s
      FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 99)) AS i FROM d)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS n FROM p) WHERE n > 1),
m AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run
      FROM (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS fresh FROM r)),
runs AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM m GROUP BY doc_id, run),
cuts AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM runs),
kept AS (SELECT c.doc_id, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head,
                max(b) AS tail, sum(b - a) AS removed, count(*) AS spans
         FROM cuts c JOIN d ON c.doc_id = d.doc_id GROUP BY c.doc_id)
SELECT d.doc_id, length(h) // 2 AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(tail, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""

OP7 = f"""
WITH d AS (SELECT doc_id, {_ITEM_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_ITEM_WORDS} AS w FROM benchmark),
s AS (SELECT item_id, w, least(10, len(w)) AS size FROM b WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, size, array_to_string(w[i:i + size - 1], ' ') AS k
            FROM (SELECT item_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM s)),
sizes AS (SELECT DISTINCT size FROM windows),
spots AS (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes),
hits AS (SELECT doc_id, i, a.size, item_id
         FROM (SELECT doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') AS k FROM spots) a
         JOIN windows v ON a.k = v.k AND a.size = v.size),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS l
          FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(covered.n, 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items,
       sha256(coalesce(l, '')) AS items_sha256, coalesce(covered.n, 0) > 0 AS contaminated
FROM d LEFT JOIN covered ON d.doc_id = covered.doc_id LEFT JOIN items ON d.doc_id = items.doc_id
"""

# Lines with a word that occur earlier go; in the other lines, stretches of repeated sentences.
OP8 = f"""
WITH l AS (SELECT doc_id, generate_subscripts(ls, 1) - 1 AS unit, unnest(ls) AS line, len(ls) AS units
           FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text <> '')),
n AS (SELECT doc_id, unit, line, units, regexp_extract_all(translate(line, {_LOWER}), '{_SPACE_WORD}') AS w,
             coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY unit ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS a
      FROM l),
k AS (SELECT *, len(w) > 0 AND row_number() OVER (PARTITION BY array_to_string(w, ' ') ORDER BY doc_id, unit) > 1 AS gone FROM n),
p AS (SELECT doc_id, unit, gone, a, generate_subscripts(ps, 1) AS i, unnest(ps) AS piece
      FROM (SELECT *, regexp_extract_all(line, '[^.!?]*[.!?]+|[^.!?]+') AS ps FROM k)),
q AS (SELECT *, regexp_extract_all(translate(piece, {_LOWER}), '{_SPACE_WORD}') AS w,
             a + coalesce(sum(length(piece)) OVER (PARTITION BY doc_id, unit ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s
      FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY array_to_string(w, ' ') ORDER BY doc_id, s) > 1 AS again,
             row_number() OVER (PARTITION BY doc_id, unit ORDER BY i) AS nr FROM q WHERE len(w) > 0),
u AS (SELECT *, nr - row_number() OVER (PARTITION BY doc_id, unit ORDER BY nr) AS run FROM r WHERE again AND NOT gone),
passages AS (SELECT doc_id, unit, min(s) AS s, max(s + length(piece)) AS e FROM u GROUP BY doc_id, unit, run HAVING sum(len(w)) >= 25),
kept AS (SELECT q.doc_id, q.unit, string_agg(piece, '' ORDER BY i) FILTER (WHERE passages.s IS NULL) AS line
         FROM q LEFT JOIN passages ON q.doc_id = passages.doc_id AND q.unit = passages.unit AND q.s BETWEEN passages.s AND passages.e - 1
         WHERE NOT gone GROUP BY q.doc_id, q.unit),
spans AS (SELECT doc_id, a AS s, a + length(line) AS e FROM k WHERE gone UNION ALL SELECT doc_id, s, e FROM passages),
cut AS (SELECT doc_id, sum(e - s) AS n, string_agg(s || ':' || e, ',' ORDER BY s) AS l FROM spans GROUP BY doc_id),
inner_cuts AS (SELECT doc_id, count(*) AS n FROM passages GROUP BY doc_id),
t AS (SELECT k.doc_id, max(units) AS n_units, count(*) FILTER (WHERE gone) AS n_removed,
             string_agg(coalesce(kept.line, '') || CASE WHEN k.unit < units - 1 THEN chr(10) ELSE '' END, '' ORDER BY k.unit) FILTER (WHERE NOT gone) AS kept
      FROM k LEFT JOIN kept ON k.doc_id = kept.doc_id AND k.unit = kept.unit GROUP BY k.doc_id)
SELECT d.doc_id, coalesce(n_units, 0)::BIGINT AS n_units, coalesce(n_removed, 0)::BIGINT AS n_removed,
       coalesce(inner_cuts.n, 0)::BIGINT AS n_passages, coalesce(cut.n, 0)::BIGINT AS n_chars_removed, coalesce(cut.l, '') AS spans,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN t ON d.doc_id = t.doc_id LEFT JOIN cut ON d.doc_id = cut.doc_id LEFT JOIN inner_cuts ON d.doc_id = inner_cuts.doc_id
"""

# The failure counts of each rule, as (name, condition); the prior's formulas follow quality.prior.
_RULES = {
    "few_words": "n_words < 10",
    "repetition": "n_repeat_words * 100 > n_words * 20",
    "symbols": "n_symbols * 10 > n_words",
    "word_length": "word_chars < n_words * 2 OR word_chars > n_words * 12",
    "dup_lines": "n_dup_lines * 100 > n_lines * 30",
}


def _per_rule(template: str) -> str:
    return ",\n       ".join(template.replace("@", r) for r in _RULES)


_FAILURES = ", ".join(f"sum(({c})::INT) AS f_{r}" for r, c in _RULES.items())
_FURTHER = " + ".join(f"({_RULES[r]})::INT" for r in ("symbols", "word_length", "dup_lines"))
_RATES = ", ".join(f"(f_{r} + mean_{r} * m_{r}) / (h.n + m_{r}) AS rate_{r}, h.n + m_{r} + 1 AS size_{r}, mean_{r}" for r in _RULES)
_WORST = ", ".join(f"rate_{r}" for r in _RULES)
_OVER = " OR ".join(f"rate_{r} - 3.0 * sqrt(rate_{r} * (1 - rate_{r}) / size_{r}) > 2.0 * mean_{r}" for r in _RULES)

OP10 = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_SPACE_WORD}') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM win) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM again) GROUP BY doc_id),
c AS (SELECT d.doc_id, source, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
             length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols,
             len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_SPACE_WORD}'))) AS n_lines,
             len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_SPACE_WORD}')))
             - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_SPACE_WORD}')))) AS n_dup_lines,
             coalesce(rep.n, 0) AS n_repeat_words
      FROM d LEFT JOIN rep ON d.doc_id = rep.doc_id),
h AS (SELECT source, count(*) AS n, {_FAILURES} FROM c WHERE source IS NOT NULL GROUP BY source),
s AS (SELECT count(*) AS hosts, sum(n) AS n, sum(n::DOUBLE * n) AS nn,
       {_per_rule("sum(f_@)::DOUBLE / sum(n) AS mean_@")},
       {_per_rule("sum(f_@::DOUBLE * f_@ / n) - sum(f_@)::DOUBLE * sum(f_@) / sum(n) AS within_@")} FROM h),
v AS (SELECT *, {_per_rule("CASE WHEN n - nn / n > 0 THEN (within_@ - (hosts - 1) * mean_@ * (1 - mean_@)) / (n - nn / n) ELSE 0 END AS between_@")} FROM s),
p AS (SELECT *, {_per_rule("CASE WHEN between_@ <= 0 OR mean_@ * (1 - mean_@) <= 0 THEN 1e6 ELSE least(1e6, greatest(1.0, mean_@ * (1 - mean_@) / between_@ - 1)) END AS m_@")} FROM v),
rates AS (SELECT source, h.n, {_RATES} FROM h, p),
bad AS (SELECT source, n AS host_n, greatest({_WORST}) AS host_rate, ({_OVER}) AS over FROM rates)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words,
       ({_RULES["few_words"]} OR {_RULES["repetition"]}) AS base_failed,
       NOT ({_RULES["few_words"]} OR {_RULES["repetition"]})
         AND {_FURTHER} <= CASE WHEN coalesce(over, false) THEN 0 ELSE 1 END AS kept,
       host_n, round(host_rate, 9) AS host_rate, coalesce(over, false) AS host_rejected
FROM c LEFT JOIN bad ON c.source = bad.source
"""

OP12 = """
WITH h AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS d FROM documents),
k AS (SELECT doc_id, t, length(t) AS n, ('0x' || d[1:8])::BIGINT AS h1, ('0x' || d[9:16])::BIGINT AS h2,
             ('0x' || d[17:24])::BIGINT AS h3, ('0x' || d[25:32])::BIGINT AS h4 FROM h),
c AS (SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
             CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                  WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM k),
p AS (SELECT doc_id, t, n, form, a, b, '<P>' || substr(t, 1, a) AS p, '<M>' || substr(t, a + 1, b - a) AS m, '<S>' || substr(t, b + 1) AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN p || s || m ELSE s || p || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM p
"""

ORACLE: dict[str, str] = {
    "op4_substring_dedup": OP4,
    "op7_decontamination": OP7,
    "op8_line_dedup": OP8,
    "op10_host_quality": OP10,
    "op12_fill_in_middle": OP12,
}
