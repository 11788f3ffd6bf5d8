"""The same results in SQL for DuckDB, where SQL can express them.

Suffix arrays, trained models and page trees have no SQL; tests hold them against brute force or
held-out accuracy.
"""

from __future__ import annotations

import re

from clozemill.llm import licences, mixing, quality

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SPACES = r"[\x20\x09-\x0D]+"


def low(text: str) -> str:
    return f"translate({text}, '{UPPER}', '{UPPER.lower()}')"


def quality_sql() -> str:
    stops = ", ".join(f"'{w}'" for w in dict.fromkeys(quality.STOP_WORDS.split()))
    latin, other = (re.sub(r"\\u([0-9A-F]{4})", r"\\x{\1}", x) for x in (quality.LATIN, quality.OTHER))
    rules = " AND ".join(
        part for _, metric, least, most in quality.RULES
        for part in ([f"coalesce({metric} >= {least}, true)"] if least is not None else [])
        + ([f"coalesce({metric} <= {most}, true)"] if most is not None else []))
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '{SPACES}'), lambda x: x <> '') AS ws FROM d),
g AS (SELECT r, i, array_to_string(ws[i:i + 7], ' ') AS g
      FROM (SELECT r, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)),
twice AS (SELECT r, i FROM (SELECT *, count(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY r),
l AS (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM w),
m AS (SELECT l.doc_id, len(ws)::BIGINT AS n_words,
        length(array_to_string(ws, ''))::BIGINT AS word_chars,
        (length(t) - length(regexp_replace(t, '[{quality.SYMBOLS}]', '', 'g')))::BIGINT AS n_symbols,
        (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
        coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
        len(ls) AS n_lines, length(t) AS n_all,
        len(list_filter(ws, lambda x: lower(rtrim(x, '{quality.MARKS}')) IN ({stops}))) AS n_stop,
        length(t) - length(regexp_replace(t, '{latin}', '', 'g')) AS latin,
        length(t) - length(regexp_replace(t, '{other}', '', 'g')) AS other
      FROM l LEFT JOIN rep USING (r)),
x AS (SELECT *, word_chars / greatest(n_words, 1)::DOUBLE AS mean_word_length,
        n_symbols / greatest(n_all, 1)::DOUBLE AS symbol_ratio,
        n_dup_lines / greatest(n_lines, 1)::DOUBLE AS dup_line_ratio,
        n_repeat_words / greatest(n_words, 1)::DOUBLE AS repeat_word_ratio,
        CASE WHEN n_stop / greatest(n_words, 1)::DOUBLE < {quality.LISTED} AND latin < other THEN NULL
             ELSE n_stop / greatest(n_words, 1)::DOUBLE END AS stop_word_ratio,
        (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {rules} AS kept FROM x"""


def contamination_sql() -> str:
    words = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
             regexp_extract_all({low("coalesce(text, '')")}, '{words}') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all({low("coalesce(text, '')")}, '{words}') AS ws FROM benchmark),
p AS (SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[i:i + 9], ' ') AS g
      FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
s AS (SELECT r, n, i, array_to_string(ws[i:i + n - 1], ' ') AS g
      FROM (SELECT r, ws, n, unnest(range(1, len(ws) - n + 2)) AS i
            FROM d, (SELECT DISTINCT n FROM p))),
h AS (SELECT s.r, s.i, s.n, p.item_id FROM s JOIN p ON s.n = p.n AND s.g = p.g),
hit AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS q FROM h) GROUP BY r),
it AS (SELECT r, list_sort(list(DISTINCT item_id::VARCHAR)) AS items FROM h GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(len(items), 0)::BIGINT AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN it USING (r)"""


def dedup_sql(size: int = 2, percent: int = 80) -> str:
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array({low("coalesce(text, '')")}, '{SPACES}'),
                              lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + {size - 1}], ' ') AS g
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - {size - 1}, 1) + 1)) AS i
            FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
k AS (SELECT s.doc_id, s.g, n.n FROM s JOIN n USING (doc_id)),
link AS (SELECT a.doc_id AS x, b.doc_id AS y FROM k a JOIN k b
           ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n)
         GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
twoway AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach AS (SELECT x, y FROM twoway UNION SELECT reach.x, twoway.y FROM reach JOIN twoway ON reach.y = twoway.x),
low AS (SELECT x AS doc_id, least(min(y), x) AS c FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(low.c, d.doc_id) AS component_id,
       coalesce(low.c, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN low USING (doc_id)"""


def mixing_sql() -> str:
    weight = " ".join(f"WHEN source = '{k}' THEN {v}" for k, v in mixing.TARGETS.items())
    b = mixing.BLOCK
    return f"""
WITH RECURSIVE sup AS (SELECT source, count(*) AS n, (CASE {weight} ELSE {mixing.DEFAULT_WEIGHT} END)::BIGINT AS w
                       FROM documents GROUP BY source),
ord AS (SELECT *, row_number() OVER (ORDER BY w DESC, source NULLS FIRST) AS i FROM sup),
one AS (SELECT list(w ORDER BY i) AS w, list(n ORDER BY i) AS n, sum(w)::BIGINT AS q, count(*)::BIGINT AS m FROM ord),
run AS (
  SELECT 0::BIGINT AS t, list_transform(w, lambda x: 0::BIGINT) AS nxt, NULL::BIGINT AS i, NULL::BIGINT[] AS before FROM one
  UNION ALL
  SELECT t + 1, list_transform(range(1, m + 1), lambda j: nxt[j] + (CASE WHEN j = c THEN 1 ELSE 0 END)::BIGINT), c, nxt
  FROM (SELECT run.t, run.nxt, one.m, list_min(list_transform(range(1, m + 1), lambda j:
          CASE WHEN nxt[j] < w[j] AND (nxt[j] * q) // w[j] <= t
               THEN (((nxt[j] + 1) * q + w[j] - 1) // w[j]) * 100000 + j ELSE 1000000000000 END)) % 100000 AS c
        FROM run, one WHERE run.t < one.q)),
slot AS (SELECT t - 1 AS slot, run.i, before, before[run.i] AS k FROM run WHERE t > 0),
r AS (SELECT doc_id, d.source, ord.i, ord.w AS own, md5(coalesce(doc_id::VARCHAR, '') || ':{mixing.SEED}') AS h,
        ceil(ord.n / {mixing.BUCKET_ROWS}.0)::BIGINT AS nb
      FROM documents d JOIN ord ON d.source IS NOT DISTINCT FROM ord.source),
k AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY ('0x' || h[1:8])::BIGINT % nb, h, doc_id) - 1 AS rk FROM r),
p AS (SELECT k.*, rk // {b} AS block, rk % {b} AS part, (rk // {b}) // own AS turn FROM k)
SELECT p.doc_id, p.source, p.block, turn * q + slot.slot AS slot, turn * q + (slot.k * q) // own AS release,
       turn * q + ((slot.k + 1) * q + own - 1) // own AS deadline,
       (list_sum(list_transform(range(1, m + 1), lambda j: least(one.n[j], {b} * (turn * one.w[j] + slot.before[j])))) + part
       )::BIGINT AS position
FROM p JOIN slot ON slot.i = p.i AND slot.k = p.block % p.own, one"""


def licence_sql() -> str:
    model = licences.Model()
    rows = ", ".join(f"({i}, '{n}', '{t}', {w!r}::DOUBLE)" for i, n, t, w in model.rows)
    idf = ", ".join(f"('{t}', {v!r}::DOUBLE)" for t, v in sorted(model.idf.items()))
    return rf"""
WITH weights(template, licence, term, weight) AS (VALUES {rows}), idf(term, idf) AS (VALUES {idf}),
f AS (SELECT doc_id, text, coalesce(source, 'unknown') AS a FROM documents),
g AS (SELECT *, a || '/d' || ((doc_id // 100) % 10) AS b FROM f),
p AS (SELECT doc_id, text, CASE WHEN doc_id % 10 <> 0 THEN c || '/' || doc_id || '.txt'
        WHEN (doc_id // 10) % 3 = 0 THEN a || '/LICENSE' WHEN (doc_id // 10) % 3 = 1 THEN b || '/LICENSE'
        ELSE c || '/LICENSE' END AS path
      FROM (SELECT *, b || '/e' || ((doc_id // 10) % 10) AS c FROM g)),
ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM p),
tf AS (SELECT line, term, count(*) AS n FROM (
         SELECT line, unnest(regexp_extract_all({low('line')}, '[a-z0-9]+')) AS term FROM (SELECT DISTINCT line FROM ln))
       GROUP BY line, term),
tw AS (SELECT line, term, n * coalesce(idf, {model.other!r}::DOUBLE) AS w FROM tf LEFT JOIN idf USING (term)),
nr AS (SELECT line, sqrt(sum(w * w)) AS norm FROM tw GROUP BY line),
sc AS (SELECT line, template, licence, round(sum(w * weight) / any_value(norm), 6) AS score
       FROM tw JOIN weights USING (term) JOIN nr USING (line) GROUP BY line, template, licence),
own AS (SELECT doc_id, licence AS own_licence, score AS own_score FROM (
          SELECT doc_id, licence, score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, licence) AS k
          FROM ln JOIN sc USING (line) WHERE score >= {model.threshold}) WHERE k = 1),
l AS (SELECT p.doc_id, path, regexp_replace(path, '/[^/]*$', '') AS dir, own_licence, own_score
      FROM p LEFT JOIN own USING (doc_id)),
given AS (SELECT dir AS from_dir, own_licence AS dir_licence FROM (
            SELECT *, row_number() OVER (PARTITION BY dir ORDER BY own_score DESC, own_licence) AS k
            FROM l WHERE path LIKE '%/LICENSE' AND own_licence IS NOT NULL) WHERE k = 1),
near AS (SELECT dir, from_dir, dir_licence FROM (
           SELECT d.dir, given.*, row_number() OVER (PARTITION BY d.dir ORDER BY length(from_dir) DESC) AS k
           FROM (SELECT DISTINCT dir FROM l) d JOIN given
             ON d.dir = from_dir OR starts_with(d.dir, from_dir || '/')) WHERE k = 1)
SELECT doc_id, path, own_licence, own_score, coalesce(own_licence, dir_licence) AS licence,
       CASE WHEN own_licence IS NULL THEN from_dir END AS inherited_from
FROM l LEFT JOIN near USING (dir)"""


ORACLES: dict[str, str] = {
    "op3_licence_scan": licence_sql(),
    "op5_source_mixing": mixing_sql(),
    "op6_quality_rules": quality_sql(),
    "op8_decontamination": contamination_sql(),
    "op10_minhash_dedup": dedup_sql(),
}
