"""The registered queries in SQL, over the same parquet tables, for DuckDB."""

from __future__ import annotations

from clozemill.functions.words import GENERIC_WORDS, STOP_WORDS

LETTERS = "ABCD"


def _list(words) -> str:
    return ", ".join("'" + w + "'" for w in words)


STOP = _list(STOP_WORDS)
GENERIC = _list(GENERIC_WORDS)


def sents(text: str) -> str:
    marked = rf"regexp_replace({text}, '([.!?])[ \n\t\r]+', '\1' || chr(1), 'g')"
    return (
        f"list_filter(list_transform(string_split({marked}, chr(1)), "
        r"lambda s: regexp_replace(s, '^[ \n\t\r]+|[ \n\t\r]+$', '', 'g')), lambda s: s <> '')"
    )


def words(text: str) -> str:
    return rf"regexp_extract_all({text}, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_ \n\t\r]')"


def unigrams(text: str) -> str:
    return (
        rf"list_filter(regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}_]{{2,}}'), "
        f"lambda w: w NOT IN ({STOP}))"
    )


# quiz rows of all passages
QUIZ = rf"""
qs AS (
  SELECT doc_id AS id, text AS article, {sents('text')} AS sl FROM documents),
qq AS (SELECT id, article, sl[1] AS question FROM qs WHERE len(sl) > 0),
qw AS (
  SELECT id, w, md5(id || ':' || w) AS h FROM (
    SELECT DISTINCT id, unnest(regexp_extract_all(lower(question), '[\p{{L}}\p{{N}}_]+')) AS w FROM qq)
  WHERE length(w) >= 4),
aw AS (
  SELECT id, w, md5(id || ':' || w) AS h FROM (
    SELECT DISTINCT id, unnest(regexp_extract_all(lower(article), '[\p{{L}}\p{{N}}_]+')) AS w FROM qq)
  WHERE length(w) >= 4 AND (id, w) NOT IN (SELECT (id, w) FROM qw)),
rightw AS (SELECT id, arg_min(w, (h, w)) AS correct FROM qw GROUP BY id),
wrongw AS (
  SELECT id, list(w ORDER BY h, w) AS ws FROM (
    SELECT *, row_number() OVER (PARTITION BY id ORDER BY h, w) AS rn FROM aw)
  WHERE rn <= 3 GROUP BY id HAVING count(*) = 3),
quiz AS (
  SELECT id, article, question, correct, ws,
    {", ".join(f"CASE WHEN id % 4 = {i} THEN correct WHEN id % 4 > {i} THEN ws[{i + 1}] ELSE ws[{max(i, 1)}] END AS {c}"
               for i, c in enumerate(LETTERS))},
    substr('ABCD', CAST(id % 4 + 1 AS INTEGER), 1) AS answer
  FROM qq JOIN rightw USING (id) JOIN wrongw USING (id))"""

# sentences of the quiz articles
SENT = rf"""
sent AS (
  SELECT id, unnest(range(len(sl))) AS pos, unnest(sl) AS sentence
  FROM (SELECT id, {sents('article')} AS sl FROM quiz))"""


def grams(name: str, source: str, keys: str, text: str) -> str:
    """CTE ``name(keys, term)``: every 1- and 2-gram occurrence."""
    return f"""
{name}_u AS (SELECT {keys}, {unigrams(text)} AS u FROM {source}),
{name} AS (
  SELECT {keys}, unnest(u) AS term FROM {name}_u
  UNION ALL
  SELECT {keys}, unnest(list_transform(range(1, len(u)), lambda i: u[i] || ' ' || u[i + 1])) AS term
  FROM {name}_u)"""


# vocabulary fitted on the train rows of the exact split
VOCAB = f"""
corpus AS (SELECT id, article || ' ' || A || ' ' || B || ' ' || C || ' ' || D AS text FROM quiz),
{grams('cg', 'corpus', 'id', 'text')},
train AS (
  SELECT id FROM (
    SELECT id, row_number() OVER (ORDER BY md5('42:' || id), id) AS rn, count(*) OVER () AS n FROM quiz)
  WHERE rn <= n - (n + 4) // 5),
tc AS (
  SELECT term, count(DISTINCT id) AS df, count(*) AS cf FROM cg SEMI JOIN train USING (id) GROUP BY term),
vocab AS (
  SELECT term, df, cf, ln((1 + (SELECT count(*) FROM train)) / (1 + df)) + 1 AS idf
  FROM tc WHERE df >= 2 ORDER BY cf DESC, term LIMIT 50000)"""


def weights(name: str, gram_cte: str, keys: str) -> str:
    return f"""
{name} AS (
  SELECT {keys}, term, (1 + ln(count(*))) * any_value(idf) AS w
  FROM {gram_cte} JOIN vocab USING (term) GROUP BY {keys}, term)"""


def sims(name: str, sent_cte: str, query_cte: str, qkeys: str = "id") -> str:
    """CTE ``name(qkeys, pos, sim)``: every sentence with every query of its passage.
    ``query_cte`` has ``qkeys`` (first of them id) and ``text``."""
    extra = "".join(", q." + k.strip() for k in qkeys.split(",")[1:])
    return f"""
{grams(name + '_sg', sent_cte, 'id, pos', 'sentence')},
{weights(name + '_sw', name + '_sg', 'id, pos')},
{grams(name + '_qg', query_cte, qkeys, 'text')},
{weights(name + '_qw', name + '_qg', qkeys)},
{name}_sn AS (SELECT id, pos, sqrt(sum(w * w)) AS n FROM {name}_sw GROUP BY id, pos),
{name}_qn AS (SELECT {qkeys}, sqrt(sum(w * w)) AS n FROM {name}_qw GROUP BY {qkeys}),
{name}_dot AS (
  SELECT q.id{extra}, s.pos, sum(s.w * q.w) AS dot
  FROM {name}_sw s JOIN {name}_qw q ON s.id = q.id AND s.term = q.term
  GROUP BY q.id{extra}, s.pos),
{name} AS (
  SELECT q.id{extra}, s.pos, round(coalesce(d.dot / (sn.n * qn.n), 0), 9) AS sim
  FROM {query_cte} q JOIN {sent_cte} s ON q.id = s.id
  LEFT JOIN {name}_dot d ON d.id = q.id AND d.pos = s.pos
    {"".join(f" AND d.{k.strip()} = q.{k.strip()}" for k in qkeys.split(",")[1:])}
  LEFT JOIN {name}_sn sn ON sn.id = s.id AND sn.pos = s.pos
  LEFT JOIN {name}_qn qn ON qn.id = q.id
    {"".join(f" AND qn.{k.strip()} = q.{k.strip()}" for k in qkeys.split(",")[1:])})"""


def sql(*ctes: str, select: str) -> str:
    return "WITH " + ",".join(ctes) + "\n" + select


ORACLES: dict[str, str] = {}

ORACLES["quiz_view"] = sql(QUIZ, select="SELECT id, question, A, B, C, D, answer FROM quiz")
ORACLES["tfidf_vocab"] = sql(
    QUIZ, VOCAB, select="SELECT term, df, cf, round(idf, 6) AS idf FROM vocab")
ORACLES["tfidf_weights"] = sql(
    QUIZ, VOCAB, weights("cw", "cg", "id"),
    select="""
SELECT id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY id)), 6) AS w FROM cw""")
ANSWER_QUERY = "aq AS (SELECT id, correct AS text FROM quiz)"
ORACLES["best_sentence"] = sql(
    QUIZ, SENT, VOCAB, ANSWER_QUERY, sims("sm", "sent", "aq"),
    select="""
SELECT sm.id, any_value(text) AS query, arg_max(sm.pos, (sim, -sm.pos)) AS pos, round(max(sim), 6) AS sim,
       arg_max(sentence, (sim, -sm.pos)) AS sentence
FROM sm JOIN sent USING (id, pos) JOIN aq ON aq.id = sm.id GROUP BY sm.id""")

# ---- splits and samples
RANKED = """
r AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) AS rn,
             count(*) OVER () AS n FROM documents)"""
ORACLES["split_exact"] = sql(RANKED, select="""
SELECT doc_id, CASE WHEN rn <= n - (n + 4) // 5 THEN 'train'
  WHEN rn <= n - ((n + 4) // 5 + 1) // 2 THEN 'val' ELSE 'test' END AS split FROM r""")
ORACLES["split_sizes"] = """
WITH t AS (SELECT count(*) AS n, (count(*) + 4) // 5 AS h FROM documents)
SELECT 'train' AS split, n - h AS n FROM t UNION ALL SELECT 'test', (h + 1) // 2 FROM t
UNION ALL SELECT 'val', h - (h + 1) // 2 FROM t"""
ORACLES["split_by_article"] = """
WITH g AS (SELECT DISTINCT md5(text) AS k FROM documents),
r AS (SELECT k, row_number() OVER (ORDER BY md5('42:' || k), k) AS rn, count(*) OVER () AS n FROM g)
SELECT doc_id, CASE WHEN rn <= n - (n + 4) // 5 THEN 'train'
  WHEN rn <= n - ((n + 4) // 5 + 1) // 2 THEN 'val' ELSE 'test' END AS split
FROM documents JOIN r ON md5(text) = k"""
ORACLES["split_threshold"] = """
WITH u AS (SELECT doc_id, CAST('0x' || substr(md5('42:' || doc_id), 1, 8) AS BIGINT) / 4294967296.0 AS u
  FROM documents)
SELECT doc_id, CASE WHEN u < 0.8 THEN 'train' WHEN u < 0.9 THEN 'val' ELSE 'test' END AS split FROM u"""
ORACLES["sample_topk"] = sql(RANKED, select="""
SELECT CAST(k AS INTEGER) AS k, doc_id FROM r, (VALUES (1), (100), (500)) v(k) WHERE rn <= k""")
ORACLES["head_n"] = "SELECT doc_id, lang, n_chars FROM documents ORDER BY doc_id LIMIT 150"
ORACLES["stratified_folds"] = """
SELECT doc_id, lang, row_number() OVER (
  PARTITION BY lang ORDER BY md5('42:' || doc_id), doc_id) % 3 AS fold FROM documents"""

# ---- options and labels
ORACLES["option_unpivot"] = sql(QUIZ, select="\nUNION ALL\n".join(
    f"SELECT id, '{c}' AS opt, question || ' ' || {c} AS text, CAST(answer = '{c}' AS INTEGER) AS label FROM quiz"
    for c in LETTERS))
ORACLES["label_counts"] = sql(QUIZ, select="""
SELECT 1 AS label, count(*) AS n FROM quiz UNION ALL SELECT 0, 3 * count(*) FROM quiz""")
ORACLES["text_unpivot"] = sql(
    QUIZ,
    "cells AS (" + " UNION ALL ".join(
        f"SELECT id, '{c}' AS field, {c} AS raw FROM quiz"
        for c in ["article", *LETTERS, "question"]) + ")",
    f"tok AS (SELECT id, field, {words('lower(raw)')} AS t FROM cells WHERE trim(raw) <> '')",
    select="SELECT id, field, len(t) AS n, md5(array_to_string(t, ' ')) AS h FROM tok")
ORACLES["wrong_options"] = sql(QUIZ, select="""
SELECT id, correct, array_to_string(ws, '|') AS wrong, question || ' ' || correct AS cluster_text,
  md5(article || ' ' || A || ' ' || B || ' ' || C || ' ' || D) AS corpus_hash,
  md5(question || ' ' || array_to_string(ws, ' ')) AS anchored_hash FROM quiz""")

# ---- profile
ORACLES["null_profile"] = (
    "WITH j AS (SELECT * FROM documents LEFT JOIN labels USING (doc_id))\n"
    + "\nUNION ALL\n".join(
        f"SELECT '{c}' AS \"column\", count({c}) AS filled, count(*) - count({c}) AS missing,\n"
        f"  CASE any_value(typeof({c})) WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' "
        "WHEN 'VARCHAR' THEN 'string' END AS type FROM j"
        for c in ["doc_id", "text", "lang", "source", "n_chars", "quality", "toxic"]))
ORACLES["answer_distribution"] = sql(QUIZ, select="""
SELECT l AS answer, count(answer) AS n FROM (VALUES ('A'), ('B'), ('C'), ('D')) v(l)
LEFT JOIN quiz ON answer = l GROUP BY l""")
LENGTHS = r"""
l AS (SELECT len(list_filter(regexp_split_to_array(text, '[ \n\t\r]+'), lambda w: w <> '')) AS len
      FROM documents)"""
ORACLES["wordcount_hist"] = sql(
    LENGTHS,
    "s AS (SELECT min(len)::DOUBLE AS lo, max(len)::DOUBLE AS hi FROM l)",
    "w AS (SELECT lo, hi, (hi - lo) / 50 AS wd FROM s)",
    """b AS (SELECT CAST(least(floor((len - lo) / CASE WHEN wd > 0 THEN wd ELSE 1 END), 49) AS INTEGER) AS bin
        FROM l, w)""",
    select="""
SELECT CAST(i AS INTEGER) AS bin, round(lo + i * wd, 6) AS lo, round(lo + (i + 1) * wd, 6) AS hi,
  (SELECT count(*) FROM b WHERE bin = i) AS n FROM range(50) r(i), w""")
ORACLES["wordcount_kde"] = sql(
    LENGTHS,
    """m AS (SELECT min(len)::DOUBLE AS lo, max(len)::DOUBLE AS hi, count(*)::DOUBLE AS n,
        stddev_samp(len) * pow(count(*), -0.2) AS h FROM l)""",
    "g AS (SELECT CAST(i AS INTEGER) AS point, lo + (hi - lo) * i / 199 AS x, n, h FROM range(200) r(i), m)",
    select="""
SELECT point, round(any_value(x), 6) AS x,
  round(sum(exp(-0.5 * pow((len - x) / h, 2))) / (any_value(n) * any_value(h) * sqrt(2 * pi())), 9) AS density
FROM g, l GROUP BY point""")
ORACLES["top_keywords"] = sql(
    RANKED,
    f"w AS (SELECT unnest({unigrams('text')}) AS term FROM documents JOIN r USING (doc_id) WHERE rn <= 100)",
    select="SELECT term, count(*) AS n FROM w GROUP BY term ORDER BY n DESC, term LIMIT 100")

# ---- text
ORACLES["sentences"] = f"""
WITH s AS (SELECT doc_id, {sents('text')} AS sl FROM documents)
SELECT doc_id, CAST(unnest(range(len(sl))) AS INTEGER) AS pos, unnest(sl) AS sentence FROM s"""
ORACLES["tokens"] = f"""
SELECT token, count(*) AS n FROM (SELECT unnest({words('lower(text)')}) AS token FROM documents)
GROUP BY token"""
ORACLES["ngrams"] = sql(
    grams("g", "documents", "doc_id", "text"),
    "c AS (SELECT doc_id, term, count(*) AS n FROM g GROUP BY doc_id, term)",
    select="""
SELECT doc_id, count(term) AS n_terms, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_grams, coalesce(max(n), 0) AS max_tf
FROM documents LEFT JOIN c USING (doc_id) GROUP BY doc_id""")

# ---- questions, hints, phrases
TAG = f"CASE WHEN regexp_matches(token, '^\\p{{Lu}}') AND lower(token) NOT IN ({STOP}) THEN 'NNP' ELSE '' END"


def key_chunks(name: str, source: str, keys: str, text: str) -> str:
    """CTE ``name(keys, chunk)`` for the rows whose sentence has a usable chunk."""
    return f"""
{name}_t AS (
  SELECT {keys}, unnest(range(len(t))) AS i, unnest(t) AS token
  FROM (SELECT {keys}, {words(text)} AS t FROM {source})),
{name} AS (
  SELECT {keys}, arg_max(token, (length(token), -i)) AS chunk FROM {name}_t
  WHERE {TAG} = 'NNP' AND length(token) >= 4 AND lower(token) NOT IN ({GENERIC})
    AND token <> lower(token) GROUP BY {keys})"""


def blanked(sentence: str, chunk: str) -> str:
    at = f"instr(lower({sentence}), lower({chunk}))"
    return (f"substr({sentence}, 1, {at} - 1) || '__________' || "
            f"substr({sentence}, {at} + length({chunk}))")


BEST = """
best AS (
  SELECT sm.id, arg_max(sm.pos, (sim, -sm.pos)) AS pos, arg_max(sentence, (sim, -sm.pos)) AS sentence
  FROM sm JOIN sent USING (id, pos) GROUP BY sm.id)"""
CLOZE = ",".join([
    QUIZ, SENT, VOCAB, ANSWER_QUERY, sims("sm", "sent", "aq"), BEST,
    key_chunks("kc", "best", "id", "sentence"),
    f"""
cloze AS (
  SELECT id, pos, sentence,
    CASE WHEN chunk IS NULL THEN sentence || ' __________?' ELSE {blanked('sentence', 'chunk')} END AS stem,
    coalesce(chunk, correct) AS chunk
  FROM best JOIN quiz USING (id) LEFT JOIN kc USING (id))"""])
ORACLES["cloze_question"] = sql(CLOZE, select="SELECT id, pos, stem, chunk FROM cloze")


def hint_ctes(simcte: str, query_cte: str, sent_cte: str = "sent", keys: str = "id") -> str:
    """CTE ``h3(keys, h1, h2, h3)``; queries are in ``query_cte(keys, text)``."""
    on = " AND ".join(f"a.{k.strip()} = b.{k.strip()}" for k in keys.split(","))
    p = ", ".join(f"s.{k.strip()}" for k in keys.split(","))
    return f"""
hq AS (SELECT {keys}, list_distinct({words('lower(text)')}) AS qt FROM {query_cte}),
hs AS (SELECT id, pos, sentence, list_distinct({words('lower(sentence)')}) AS st FROM {sent_cte}),
hn AS (SELECT id, count(*) AS n FROM {sent_cte} GROUP BY id),
ho AS (SELECT {", ".join("q." + k.strip() for k in keys.split(","))}, s.pos, s.sentence,
         len(list_filter(s.st, lambda x: list_contains(q.qt, x))) AS ov
       FROM hq q JOIN hs s ON q.id = s.id),
hr AS (SELECT {p}, s.pos, row_number() OVER (PARTITION BY {p} ORDER BY s.sim DESC, s.pos) AS rn FROM {simcte} s),
h2 AS (SELECT {keys}, arg_max(pos, (ov, -pos)) AS pos FROM ho GROUP BY {keys}),
h12 AS (SELECT a.*, b.pos AS p2 FROM (SELECT {keys}, pos AS p1 FROM hr WHERE rn = 1) a JOIN h2 b ON {on}),
h3p AS (SELECT {", ".join("b." + k.strip() for k in keys.split(","))}, arg_max(a.pos, a.rn) AS p3
        FROM hr a JOIN h12 b ON {on} WHERE a.rn <= 3 AND a.pos NOT IN (b.p1, b.p2)
        GROUP BY {", ".join("b." + k.strip() for k in keys.split(","))}),
h3 AS (
  SELECT {", ".join("q." + k.strip() for k in keys.split(","))},
    CASE WHEN n < 3 THEN coalesce(s0.sentence, '') ELSE s1.sentence END AS h1,
    CASE WHEN n < 3 THEN coalesce(sx.sentence, '') ELSE s2.sentence END AS h2,
    CASE WHEN n < 3 THEN '' ELSE s3.sentence END AS h3
  FROM {query_cte} q JOIN hn ON hn.id = q.id
  JOIN h12 ON {" AND ".join(f"h12.{k.strip()} = q.{k.strip()}" for k in keys.split(","))}
  LEFT JOIN h3p ON {" AND ".join(f"h3p.{k.strip()} = q.{k.strip()}" for k in keys.split(","))}
  LEFT JOIN {sent_cte} s0 ON s0.id = q.id AND s0.pos = 0
  LEFT JOIN {sent_cte} sx ON sx.id = q.id AND sx.pos = 1
  LEFT JOIN {sent_cte} s1 ON s1.id = q.id AND s1.pos = p1
  LEFT JOIN {sent_cte} s2 ON s2.id = q.id AND s2.pos = p2
  LEFT JOIN {sent_cte} s3 ON s3.id = q.id AND s3.pos = p3)"""


QUESTION_QUERY = "gq AS (SELECT id, question AS text FROM quiz)"
ORACLES["hints3"] = sql(
    QUIZ, SENT, VOCAB, QUESTION_QUERY, sims("sm", "sent", "gq"), hint_ctes("sm", "gq"),
    select="SELECT id, h1, h2, h3 FROM h3")
ORACLES["hints_top_n"] = sql(
    QUIZ, SENT, VOCAB, ANSWER_QUERY, sims("sm", "sent", "aq"),
    """rk AS (SELECT id, pos, row_number() OVER (PARTITION BY id ORDER BY sim DESC, pos) AS rn FROM sm)""",
    select="""
SELECT id, CAST(rn - 1 AS INTEGER) AS rank, sentence AS hint FROM rk JOIN sent USING (id, pos) WHERE rn <= 5""")
ORACLES["tagged_tokens"] = f"""
WITH t AS (SELECT doc_id, unnest({words('text')}) AS token FROM documents)
SELECT doc_id, {TAG} AS tag, count(*) AS n, count(DISTINCT token) AS n_distinct FROM t GROUP BY ALL"""


def phrases(name: str, source: str, key: str, text: str) -> str:
    """CTE ``name(key, rank, phrase)``: capitalised runs by gaps and islands."""
    return f"""
{name}_t AS (
  SELECT {key}, i, token, {TAG} AS tag FROM (
    SELECT {key}, unnest(range(len(t))) AS i, unnest(t) AS token
    FROM (SELECT {key}, {words(text)} AS t FROM {source}))),
{name}_g AS (SELECT *, i - row_number() OVER (PARTITION BY {key} ORDER BY i) AS g FROM {name}_t WHERE tag = 'NNP'),
{name}_r AS (SELECT {key}, g, min(i) AS at0, lower(string_agg(token, ' ' ORDER BY i)) AS phrase
             FROM {name}_g GROUP BY {key}, g),
{name} AS (
  SELECT {key}, phrase, row_number() OVER (PARTITION BY {key} ORDER BY min(at0)) - 1 AS rank
  FROM {name}_r WHERE length(phrase) >= 3 GROUP BY {key}, phrase)"""


ORACLES["noun_phrases"] = sql(
    phrases("np", "documents", "doc_id", "text"),
    select="SELECT doc_id, CAST(rank AS INTEGER) AS rank, phrase FROM np")
ORACLES["key_chunk"] = sql(
    f"ds AS (SELECT doc_id, CAST(unnest(range(len(sl))) AS INTEGER) AS pos, unnest(sl) AS sentence FROM (SELECT doc_id, {sents('text')} AS sl FROM documents))",
    key_chunks("kc", "ds", "doc_id, pos", "sentence"),
    select="SELECT ds.doc_id, ds.pos, coalesce(chunk, '') AS chunk FROM ds LEFT JOIN kc USING (doc_id, pos)")


def title(text: str) -> str:
    cut = rf"string_split(regexp_replace(lower({text}), '([^\p{{L}}])', '\1' || chr(1), 'g'), chr(1))"
    return f"array_to_string(list_transform({cut}, lambda p: upper(substr(p, 1, 1)) || substr(p, 2)), '')"


def masked(hint: str, chunk: str) -> str:
    return f"regexp_replace({hint}, '(?i)' || regexp_escape({chunk}), '[answer]', 'g')"


ORACLES["mask_and_blank"] = sql(QUIZ, select=f"""
SELECT id, {blanked('question', 'correct')} AS blanked, {masked('article', 'correct')} AS masked,
  CASE WHEN regexp_matches(question, '^\\p{{Lu}}') THEN {title('correct')} ELSE lower(correct) END AS cased
FROM quiz""")

# ---- wrong options
ORACLES["candidate_features_lexical"] = sql(
    QUIZ, phrases("np", "quiz", "id", "article"),
    select="""
SELECT id, phrase AS cand,
  round(len(list_filter(list_distinct(string_split(phrase, '')), lambda c: contains(correct, c)))
    / greatest(length(phrase), 1), 6) AS char_match,
  CAST((length(lower(article)) - length(replace(lower(article), phrase, ''))) // length(phrase) AS INTEGER) AS freq,
  abs(length(phrase) - length(correct)) AS len_diff
FROM np JOIN quiz USING (id) WHERE phrase <> lower(correct)""")
FIRST3 = """
fc AS (SELECT id, phrase, row_number() OVER (PARTITION BY id ORDER BY rank) AS rn
       FROM np JOIN quiz USING (id) WHERE phrase <> lower(correct)),
f3 AS (SELECT id, list(phrase ORDER BY rn) AS ds FROM fc WHERE rn <= 3 GROUP BY id),
made AS (SELECT id, coalesce(ds, ['option1', 'option2', 'option3']) AS ds FROM quiz LEFT JOIN f3 USING (id))"""
ORACLES["distractors_first_n"] = sql(
    QUIZ, phrases("np", "quiz", "id", "article"), FIRST3,
    select="SELECT id, array_to_string(ds, '|') AS distractors FROM made")

# ---- vectors
ORACLES["mean_vectors"] = """
WITH v AS (SELECT label, CAST(unnest(range(len(embedding))) AS INTEGER) AS dim,
                  unnest(embedding)::DOUBLE AS x FROM embeddings)
SELECT label, dim, round(avg(x), 6) AS value FROM v GROUP BY label, dim"""
ORACLES["embedding_knn"] = """
WITH d AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
s AS (SELECT a.vec_id AS q, b.vec_id AS p, round(list_cosine_similarity(a.v, b.v), 9) AS sim
      FROM d a JOIN d b ON a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY sim DESC, p) AS rank FROM s)
SELECT q, p, round(sim, 6) AS sim, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10"""
ORACLES["embedding_search"] = ORACLES["embedding_knn"].replace(
    "ON a.vec_id <> b.vec_id", "ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0")
ORACLES["embedding_cells_exact"] = ORACLES["embedding_search"]
ORACLES["silhouette_sample"] = """
WITH d AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
           ORDER BY md5('42:' || vec_id), vec_id LIMIT 5000),
n AS (SELECT label, count(*) AS n FROM d GROUP BY label),
s AS (SELECT a.vec_id, a.label, b.label AS o, sum(list_distance(a.v, b.v)) AS d
      FROM d a, d b GROUP BY ALL),
m AS (SELECT vec_id AS id, s.label AS cluster_id,
        max(CASE WHEN s.label = o THEN d / nullif(n - 1, 0) END) AS own,
        min(CASE WHEN s.label <> o THEN d / n END) AS other
      FROM s JOIN n ON n.label = o GROUP BY ALL)
SELECT id, cluster_id, round(own, 6) AS own, round(other, 6) AS other,
  round(CASE WHEN own IS NULL THEN 0 ELSE (other - own) / greatest(own, other) END, 6) AS s FROM m"""

# ---- text metrics
PAIRS = """
pairs AS (
  SELECT h.conv_id || ':' || r.turn AS id, h.text AS hyp_text, r.text AS ref_text
  FROM conversations h JOIN conversations r ON h.conv_id = r.conv_id AND r.turn = h.turn + 1
  WHERE h.role = 'assistant' AND r.role = 'user')"""


def overlap(name: str, source: str, hyp: str, ref: str, max_n: int) -> str:
    """CTE ``name(id, o1, h1, r1, ...)`` from token-list expressions."""
    tokens = f"""
{name}_t AS (SELECT id, {hyp} AS h, {ref} AS r FROM {source})"""
    parts = " UNION ALL ".join(
        f"SELECT id, {n} AS n, '{s}' AS side, unnest(list_transform(range(1, len({s}) - {n} + 2), "
        f"lambda i: array_to_string({s}[i:i + {n - 1}], ' '))) AS gram FROM {name}_t"
        for n in range(1, max_n + 1) for s in "hr")
    sums = ", ".join(
        f"CAST(coalesce(sum({v}) FILTER (n = {n}), 0) AS BIGINT) AS {x}{n}"
        for n in range(1, max_n + 1) for x, v in (("o", "least(c.h, c.r)"), ("h", "c.h"), ("r", "c.r")))
    return f"""{tokens},
{name}_g AS ({parts}),
{name}_c AS (SELECT id, n, gram, count(*) FILTER (side = 'h') AS h, count(*) FILTER (side = 'r') AS r
             FROM {name}_g GROUP BY id, n, gram),
{name} AS (SELECT id, {sums} FROM {name}_t LEFT JOIN {name}_c c USING (id) GROUP BY id)"""


BLEU = """CASE WHEN h1 = 0 OR o1 = 0 THEN 0.0 ELSE
  CASE WHEN h1 > r1 THEN 1.0 ELSE exp(1 - r1 / h1) END * exp((""" + " + ".join(
    f"ln(CASE WHEN o{n} > 0 THEN o{n}::DOUBLE ELSE 0.1 END / greatest(h{n}, 1))" for n in range(1, 5)
) + ") / 4) END"


def rouge(n: int) -> str:
    return f"CASE WHEN o{n} > 0 THEN 2.0 * o{n} / (h{n} + r{n}) ELSE 0.0 END"


WORDS_HR = (words("lower(hyp_text)"), words("lower(ref_text)"))
ASCII_HR = ("regexp_extract_all(lower(hyp_text), '[a-z0-9]+')", "regexp_extract_all(lower(ref_text), '[a-z0-9]+')")


def meteor(name: str, source: str) -> str:
    """CTE ``name(id, matches, chunks, meteor)``, identity alignment."""
    return f"""
{name}_t AS (SELECT id, {WORDS_HR[0]} AS h, {WORDS_HR[1]} AS r FROM {source}),
{name}_f AS (
  SELECT id, 0 AS side, unnest(range(len(h))) AS pos, unnest(h) AS token FROM {name}_t UNION ALL
  SELECT id, 1, unnest(range(len(r))), unnest(r) FROM {name}_t),
{name}_k AS (SELECT *, row_number() OVER (PARTITION BY id, token, side ORDER BY pos DESC) AS k FROM {name}_f),
{name}_m AS (SELECT a.id, a.pos AS h, b.pos AS r FROM {name}_k a JOIN {name}_k b
             ON a.id = b.id AND a.token = b.token AND a.k = b.k AND a.side = 0 AND b.side = 1),
{name}_s AS (SELECT id, CASE WHEN h - lag(h) OVER w = 1 AND r - lag(r) OVER w = 1 THEN 0 ELSE 1 END AS new
             FROM {name}_m WINDOW w AS (PARTITION BY id ORDER BY h)),
{name}_c AS (SELECT id, count(*) AS m, CAST(sum(new) AS BIGINT) AS c FROM {name}_s GROUP BY id),
{name}_p AS (SELECT id, m, c, m::DOUBLE / len(h) AS p, m::DOUBLE / len(r) AS q
             FROM {name}_t LEFT JOIN {name}_c USING (id)),
{name} AS (SELECT id, coalesce(m, 0) AS matches, coalesce(c, 0) AS chunks,
             CASE WHEN m > 0 THEN p * q / (0.9 * p + 0.1 * q) * (1 - 0.5 * pow(c / m, 3)) ELSE 0.0 END AS meteor
           FROM {name}_p)"""


ORACLES["bleu"] = sql(PAIRS, overlap("ov", "pairs", *WORDS_HR, 4), select=f"""
SELECT id, {", ".join(f"{x}{n}" for n in range(1, 5) for x in "ohr")}, round({BLEU}, 6) AS bleu FROM ov""")
ORACLES["rouge_n"] = sql(PAIRS, overlap("ov", "pairs", *ASCII_HR, 2), select=f"""
SELECT id, round({rouge(1)}, 6) AS rouge1, round({rouge(2)}, 6) AS rouge2,
  round(coalesce(o1 / nullif(r1, 0), 0), 6) AS recall1, round(coalesce(o2 / nullif(r2, 0), 0), 6) AS recall2
FROM ov""")
# rows of the table of common subsequences, one hypothesis token at a time
ORACLES["rouge_l"] = sql(
    PAIRS, f"t AS (SELECT id, {ASCII_HR[0]} AS h, {ASCII_HR[1]} AS r FROM pairs)",
    """
l AS (
  SELECT id, h, r, 0 AS i, list_transform(r, lambda x: 0) AS best FROM t
  UNION ALL
  SELECT id, h, r, i + 1, list_transform(range(1, len(r) + 1), lambda j: list_max(list_transform(
    range(1, j + 1), lambda k: CASE WHEN r[k] <> h[i + 1] THEN best[k] WHEN k = 1 THEN 1 ELSE best[k - 1] + 1 END)))
  FROM l WHERE i < len(h))""",
    "c AS (SELECT id, len(h) AS nh, len(r) AS nr, coalesce(best[len(r)], 0) AS n FROM l WHERE i = len(h))",
    select="""
SELECT id, round(coalesce(2 * (n / nullif(nh, 0)) * (n / nullif(nr, 0))
  / nullif(n / nullif(nh, 0) + n / nullif(nr, 0), 0), 0), 6) AS "rougeL" FROM c""",
).replace("WITH", "WITH RECURSIVE", 1)
ORACLES["meteor_exact"] = sql(PAIRS, meteor("mt", "pairs"), select="""
SELECT id, matches, chunks, round(meteor, 6) AS meteor FROM mt""")

# ---- reports
JUDGED = """
j AS (SELECT quality AS actual, CAST(n_chars >= 1000 AS INTEGER) AS predicted
      FROM labels JOIN documents USING (doc_id))"""
ORACLES["confusion"] = sql(JUDGED, select="""
SELECT a AS actual, count(*) FILTER (actual = a AND predicted = 0) AS pred_0,
  count(*) FILTER (actual = a AND predicted = 1) AS pred_1
FROM j, (VALUES (0), (1)) v(a) GROUP BY a""")
ORACLES["classification_report"] = sql(
    JUDGED,
    """c AS (SELECT k, count(*) FILTER (actual = k AND predicted = k) AS tp, count(*) FILTER (predicted = k) AS pp,
         count(*) FILTER (actual = k) AS s, count(*) AS n FROM j, (VALUES (0), (1)) v(k) GROUP BY k)""",
    """m AS (SELECT k, s, n, coalesce(tp / nullif(pp, 0), 0) AS p, coalesce(tp / nullif(s, 0), 0) AS r,
         coalesce(2 * tp / nullif(pp + s, 0), 0) AS f, tp FROM c)""",
    """o AS (SELECT CASE k WHEN 0 THEN 'Incorrect' ELSE 'Correct' END AS name, p, r, f, s FROM m
      UNION ALL SELECT 'accuracy', sum(tp) / max(n), sum(tp) / max(n), sum(tp) / max(n), max(n) FROM m
      UNION ALL SELECT 'macro avg', avg(p), avg(r), avg(f), max(n) FROM m
      UNION ALL SELECT 'weighted avg', sum(p * s) / max(n), sum(r * s) / max(n), sum(f * s) / max(n), max(n) FROM m)""",
    select="""
SELECT name, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, s AS support FROM o""")

# ---- quiz items
def pivots(sent: str) -> str:
    """CTE ``pq(id, pivot_pos, text)``: the pivot sentences of each passage."""
    return f"""
pn AS (SELECT id, count(*) AS n, least(5, greatest(3, count(*) // 3)) AS q FROM {sent} GROUP BY id),
piv AS (SELECT id, i * greatest(1, n // q) AS pivot_pos FROM pn, range(5) r(i)
        WHERE i < q AND i * greatest(1, n // q) < n),
pq AS (SELECT piv.id, pivot_pos, s.sentence AS text FROM piv JOIN {sent} s ON s.id = piv.id AND s.pos = pivot_pos)"""


def pivot_best(sent: str) -> str:
    """CTE ``pb(id, pivot_pos, sentence)``: the sentence closest to each pivot."""
    return f"""
pb AS (SELECT pm.id, pivot_pos, arg_max(sentence, (sim, -pm.pos)) AS sentence
       FROM pm JOIN {sent} USING (id, pos) GROUP BY pm.id, pivot_pos)"""


ITEMS = ",".join([
    QUIZ, SENT, VOCAB,
    pivots("sent"),
    sims("pm", "sent", "pq", "id, pivot_pos"),
    pivot_best("sent"),
    key_chunks("kc", "pb", "id, pivot_pos", "sentence"),
    f"""
it AS (SELECT pb.id, pb.pivot_pos, {blanked('sentence', 'chunk')} AS stem, chunk
       FROM pb JOIN kc USING (id, pivot_pos) JOIN pq USING (id, pivot_pos) WHERE chunk <> pq.text),
sq AS (SELECT id, pivot_pos, stem AS text FROM it)""",
    sims("hm", "sent", "sq", "id, pivot_pos"), hint_ctes("hm", "sq", "sent", "id, pivot_pos"),
    phrases("np", "quiz", "id", "article"),
    f"""
ic AS (SELECT it.id, pivot_pos, phrase, row_number() OVER (PARTITION BY it.id, pivot_pos ORDER BY rank) AS rn
       FROM it JOIN np ON np.id = it.id WHERE phrase <> lower(chunk)),
idl AS (SELECT id, pivot_pos, list(phrase ORDER BY rn) AS ds FROM ic WHERE rn <= 3 GROUP BY id, pivot_pos),
slots AS (
  SELECT it.id, it.pivot_pos, slot, stem, chunk,
    CASE WHEN slot = 0 THEN chunk
         ELSE {title("coalesce(ds, ['option1', 'option2', 'option3'])[slot]")} END AS word
  FROM it LEFT JOIN idl ON idl.id = it.id AND idl.pivot_pos = it.pivot_pos, range(4) r(slot)),
so AS (SELECT *, CASE WHEN word IS NULL THEN '(No distractor available)'
                 ELSE replace(stem, '__________', word) END AS opt,
         row_number() OVER (PARTITION BY id, pivot_pos ORDER BY md5('42:' || id || ':' || pivot_pos || ':' || slot)) - 1 AS at0
       FROM slots),
oi AS (SELECT id, pivot_pos, any_value(stem) AS question_stem, any_value(chunk) AS answer_chunk,
         string_agg(opt, '|' ORDER BY at0) AS options, string_agg(coalesce(word, ''), '|' ORDER BY at0) AS option_words,
         CAST(max(CASE WHEN slot = 0 THEN at0 END) AS INTEGER) AS correct_idx
       FROM so GROUP BY id, pivot_pos),
items AS (
  SELECT oi.*, {masked('h1', 'answer_chunk')} || '|' || {masked('h2', 'answer_chunk')} || '|' ||
    {masked('h3', 'answer_chunk')} AS hints
  FROM oi JOIN h3 ON h3.id = oi.id AND h3.pivot_pos = oi.pivot_pos)"""])
ORACLES["quiz_items"] = sql(ITEMS, select="""
SELECT id, CAST(pivot_pos AS INTEGER) AS pivot_pos, question_stem, answer_chunk, options, option_words,
  correct_idx, hints FROM items""")

# ---- sessions
ANSWERS = """
ans AS (SELECT user_id AS session_id, event_id % 5 AS q_idx,
          CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) % 4 AS INTEGER) AS chosen, ts, event_id FROM events),
first AS (SELECT session_id, q_idx, arg_min(chosen, (ts, event_id)) AS chosen, min(ts) AS ts
          FROM ans GROUP BY session_id, q_idx)"""
SESSION_ITEMS = """
si AS (SELECT id // 5 AS session_id, id % 5 AS q_idx, question, correct, [A, B, C, D] AS opts,
         CAST(id % 4 AS INTEGER) AS correct_idx FROM quiz)"""
ORACLES["first_answers"] = sql(ANSWERS, select="""
SELECT session_id, q_idx, chosen, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts FROM first""")
ORACLES["session_scores"] = sql(QUIZ, ANSWERS, SESSION_ITEMS, select="""
SELECT session_id, count(*) AS total, count(chosen) AS answered,
  count(*) FILTER (chosen = correct_idx) AS correct,
  CAST(100 * count(*) FILTER (chosen = correct_idx) // count(*) AS INTEGER) AS pct,
  count(*) = count(chosen) AS complete
FROM si LEFT JOIN first USING (session_id, q_idx) GROUP BY session_id""")
ORACLES["session_log"] = sql(QUIZ, ANSWERS, SESSION_ITEMS, select="""
SELECT session_id, q_idx, question AS "Question", correct AS "Correct Answer",
  coalesce(opts[chosen + 1], 'N/A') AS "User Choice", coalesce(chosen = correct_idx, false) AS "Is Correct"
FROM si LEFT JOIN first USING (session_id, q_idx)""")

# ---- evaluations over the val rows
EVALUATED = ",".join([
    CLOZE,
    """
sp AS (SELECT id, row_number() OVER (ORDER BY md5('42:' || id), id) AS rn, count(*) OVER () AS n FROM quiz),
val AS (SELECT id FROM sp WHERE rn > n - (n + 4) // 5 AND rn <= n - ((n + 4) // 5 + 1) // 2),
ep AS (SELECT id, stem AS hyp_text, question AS ref_text FROM cloze JOIN quiz USING (id) JOIN val USING (id))""",
    phrases("np", "quiz", "id", "article"), FIRST3,
    """
op AS (SELECT id, question || ' ' || array_to_string(ds, ' ') AS hyp_text,
         question || ' ' || array_to_string(ws, ' ') AS ref_text
       FROM made JOIN quiz USING (id) JOIN val USING (id))""",
    *[x for p in ("ep", "op") for x in (
        overlap(p + "w", p, *WORDS_HR, 4), overlap(p + "r", p, *ASCII_HR, 2), meteor(p + "m", p))],
    """
scores AS (""" + " UNION ALL ".join(
        f"SELECT '{name}' AS pipeline, '{metric}' AS metric, coalesce(avg({value}), 0) AS value FROM {p}{cte}"
        for p, name in (("ep", "extraction"), ("op", "options"))
        for metric, value, cte in (("BLEU", BLEU, "w"), ("ROUGE-1", rouge(1), "r"), ("ROUGE-2", rouge(2), "r"),
                                   ("METEOR", "meteor", "m"))) + ")"])
ORACLES["evaluation_plain"] = sql(
    EVALUATED, select="SELECT pipeline, metric, round(value, 6) AS value FROM scores")
ORACLES["metric_report"] = sql(EVALUATED, select="""
SELECT metric, printf('%.2f%%', 100 * max(value) FILTER (pipeline = 'extraction')) AS extraction,
  printf('%.2f%%', 100 * max(value) FILTER (pipeline = 'options')) AS options
FROM scores GROUP BY metric ORDER BY metric""")

# ---- votes and ranks from stored probabilities
K = "CAST(json_extract_string(props, '$.k') AS INTEGER)"
ORACLES["ranked_top_n"] = f"""
WITH s AS (SELECT user_id, event_type || '-' || event_id AS cand, {K} / 99 AS prob FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY prob DESC, cand DESC) AS rank FROM s)
SELECT user_id, cand, round(prob, 6) AS prob, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3"""
ORACLES["soft_vote"] = f"""
WITH p AS (SELECT event_id, (event_id % 100 / 99 + {K} / 99) / 2 AS m FROM events)
SELECT event_id, CAST(m > 1 - m AS INTEGER) AS predicted, round(m, 6) AS probability FROM p"""

# ---- streams, as the batch result over the whole table
ORACLES["answers_stream"] = ORACLES["first_answers"]
ORACLES["items_stream"] = ORACLES["quiz_items"]
ORACLES["passage_status"] = sql(
    QUIZ, VOCAB,
    f"""
ds AS (SELECT doc_id AS id, unnest(range(len(sl))) AS pos, unnest(sl) AS sentence
       FROM (SELECT doc_id, {sents('text')} AS sl FROM documents))""",
    pivots("ds"), sims("pm", "ds", "pq", "id, pivot_pos"), pivot_best("ds"),
    key_chunks("kc", "pb", "id, pivot_pos", "sentence"),
    """
it AS (SELECT id, count(*) AS items FROM kc JOIN pq USING (id, pivot_pos) WHERE chunk <> text GROUP BY id)""",
    select=r"""
SELECT doc_id AS id, CASE WHEN NOT regexp_matches(text, '[^ \n\t\r]') THEN 'blank'
  WHEN items IS NULL THEN 'insufficient' ELSE 'ok' END AS status, coalesce(items, 0) AS items
FROM documents LEFT JOIN it ON it.id = doc_id""")
ORACLES["windowed_accuracy"] = f"""
WITH w AS (SELECT date_trunc('day', ts) AS s, count(*) AS answers,
             count(*) FILTER ({K} % 4 = user_id % 4) AS correct FROM events GROUP BY 1)
SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS start, strftime(s + INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S') AS "end",
  answers, correct
FROM w WHERE s + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)"""
ORACLES["score_formats"] = f"""
SELECT event_id, round({K} / 99 * 100, 1) AS pct, printf('%.2f%%', {K} / 99 * 100) AS pct_text,
  printf('%.4f', {K} / 99) AS score_text FROM events"""
ORACLES["answers_resets_stream"] = sql(ANSWERS, """
e AS (SELECT *, count(*) FILTER (event_id % 50 = 0) OVER (
        PARTITION BY session_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS epoch FROM ans)""", select="""
SELECT session_id, q_idx, CAST(epoch AS INTEGER) AS epoch, arg_min(chosen, (ts, event_id)) AS chosen,
  arg_min(event_id, (ts, event_id)) AS event_id
FROM e WHERE event_id % 50 <> 0 GROUP BY session_id, q_idx, epoch""")
ORACLES["windowed_sliding"] = f"""
WITH b AS (SELECT date_trunc('day', ts) + INTERVAL 12 HOUR * (date_part('hour', ts)::INTEGER // 12) AS s, ts, user_id,
             {K} AS k FROM events),
w AS (SELECT s - INTERVAL 12 HOUR * i AS s, count(*) AS answers, count(*) FILTER (k % 4 = user_id % 4) AS correct
      FROM b, (VALUES (0), (1)) v(i) GROUP BY 1)
SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS start, strftime(s + INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S') AS "end",
  answers, correct
FROM w WHERE s + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)"""
ORACLES["windowed_sessions"] = f"""
WITH a AS (SELECT user_id AS session_id, ts, {K} AS k, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events),
g AS (SELECT *, count(*) FILTER (p IS NULL OR ts >= p + INTERVAL 6 HOUR) OVER (
        PARTITION BY session_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM a),
w AS (SELECT session_id, min(ts) AS s, max(ts) + INTERVAL 6 HOUR AS e, count(*) AS answers,
        count(*) FILTER (k % 4 = session_id % 4) AS correct FROM g GROUP BY session_id, n)
SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS start, strftime(e, '%Y-%m-%d %H:%M:%S') AS "end", session_id, answers, correct
FROM w WHERE e <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)"""

# word windows: pairs at most five places apart, of words that stand twice or more
WINDOWS = f"""
t AS (SELECT doc_id, {words("lower(coalesce(text, ''))")} AS ws FROM documents),
v AS (SELECT w FROM (SELECT unnest(ws) AS w FROM t) GROUP BY w HAVING count(*) >= 2),
o AS (SELECT ws, d FROM t, (SELECT unnest(range(1, 6)) AS d) WHERE len(ws) > d),
x AS (SELECT unnest(ws[1:len(ws) - d]) AS p, unnest(ws[d + 1:]) AS q FROM o),
ab AS (SELECT least(p, q) AS a, greatest(p, q) AS b, count(*) AS n FROM x GROUP BY ALL),
pairs AS (SELECT a, b, n FROM ab WHERE a IN (SELECT w FROM v) AND b IN (SELECT w FROM v))"""
ORACLES["cooccurrence_counts"] = f"WITH {WINDOWS} SELECT a, b, n FROM pairs"
ORACLES["word_pmi"] = f"""WITH {WINDOWS},
wc AS (SELECT a AS word, b AS context, n FROM pairs WHERE a <> b UNION ALL SELECT b, a, n FROM pairs WHERE a <> b
       UNION ALL SELECT a, b, 2 * n FROM pairs WHERE a = b),
m AS (SELECT word, sum(n) AS m FROM wc GROUP BY word),
s AS (SELECT wc.*, ln(n::DOUBLE * (SELECT sum(m) FROM m)::DOUBLE / (x.m::DOUBLE * y.m::DOUBLE)) - ln(5.0::DOUBLE) AS pmi
      FROM wc JOIN m x ON x.word = wc.word JOIN m y ON y.word = wc.context)
SELECT word, context, n, round(pmi, 6) AS pmi FROM s WHERE pmi > 0"""
NOUNS = f"""
lex AS (SELECT DISTINCT w FROM (SELECT unnest({unigrams("coalesce(text, '')")}) AS w FROM benchmark) WHERE length(w) >= 4),
d AS (SELECT doc_id, {words("coalesce(text, '')")} AS ws FROM documents),
tok AS (SELECT doc_id, unnest(ws) AS token, unnest(range(0, len(ws))) AS pos FROM d),
tag AS (SELECT doc_id, pos, token,
          CASE WHEN regexp_matches(token, '^\\p{{Lu}}') AND lower(token) NOT IN ({STOP}) THEN 'NNP'
               WHEN lower(token) IN (SELECT w FROM lex) THEN 'NN' END AS tag FROM tok),
isl AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id, tag ORDER BY pos) AS island FROM tag WHERE tag IS NOT NULL),
runs AS (SELECT doc_id, tag, min(pos)::INTEGER AS pos, lower(string_agg(token, ' ' ORDER BY pos)) AS phrase
         FROM isl GROUP BY doc_id, tag, island)"""
ORACLES["lexicon_phrases"] = f"WITH {NOUNS} SELECT doc_id, pos, phrase FROM runs WHERE tag = 'NN'"
ORACLES["lexicon_candidates"] = f"""WITH {NOUNS},
f AS (SELECT doc_id, phrase, min(pos) AS pos FROM runs WHERE length(phrase) >= 3 GROUP BY doc_id, phrase),
c AS (SELECT doc_id, count(*) AS n, string_agg(phrase, '|' ORDER BY pos) AS candidates FROM f GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0)::INTEGER AS n, coalesce(candidates, '') AS candidates FROM documents LEFT JOIN c USING (doc_id)"""
ORACLES["items_latency"] = f"WITH {QUIZ} SELECT 0::BIGINT AS batch, count(*) AS rows, true AS timed FROM quiz"
ORACLES["csv_split"] = f"WITH {QUIZ} SELECT md5(article) AS article, question, A, B, C, D, answer FROM quiz"


# ---- models as tables
def digest(text: str, salt: str) -> str:
    return f"('0x' || substr(md5('{salt}' || {text}), 1, 4))::BIGINT"


OPTION_VOTES = ",".join([
    QUIZ, VOCAB,
    f"""
opt AS (SELECT id, o.opt AS opt, question || ' ' || o.option AS text, (o.opt = answer)::INTEGER AS label
        FROM (SELECT *, unnest([{", ".join(f"{{'opt': '{c}', 'option': {c}}}" for c in LETTERS)}]) AS o FROM quiz))""",
    grams("og", "opt", "id, opt", "text"), weights("ow", "og", "id, opt"),
    "onorm AS (SELECT id, opt, sqrt(sum(w * w)) AS n FROM ow GROUP BY id, opt)",
    "os AS (SELECT id, opt, " + ", ".join(
        f"sum(w / n * ((({digest('term', f'v{k}:')}) % 2001 - 1000) / 250.0::DOUBLE)) AS s{k}" for k in (0, 1))
    + " FROM ow JOIN onorm USING (id, opt) GROUP BY id, opt)",
    """
op AS (SELECT opt.id, opt.opt, label, 1 / (1 + exp(-(coalesce(s0, 0) - 0.5::DOUBLE))) AS p0,
         1 / (1 + exp(-(coalesce(s1, 0) + 0.25::DOUBLE))) AS p1 FROM opt LEFT JOIN os USING (id, opt)),
ov AS (SELECT *, (p0 + p1) / 2 AS m, CAST((p0 + p1) / 2 > 1 - (p0 + p1) / 2 AS INTEGER) AS predicted FROM op)""",
])
ORACLES["verifier_table_scores"] = f"""WITH {OPTION_VOTES}
SELECT id, opt, label, predicted, round(m, 6) AS probability, round(p0, 6) AS p0, round(p1, 6) AS p1 FROM ov"""
_report = ORACLES["classification_report"]
ORACLES["verifier_table_report"] = (
    f"WITH {OPTION_VOTES}, j AS (SELECT label AS actual, predicted FROM ov), "
    + _report[_report.index("c AS (SELECT k,"):])
ORACLES["kmeans_table"] = f"""WITH {QUIZ}, {VOCAB},
ct AS (SELECT id, question || ' ' || correct AS text FROM quiz),
{grams("kg", "ct", "id", "text")}, {weights("kw", "kg", "id")},
kn AS (SELECT id, sqrt(sum(w * w)) AS n FROM kw GROUP BY id),
cen AS (SELECT place % 10 AS cluster_id, term, 0.1::DOUBLE + place / 1000.0::DOUBLE AS value FROM (
          SELECT term, row_number() OVER (ORDER BY cf DESC, term)::INTEGER AS place FROM vocab ORDER BY place LIMIT 200)),
len AS (SELECT cluster_id, sum(value * value) AS c2 FROM cen GROUP BY cluster_id),
dot AS (SELECT id, cluster_id, sum(w / n * value) AS dot FROM kw JOIN kn USING (id) JOIN cen USING (term) GROUP BY id, cluster_id),
dist AS (SELECT ct.id, len.cluster_id, c2 - 2 * coalesce(dot, 0) AS d
         FROM ct CROSS JOIN len LEFT JOIN dot ON dot.id = ct.id AND dot.cluster_id = len.cluster_id),
near AS (SELECT id, arg_min(cluster_id, (d, cluster_id)) AS cluster_id, min(d) AS d FROM dist GROUP BY id)
SELECT cluster_id, count(*) AS n, round(sum(greatest(0, d + CASE WHEN kn.id IS NULL THEN 0 ELSE 1 END)), 6) AS inertia
FROM near LEFT JOIN kn USING (id) GROUP BY cluster_id"""
RULED = ",".join([
    QUIZ, phrases("np", "quiz", "id", "article"),
    f"""
rv AS (SELECT w, list_transform(range(1, 9), lambda k: ('0x' || substr(md5(w), k, 1))::INTEGER - 7.5::DOUBLE) AS v
       FROM (SELECT unnest({words("lower(coalesce(text, ''))")}) AS w FROM documents) GROUP BY w HAVING count(*) >= 2),
pr AS (SELECT id, correct, phrase AS cand, article FROM np JOIN quiz USING (id) WHERE phrase <> lower(correct)),
ph AS (SELECT cand AS p FROM pr UNION SELECT correct FROM pr),
pt AS (SELECT p, unnest({words("lower(p)")}) AS w FROM ph),
pm AS (SELECT p, k, avg(v[k]) AS x FROM (SELECT p, v, unnest(range(1, 9)) AS k FROM pt JOIN rv USING (w)) GROUP BY p, k),
pn AS (SELECT p, nullif(sqrt(sum(x * x)), 0) AS n FROM pm GROUP BY p),
sm AS (SELECT a.p AS cand, b.p AS correct, sum(a.x * b.x) / any_value(an.n * bn.n) AS sim
       FROM (SELECT DISTINCT cand, correct FROM pr) d JOIN pm a ON a.p = d.cand JOIN pm b ON b.p = d.correct AND a.k = b.k
       JOIN pn an ON an.p = a.p JOIN pn bn ON bn.p = b.p GROUP BY a.p, b.p),
fe AS (SELECT id, cand, coalesce(sim, 0) AS sim,
         len(list_filter(list_distinct(string_split(cand, '')), lambda c: contains(correct, c))) / greatest(length(cand), 1) AS char_match,
         (length(lower(article)) - length(replace(lower(article), cand, ''))) // length(cand) AS freq,
         abs(length(cand) - length(correct)) AS len_diff
       FROM pr LEFT JOIN sm USING (cand, correct))"""])
ORACLES["candidate_similarity"] = f"WITH {RULED} SELECT id, cand, round(sim, 6) AS sim FROM fe"
ORACLES["ranked_table"] = f"""WITH {RULED},
pb AS (SELECT id, cand, round(round(1 / (1 + exp(-(-0.3::DOUBLE + sim * 1.7::DOUBLE + char_match * 0.9::DOUBLE + freq * 0.05::DOUBLE
         - len_diff * 0.11::DOUBLE))), 12), 9) AS prob FROM fe),
rk AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY prob DESC, cand DESC) AS rank FROM pb)
SELECT id, cand, round(prob, 6) AS prob, rank::INTEGER AS rank FROM rk WHERE rank <= 3"""
ORACLES["silhouette_full"] = """
WITH d AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
mo AS (SELECT label AS o, k, avg(x) AS m FROM (SELECT label, unnest(range(1, 65)) AS k, unnest(v) AS x FROM d) GROUP BY label, k),
ce AS (SELECT o, list(m ORDER BY k) AS m FROM mo GROUP BY o),
sq AS (SELECT label AS o, count(*) AS n, avg(list_dot_product(v, v)) AS q FROM d GROUP BY label),
s AS (SELECT vec_id, label, o, n, greatest(0, list_dot_product(v, v) + q - 2 * list_dot_product(v, m)) AS d FROM d, ce JOIN sq USING (o)),
g AS (SELECT vec_id AS id, label AS cluster_id, max(CASE WHEN label = o THEN d * n / (n - 1) END) AS own,
        min(CASE WHEN label <> o THEN d END) AS other FROM s GROUP BY ALL)
SELECT id, cluster_id, round(own, 6) AS own, round(other, 6) AS other, round((other - own) / greatest(own, other), 6) AS s FROM g"""

# ---- rules that bite: a small cap, blank rows, a sample below the table
ORACLES["tfidf_vocab_capped"] = sql(
    QUIZ, VOCAB.replace("LIMIT 50000", "LIMIT 300"), select="SELECT term, df, cf, round(idf, 6) AS idf FROM vocab")
ORACLES["silhouette_of_some"] = ORACLES["silhouette_sample"].replace("LIMIT 5000", "LIMIT 200")
ORACLES["blank_rows"] = f"""WITH {QUIZ},
r AS (SELECT id, CASE WHEN id % 7 = 0 THEN NULL ELSE article END AS article, CASE WHEN id % 5 = 0 THEN NULL ELSE question END AS question,
        CASE WHEN answer = 'A' AND id % 3 = 0 THEN NULL ELSE correct END AS correct FROM quiz)
SELECT id, 'question' AS kept FROM r WHERE article IS NOT NULL AND question IS NOT NULL
UNION ALL SELECT id, 'answer' FROM r WHERE article IS NOT NULL AND correct IS NOT NULL"""
