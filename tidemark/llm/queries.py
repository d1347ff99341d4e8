"""The operators over the whole driver tables with production parameters, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, decontaminate, embeddings, licenses, lines, lm, mixing, pii, quality, simhash, token_files, toxicity, trie


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm.score_lm(_table(spark, sf_dir, "documents"))
    return scored.select("doc_id", "n_words", F.round("log_score", 3).alias("log_score"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digest(_table(spark, sf_dir, "documents"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents")).drop("matches")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_embedding_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.embedding_groups(_table(spark, sf_dir, "embeddings"))


def op6_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(_table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_counts(_table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).withColumn("target", F.round("target", 4))


def op10_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(trie.grafted(_table(spark, sf_dir, "conversations")))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align_tokenizers(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_lm_scores, op2_pii, op3_licenses, op4_toxicity, op5_embedding_groups, op6_simhash_groups, op7_token_counts, op8_quality, op9_mixture, op10_contamination, op11_line_dedup, op12_conversation_trie, op13_token_alignment)}

ORACLE_SQL: dict[str, str] = {}

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_WORDS = f"regexp_extract_all({_LOW}, {_WORD})"

ORACLE_SQL["op1_lm_scores"] = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
t AS (SELECT doc_id, len(w) AS size, unnest(generate_series(1, len(w))) AS i, unnest(w) AS c FROM d),
p AS (SELECT *, lag(c) OVER s AS b, lag(c, 2) OVER s AS a FROM t WINDOW s AS (PARTITION BY doc_id ORDER BY i)),
n AS (SELECT *, count(*) OVER () - size AS rest, count(*) OVER (PARTITION BY c) - count(*) OVER (PARTITION BY doc_id, c) AS n1,
  CASE WHEN i > 1 THEN count(*) OVER (PARTITION BY b, c) - count(*) OVER (PARTITION BY doc_id, b, c) ELSE 0 END AS n2,
  CASE WHEN i > 2 THEN count(*) OVER (PARTITION BY a, b, c) - count(*) OVER (PARTITION BY doc_id, a, b, c) ELSE 0 END AS n3 FROM p),
q AS (SELECT *, lag(n1) OVER s AS before1, lag(n2) OVER s AS before2 FROM n WINDOW s AS (PARTITION BY doc_id ORDER BY i)),
s AS (SELECT doc_id, CASE WHEN n3 > 0 THEN ln(n3 / before2) WHEN n2 > 0 THEN least(i - 2, 1) * ln(0.4) + ln(n2 / before1)
  ELSE least(i - 1, 2) * ln(0.4) + ln(CASE WHEN n1 > 0 THEN n1 ELSE 0.4 END / greatest(rest, 1)) END AS ls FROM q)
SELECT d.doc_id, any_value(len(w)) AS n_words, round(coalesce(sum(ls), 0), 3) AS log_score FROM d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id
"""


def _places(phrase: str) -> str:
    """Starts, from 0, at which the words of a phrase stand in the list w."""
    same = " AND ".join(f"w[i + {k}] = '{x}'" if k else f"w[i] = '{x}'" for k, x in enumerate(phrase.split()))
    return f"list_transform(list_filter(generate_series(1, len(w)), lambda i: {same}), lambda i: {{'pos': i - 1, 'label': '{licenses.PHRASES[phrase]}'}})"


_NOTICES = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in licenses.TEMPLATES.items())
ORACLE_SQL["op3_licenses"] = f"""
WITH d AS (SELECT doc_id, {_LOW} AS low, {_WORDS} AS w FROM documents),
b AS (SELECT doc_id, low, len(w) AS n_words, list_concat({', '.join(map(_places, licenses.PHRASES))}) AS hits FROM d),
t AS (SELECT label, list_distinct(w) AS t, greatest(8, power(2, ceil(log2(len(w)))))::BIGINT AS s FROM (SELECT label, regexp_extract_all(lower(notice), {_WORD}) AS w FROM (VALUES {_NOTICES}) AS x(label, notice))),
c AS (SELECT *, CASE WHEN len(t) < 16 THEN len(t) ELSE ceil(0.8 * len(t) - 1e-9) END AS need FROM t),
l AS (SELECT doc_id, s, list_slice(w, k * s + 1, k * s + 2 * s) AS block FROM (SELECT doc_id, w, s, unnest(generate_series(0, greatest(0, ceil(len(w) / s)::BIGINT - 2))) AS k FROM d, (SELECT DISTINCT s FROM t))),
m AS (SELECT doc_id, label, len(list_intersect(t, block)) / len(t) AS containment FROM l JOIN c USING (s) WHERE len(list_intersect(t, block)) >= need),
k AS (SELECT doc_id, list(DISTINCT label) AS own, max(containment) AS best FROM m GROUP BY ALL)
SELECT b.doc_id, n_words, len(hits) AS n_base, list_min(list_transform(hits, lambda x: x.pos)) AS first_word, list_max(list_transform(hits, lambda x: x.pos)) AS last_word,
coalesce(array_to_string(list_sort(list_distinct(list_transform(hits, lambda x: x.label))), ','), '') AS base_labels,
coalesce(array_to_string(list_sort(list_distinct(list_concat(list_transform(hits, lambda x: x.label), coalesce(own, [])))), ','), '') AS labels,
CASE WHEN len(hits) > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0)::DOUBLE END AS score FROM b LEFT JOIN k USING (doc_id)
"""

ORACLE_SQL["op9_mixture"] = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, ('0x' || substr(md5('17:' || doc_id || ':' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, ((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::DOUBLE AS weight FROM d GROUP BY source),
r AS (SELECT *, ((SELECT sum(source_size) FROM s) - coalesce(sum(source_size * 3.0) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate FROM s WINDOW o AS (ORDER BY source_size / weight, source IS NULL, source)),
f AS (SELECT *, first_value(CASE WHEN source_size * 3.0 > rate * weight THEN rate END IGNORE NULLS) OVER (ORDER BY source_size / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS final FROM r),
t AS (SELECT source, source_size, coalesce(least(source_size * 3.0, final * weight), source_size * 3.0)::DOUBLE AS target FROM f),
m AS (SELECT d.*, source_size, target, floor(target + 1e-6)::BIGINT AS words, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, source, size, source_size, round(target, 4) AS target, (CASE WHEN source_size > 0 THEN words // source_size ELSE 0 END * size + greatest(0, least(size, CASE WHEN source_size > 0 THEN words % source_size ELSE 0 END - before)))::BIGINT AS taken FROM m
"""

ORACLE_SQL["op10_contamination"] = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(list_slice(w, i, i + 9), ' ') AS g FROM (SELECT *, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, i, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS g FROM (SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM d, (SELECT DISTINCT k FROM bw) WHERE len(w) >= k)),
h AS (SELECT doc_id, item_id, i, k FROM dw JOIN bw USING (k, g)),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + k - 1)) AS p FROM h) GROUP BY ALL),
m AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT item_id::VARCHAR)), ',') AS ids FROM h GROUP BY ALL)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""

_KINDS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
_FOUND = " UNION ALL ".join(f"SELECT doc_id, text, '{k}' AS kind, {r} AS rank, regexp_extract_all(text, '{p}') AS vals, string_split_regex(text, '{p}') AS gaps FROM d" for r, (k, p) in enumerate(_KINDS.items()))
_PLACED = "list_transform(generate_series(1, len(vals)), lambda i: {'s': list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(vals[1:i - 1], lambda x: length(x))), 0), 'v': vals[i]})"

ORACLE_SQL["op2_pii"] = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
f AS (SELECT doc_id, text, kind, rank, unnest({_PLACED}) AS p FROM ({_FOUND}) WHERE len(vals) > 0),
g AS (SELECT doc_id, text, kind, rank, p.s::BIGINT AS s, (p.s + length(p.v))::BIGINT AS e, p.v AS v, regexp_replace(p.v, '[^0-9]', '', 'g') AS digits FROM f),
b AS (SELECT * EXCLUDE (digits) FROM g WHERE CASE kind WHEN 'ip' THEN list_max(list_transform(string_split(v, '.'), lambda x: CAST(x AS DOUBLE))) <= 255 WHEN 'phone' THEN length(digits) BETWEEN 10 AND 15
  WHEN 'card' THEN length(digits) BETWEEN 14 AND 19 AND list_sum(list_transform(generate_series(1, length(digits)), lambda i: CASE WHEN i % 2 = 1 THEN CAST(digits[-i] AS INT) ELSE 2 * CAST(digits[-i] AS INT) - CASE WHEN CAST(digits[-i] AS INT) > 4 THEN 9 ELSE 0 END END)) % 10 = 0 ELSE true END),
y AS (SELECT doc_id, s, e, unnest([kind, kind || '/' || CASE kind WHEN 'email' THEN translate(regexp_extract(v, '@(.*)$', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') WHEN 'ip' THEN regexp_extract(v, '^(.*)\.[0-9]+$', 1)
  WHEN 'card' THEN substr(regexp_replace(v, '[^0-9]', '', 'g'), 1, 6) ELSE regexp_extract(regexp_replace(v, '[^0-9]', '', 'g'), '^(.*).{{7}}$', 1) END, kind || ':' || v]) AS entity, substr(text, greatest(s - 40, 0) + 1, least(s, 40)) || '|' || substr(text, e + 1, 40) AS around FROM b),
c AS (SELECT doc_id, entity, arg_min(around, s) AS around FROM y GROUP BY ALL),
m AS (SELECT DISTINCT doc_id, term FROM (SELECT doc_id, unnest(regexp_extract_all({_LOW}, {_WORD})) AS term FROM d) WHERE NOT regexp_full_match(term, '[0-9]+')),
en AS (SELECT entity, count(*) AS n_entity FROM c GROUP BY ALL),
tn AS (SELECT term, count(*) AS n_term FROM m GROUP BY ALL),
x AS (SELECT entity, term, count(*) AS together FROM c JOIN m USING (doc_id) GROUP BY ALL HAVING count(DISTINCT around) >= 2),
a AS (SELECT entity, term, log2((together + n_entity / n) / (n_term + 1) / (n_entity / n)) / CASE WHEN n_entity < n THEN -log2(n_entity / n) END AS disclosed FROM x JOIN en USING (entity) JOIN tn USING (term), (SELECT count(*)::DOUBLE AS n FROM d)),
act AS (SELECT DISTINCT doc_id, term FROM c JOIN m USING (doc_id) JOIN a USING (entity, term) WHERE disclosed >= 0.7),
w AS (SELECT doc_id, unnest({_PLACED}) AS p FROM (SELECT doc_id, regexp_extract_all({_LOW}, {_WORD}) AS vals, string_split_regex({_LOW}, {_WORD}) AS gaps FROM d SEMI JOIN act USING (doc_id)) WHERE len(vals) > 0),
t AS (SELECT w.doc_id, p.s::BIGINT AS s, (p.s + length(p.v))::BIGINT AS e FROM w JOIN act ON w.doc_id = act.doc_id AND act.term = p.v),
k AS (SELECT t.* FROM t ANTI JOIN b ON b.doc_id = t.doc_id AND b.s < t.e AND t.s < b.e),
l AS (SELECT doc_id, kind, rank, s, e FROM b UNION ALL SELECT doc_id, 'term', 4, s, e FROM k),
r AS (SELECT doc_id, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone, count(*) FILTER (kind = 'term') AS n_terms,
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (kind <> 'term') AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS spans FROM l GROUP BY ALL)
SELECT d.doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_terms, 0) AS n_terms FROM d LEFT JOIN r USING (doc_id)
"""

ORACLE_SQL["op5_embedding_groups"] = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(embedding, lambda e: e <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= 0.95),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY ALL),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY ALL)
SELECT e.vec_id, coalesce(n_links, 0) AS n_links, component_id, e.vec_id = component_id AS kept FROM embeddings e LEFT JOIN n USING (vec_id) LEFT JOIN c USING (vec_id)
"""

ORACLE_SQL["op11_line_dedup"] = rf"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
x AS (SELECT doc_id, unnest(generate_series(1, len(l))) AS pos, unnest(l) AS line FROM d),
k AS (SELECT *, {_LOW.replace("coalesce(text, '')", "regexp_replace(line, '^[ \x09-\x0D]+|[ \x09-\x0D]+$', '', 'g')")} AS key FROM x),
m AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
f AS (SELECT doc_id, pos, line, keeper IS NOT NULL AND doc_id <> keeper AS gone FROM k LEFT JOIN m USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM f GROUP BY doc_id
"""

_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ord(x)::BIGINT)), lambda a, b: list_reduce(list_prepend(xor(a, b), list_transform(range(8), lambda i: i)), lambda y, z: xor(y >> 1, (y & 1) * 3988292384))), 4294967295)"
ORACLE_SQL["op12_conversation_trie"] = f"""
WITH i AS (SELECT c, c - c % 5 AS base, {_CRC} % 9 AS h FROM (SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id IS NOT NULL)),
o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS rn, {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS m FROM conversations),
r AS (SELECT c, rn, m FROM i JOIN o ON o.conv_id = c AND rn > h UNION ALL SELECT c, rn, m FROM i JOIN o ON o.conv_id = base AND rn <= h),
s AS (SELECT c, coalesce(list(m ORDER BY rn) FILTER (m IS NOT NULL), []) AS t FROM i LEFT JOIN r USING (c) GROUP BY c),
p AS (SELECT c, d, len(t) AS n, md5(to_json(list_slice(t, 1, d))::VARCHAR) AS k, CASE WHEN d > 0 THEN md5(to_json(list_slice(t, 1, d - 1))::VARCHAR) END AS up, CASE WHEN d > 0 THEN strlen(t[d].text) ELSE 0 END AS size FROM (SELECT c, t, unnest(generate_series(0, len(t))) AS d FROM s)),
g AS (SELECT k, d, any_value(up) AS up, min(c) AS conv_id, count(*) AS n_convs, any_value(size) AS size, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (n = d), '')) AS ends FROM p GROUP BY k, d),
f AS (SELECT g.*, coalesce(n_children, 0) AS n_children FROM g LEFT JOIN (SELECT up AS k, count(*) AS n_children FROM g WHERE d > 0 GROUP BY up) USING (k)),
a AS (SELECT top.k, sum((f.n_children = 0)::INT) AS n_leaves, sum((f.n_convs - 1) * f.size) AS saved FROM f JOIN p own ON own.c = f.conv_id AND own.d <= f.d JOIN f top ON top.k = own.k AND top.d = own.d GROUP BY top.k)
SELECT f.conv_id, f.d AS depth, parent.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, f.ends AS ends_sha256 FROM f JOIN a USING (k) LEFT JOIN f parent ON parent.k = f.up AND parent.d = f.d - 1
"""
