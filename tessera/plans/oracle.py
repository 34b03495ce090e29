"""The engine's queries as SQL for DuckDB, written independently of the Spark code."""

from __future__ import annotations

from ..operators.answer import PROMPT
from . import literals as L

SQL: dict[str, str] = {}

TOKEN = "[a-z0-9]+(?:[-_/][a-z0-9]+)*"


def _tok(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '{TOKEN}')"


def _plain(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[a-z0-9]+')"


_BM25 = f"""
dt AS (SELECT doc_id AS chunk_id, {_tok("coalesce(text, '')")} AS toks FROM documents),
st AS (SELECT count(*) AS n, sum(len(toks)) / count(*) AS avgdl FROM dt),
dx AS (SELECT chunk_id, greatest(len(toks), 1) AS dl, unnest(toks) AS term FROM dt),
tf AS (SELECT term, chunk_id, dl, count(*) AS f FROM dx GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
qx AS (SELECT item_id AS query_id, unnest({_tok("text")}) AS term FROM benchmark),
qf AS (SELECT query_id, term, count(*) AS qf FROM qx GROUP BY ALL),
idf AS (SELECT term, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf, avgdl FROM df, st),
sc AS (SELECT query_id, chunk_id,
         round(sum(qf * idf * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * dl / avgdl))), 4) AS score
       FROM qf JOIN tf USING (term) JOIN idf USING (term) GROUP BY ALL),
bm AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
       FROM sc WHERE score > 0)"""

SQL["bm25_topk"] = f"WITH {_BM25} SELECT query_id, chunk_id, score, rank FROM bm WHERE rank <= 10"
SQL["postings_topk"] = SQL["bm25_topk"]
SQL["bm25_with_zeros"] = f"""WITH {_BM25},
al AS (SELECT item_id AS query_id, doc_id AS chunk_id FROM benchmark, documents),
fl AS (SELECT query_id, chunk_id, coalesce(score, 0.0) AS score FROM al LEFT JOIN sc USING (query_id, chunk_id)),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM fl)
SELECT query_id, chunk_id, score, rank FROM rk WHERE rank <= 50"""
SQL["bm25_okapi"] = f"""WITH {_BM25},
oq AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS raw, avgdl FROM df, st WHERE term IN (SELECT term FROM qf)),
om AS (SELECT 0.25 * avg(raw) AS floor FROM oq),
oi AS (SELECT term, CASE WHEN raw < 0 THEN floor ELSE raw END AS idf, avgdl FROM oq, om),
os AS (SELECT query_id, chunk_id, round(sum(qf * idf * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * dl / avgdl))), 4) AS score
       FROM qf JOIN tf USING (term) JOIN oi USING (term) GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM os WHERE score > 0)
SELECT query_id, chunk_id, score, rank FROM rk WHERE rank <= 10"""
SQL["term_stats"] = f"WITH {_BM25} SELECT term, df.df AS df, round(idf, 6) AS idf FROM df JOIN idf USING (term)"
SQL["corpus_stats"] = f"WITH {_BM25} SELECT n, round(avgdl, 6) AS avgdl FROM st"

SQL["dense_topk"] = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
u AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM v),
s AS (SELECT q.vec_id AS query_id, d.vec_id AS chunk_id,
        round(list_dot_product(q.e, d.e) / (CASE WHEN q.n = 0 THEN 1 ELSE q.n END * CASE WHEN d.n = 0 THEN 1 ELSE d.n END), 4) AS score
      FROM u q, u d WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s)
SELECT query_id, chunk_id, score, rank FROM r WHERE rank <= 10"""

SQL["vector_index_exact"] = SQL["dense_topk"]

_WORDS = "".join(
    f", ('0x' || substr(md5(term), {8 * i + 1}, 8))::BIGINT AS w{i}" for i in range(4)
)


def _weights(name: str, source: str, key: str) -> str:
    return f"""
{name}x AS (SELECT {key} AS id, unnest({_tok("coalesce(text, '')")}) AS term FROM {source}),
{name}c AS (SELECT id, term, count(*) AS c FROM {name}x GROUP BY ALL),
{name}h AS (SELECT id, c{_WORDS} FROM {name}c),
{name}b AS (SELECT id, ((((w0 % 384) * 256 + w1) % 384 * 256 + w2) % 384 * 256 + w3) % 384 AS bucket,
              c * (1 + 0.1 * ln(1 + c)) AS w FROM {name}h),
{name}s AS (SELECT id, bucket, sum(w) AS w FROM {name}b GROUP BY ALL),
{name}n AS (SELECT id, sqrt(sum(w * w)) AS norm FROM {name}s GROUP BY id),
{name} AS (SELECT id, bucket, w / norm AS weight FROM {name}s JOIN {name}n USING (id))"""


_HASHED = f"""{_weights("dw", "documents", "doc_id")}, {_weights("qw", "benchmark", "item_id")},
hs AS (SELECT q.id AS query_id, d.id AS chunk_id, round(sum(d.weight * q.weight), 4) AS score
       FROM dw d JOIN qw q USING (bucket) GROUP BY ALL),
hk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM hs)"""
SQL["hash_embed"] = (
    f"WITH {_weights('dw', 'documents', 'doc_id')} SELECT id AS chunk_id, bucket::INT AS bucket, round(weight, 6) AS weight FROM dw"
)
SQL["hashed_topk"] = f"WITH {_HASHED} SELECT query_id, chunk_id, score, rank FROM hk WHERE rank <= 10"


def _fused(dense: str, sparse: str, top: int) -> str:
    return f"""
fu AS (SELECT coalesce(d.query_id, s.query_id) AS query_id, coalesce(d.chunk_id, s.chunk_id) AS chunk_id,
         coalesce(1.0 / (60 + d.rank), 0) + coalesce(1.0 / (60 + s.rank), 0) AS raw,
         coalesce(d.score, 0.0) AS dense_score, coalesce(s.score, 0.0) AS bm25_score, d.rank AS dr, s.rank AS sr
       FROM {dense} d FULL JOIN {sparse} s ON d.query_id = s.query_id AND d.chunk_id = s.chunk_id),
fr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, dr NULLS LAST, sr NULLS LAST, chunk_id) AS rank FROM fu),
hy AS (SELECT query_id, chunk_id, round(raw, 5) AS rrf, dense_score, bm25_score, rank FROM fr WHERE rank <= {top})"""


_HYBRID = f"""{_BM25}, {_HASHED},
d20 AS (SELECT * FROM hk WHERE rank <= 20), s20 AS (SELECT * FROM bm WHERE rank <= 20), {_fused("d20", "s20", 20)}"""
SQL["hybrid_topk"] = f"WITH {_HYBRID} SELECT * FROM hy"
SQL["branch_report"] = f"""WITH {_HYBRID},
a AS (SELECT query_id, count(*) AS dense_n, string_agg(chunk_id::VARCHAR, ',' ORDER BY rank) FILTER (rank <= 3) AS dense_top FROM d20 GROUP BY 1),
b AS (SELECT query_id, count(*) AS sparse_n, string_agg(chunk_id::VARCHAR, ',' ORDER BY rank) FILTER (rank <= 3) AS sparse_top FROM s20 GROUP BY 1)
SELECT query_id, coalesce(dense_n, 0) AS dense_n, dense_top, coalesce(sparse_n, 0) AS sparse_n, sparse_top FROM a FULL JOIN b USING (query_id)"""
SQL["recall_mass"] = f"""WITH {_HYBRID},
m AS (SELECT query_id, sum(rrf) FILTER (rank <= 5) AS mass FROM hy GROUP BY 1)
SELECT item_id AS query_id, round(coalesce(mass, 0), 5) AS mass, (mass IS NULL OR mass < 0.02) AS weak
FROM benchmark LEFT JOIN m ON item_id = query_id"""
_RERANKED = f"""
rs AS (SELECT h.query_id, h.chunk_id, h.rank AS prior,
         list_distinct({_plain("b.text")}) AS q, {_plain("d.text")} AS t,
         regexp_extract_all(upper(b.text), '[A-Z]{{{{2,}}}}-\\d+') AS qc, regexp_extract_all(upper(d.text), '[A-Z]{{{{2,}}}}-\\d+') AS tc
       FROM {{0}} h JOIN benchmark b ON b.item_id = h.query_id JOIN documents d ON d.doc_id = h.chunk_id),
rr AS (SELECT query_id, chunk_id, prior,
         round(len(list_intersect(q, t)) / greatest(len(q), 1) + CASE WHEN list_has_any(qc, tc) THEN 0.5 ELSE 0 END, 4) AS rerank_score FROM rs),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, prior) AS rank FROM rr)"""
_RERANK = f"{_HYBRID}, {_RERANKED.format('hy')}"
SQL["lexical_rerank"] = f"WITH {_RERANK} SELECT query_id, chunk_id, prior, rerank_score, rank FROM rk WHERE rank <= 5"
SQL["rerank_delta"] = f"""WITH {_RERANK}
SELECT query_id, count(*) FILTER (prior > 5) AS rerank_delta FROM rk WHERE rank <= 5 GROUP BY 1"""
SQL["rrf_fuse"] = f"""WITH li AS (SELECT l_orderkey + 10 AS query_id, l_partkey::VARCHAR AS chunk_id, round(max(l_extendedprice), 2) AS p, round(sum(l_quantity)::DOUBLE, 2) AS n FROM lineitem GROUP BY 1, 2),
d AS (SELECT * FROM {L.values(L.DENSE, "query_id, chunk_id, score, rank")} UNION ALL
  SELECT query_id, chunk_id, p, row_number() OVER (PARTITION BY query_id ORDER BY p DESC, chunk_id) AS k FROM li QUALIFY k <= 4),
s AS (SELECT * FROM {L.values(L.SPARSE, "query_id, chunk_id, score, rank")} UNION ALL
  SELECT query_id, chunk_id, n, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, chunk_id) AS k FROM li WHERE n > 20 QUALIFY k <= 4), {_fused("d", "s", 10)} SELECT * FROM hy"""

# -- chunking. RE2 has no lookaround: the sentence end is marked, then split at.

_STRIP = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"


def _sentences(x: str) -> str:
    marked = f"regexp_replace({_STRIP.format(x)}, '([.!?])\\s+([A-Z0-9#|\\-])', '\\1' || chr(1) || '\\2', 'g')"
    return f"list_filter(list_transform(string_split({marked}, chr(1)), lambda s: {_STRIP.format('s')}), lambda s: length(s) > 0)"


SQL["sentence_split"] = f"""
WITH s AS (SELECT doc_id::VARCHAR AS doc_id, {_sentences("text")} AS l, text FROM documents),
n AS (SELECT doc_id, CASE WHEN len(l) = 0 THEN [{_STRIP.format("text")}] ELSE l END AS l FROM s)
SELECT doc_id, (i - 1)::INT AS seq, l[i] AS sentence, greatest(1, length(l[i]) // 4)::INT AS tokens
FROM n, unnest(range(1, len(l) + 1)) AS u(i)"""


def _windows(name: str, source: str, size: int, overlap: int) -> str:
    """CTEs: {name} has id, seq, text, tokens of windows over `source` (id, text)."""
    return f"""
{name}_s AS (SELECT id, {_sentences("replace(text, chr(10) || chr(10), chr(10))")} AS l0, text FROM {source}),
{name}_l AS (SELECT id, CASE WHEN len(l0) = 0 THEN [''] ELSE l0 END AS l FROM {name}_s),
{name}_t AS (SELECT id, l, [0] || list_transform(range(1, len(l) + 1), lambda i:
              list_sum(list_transform(l[1:i], lambda s: greatest(1, length(s) // 4)))) AS p FROM {name}_l),
{name}_w AS (
  SELECT id, l, p, 1 AS a, 0 AS seq,
    greatest(1, len(list_filter(range(1, len(l) + 1), lambda i: p[i + 1] <= {size}))) AS b FROM {name}_t
  UNION ALL
  SELECT id, l, p, na, seq + 1,
    greatest(b + 1, len(list_filter(range(1, len(l) + 1), lambda i: p[i + 1] - p[na] <= {size})))
  FROM (SELECT *, greatest(a, 1 + len(list_filter(range(1, b + 1), lambda j: p[b + 1] - p[j] > {overlap}))) AS na FROM {name}_w WHERE b < len(l))),
{name} AS (SELECT id, seq, array_to_string(l[a:b], ' ') AS text, (p[b + 1] - p[a])::INT AS tokens FROM {name}_w)"""


_SLIDING = f"""WITH RECURSIVE src AS (SELECT doc_id::VARCHAR AS id, coalesce(text, '') AS text FROM documents),
{_windows("w", "src", 220, 30)}"""
SQL["sliding_window"] = f"""{_SLIDING}
SELECT id || '#s' || seq AS chunk_id, id AS doc_id, text, tokens AS token_est, seq::INT AS seq FROM w"""
SQL["chunk_overlap"] = f"""{_SLIDING},
k AS (SELECT id, seq, list_distinct(list_filter(string_split_regex(lower(text), '[\\s\\x0b]+'), lambda x: x <> '')) AS s FROM w),
b AS (SELECT *, lag(s) OVER (PARTITION BY id ORDER BY seq) AS o FROM k)
SELECT id || '#s' || seq AS chunk_id, round(len(list_intersect(s, o)) / greatest(1, least(len(s), len(o))), 6) AS overlap FROM b WHERE o IS NOT NULL"""
_PARENTS = f"""WITH RECURSIVE src AS (SELECT doc_id::VARCHAR AS id, coalesce(text, '') AS text FROM documents),
{_windows("p", "src", 1000, 40)},
cs AS (SELECT {{'d': id, 'p': seq}} AS id, text FROM p),
{_windows("c", "cs", 220, 30)},
n AS (SELECT id.d AS d, id.p AS p, text, tokens, row_number() OVER (PARTITION BY id.d ORDER BY id.p, seq) - 1 AS n FROM c)"""
SQL["parent_child"] = f"""{_PARENTS}
SELECT id || '#p' || seq AS chunk_id, id AS doc_id, text, NULL AS parent_id, tokens AS token_est, seq::INT AS seq, 'parent' AS role FROM p
UNION ALL
SELECT d || '#p' || p || 'c' || n, d, text, d || '#p' || p, tokens, n::INT, 'child' FROM n"""
SQL["searchable_chunks"] = f"{_PARENTS} SELECT d AS doc_id, count(*) AS children FROM n GROUP BY 1"
SQL["table_annotate"] = f"""
WITH d AS {L.values(L.STRUCTURED, "chunk_id, text")}, r AS (SELECT *, len(list_filter(string_split(text, chr(10)), lambda x: x LIKE '|%|' AND length(x) > 1)) AS n FROM d)
SELECT chunk_id, n >= 2 AS has_table, n::INT AS table_rows, regexp_matches(text, 'Figure\\s+F-\\d+|Fig\\.\\s*\\d+') AS has_figure_ref FROM r"""
SQL["leak_watch"] = f"""
SELECT doc_id::VARCHAR AS chunk_id, p AS phrase FROM documents, (SELECT unnest([{", ".join("'" + x.lower() + "'" for x in L.PHRASES)}]) AS p) WHERE contains(lower(text), p)"""
SQL["parent_expand"] = f"""
WITH c AS {L.values(L.FAMILY, "chunk_id, doc_id, text, parent_id")}, h AS {L.values(L.HITS, "query_id, chunk_id, rank")},
j AS (SELECT h.query_id, coalesce(p.chunk_id, h.chunk_id) AS context_id, coalesce(p.doc_id, c.doc_id) AS doc_id, coalesce(p.text, c.text) AS text,
        CASE WHEN p.chunk_id IS NOT NULL THEN h.chunk_id END AS retrieved_via, h.rank AS r
      FROM h LEFT JOIN c ON c.chunk_id = h.chunk_id LEFT JOIN c p ON p.chunk_id = c.parent_id),
f AS (SELECT *, row_number() OVER (PARTITION BY query_id, context_id ORDER BY r) AS n FROM j),
g AS (SELECT query_id, context_id, doc_id, text, retrieved_via, row_number() OVER (PARTITION BY query_id ORDER BY r) AS rank FROM f WHERE n = 1)
SELECT * FROM g WHERE rank <= 3"""

# -- guards ------------------------------------------------------------------------

_MAIL, _TEL, _NAT = (
    "[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\\.[a-zA-Z0-9-.]+",
    "\\+\\d[\\d\\s\\-()]{7,}\\d",
    "(?:\\(\\d{3}\\)\\s*|\\b\\d{3}[-.])\\d{3}[-.]\\d{4}\\b",
)
SQL["pii_redact"] = f"""
WITH a AS (SELECT doc_id, text AS t0, regexp_replace(text, '{_MAIL}', '[REDACTED:EMAIL]', 'g') AS t1 FROM documents),
b AS (SELECT *, regexp_replace(t1, '{_TEL}', '[REDACTED:PHONE]', 'g') AS t2 FROM a),
c AS (SELECT *, regexp_replace(t2, '{_NAT}', '[REDACTED:PHONE]', 'g') AS t3,
        len(regexp_extract_all(t0, '{_MAIL}')) AS n0, len(regexp_extract_all(t1, '{_TEL}')) AS n1, len(regexp_extract_all(t2, '{_NAT}')) AS n2 FROM b)
SELECT doc_id, t3 AS text, array_to_string(list_filter([CASE WHEN n0 > 0 THEN 'EMAIL:' || n0 END, CASE WHEN n1 > 0 THEN 'PHONE:' || n1 END,
  CASE WHEN n2 > 0 THEN 'PHONE:' || n2 END], lambda x: x IS NOT NULL), ',') AS findings FROM c"""
SQL["injection_flag"] = f"""
SELECT conv_id, turn, regexp_matches(text, '(?i)(ignore (all )?previous instructions|system prompt|jailbreak|DAN mode|exfiltrate|reveal your prompt)') AS flagged
FROM (SELECT conv_id, turn, text FROM conversations UNION ALL SELECT * FROM {L.values(L.INJECTIONS, "conv_id, turn, text")})"""
SQL["coref_gate"] = f"""
SELECT conv_id, turn, regexp_matches(lower(text), '\\b(it|its|they|them|their|this|that|these|those|he|she|him|her)\\b') OR len({_plain("text")}) <= 4 AS needs_history
FROM conversations WHERE role = 'user'"""

# -- incremental index ---------------------------------------------------------------

_VERSIONS = """
o AS (SELECT doc_id::VARCHAR AS doc_id, text FROM documents),
w AS (SELECT doc_id, CASE WHEN doc_id::BIGINT % 10 = 1 THEN text || ' edited' ELSE text END AS text FROM o WHERE doc_id::BIGINT % 10 <> 0
      UNION ALL SELECT 'new' || doc_id, text FROM o WHERE doc_id::BIGINT % 10 = 2)"""
SQL["incremental_diff"] = f"""WITH {_VERSIONS},
a AS (SELECT doc_id, sha256(text)[1:16] AS h, 'sliding' AS s FROM o),
b AS (SELECT doc_id, sha256(text)[1:16] AS h, CASE WHEN doc_id LIKE '%3' THEN 'semantic' ELSE 'sliding' END AS s FROM w)
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.h IS NULL THEN 'added' WHEN b.h IS NULL THEN 'removed'
  WHEN a.h = b.h AND a.s = b.s THEN 'same' ELSE 'changed' END AS status FROM a FULL JOIN b USING (doc_id)"""
SQL["postings_update"] = f"""WITH {_VERSIONS}, {_BM25.replace("FROM documents", "FROM w", 1)}
SELECT query_id, chunk_id, score, rank FROM bm WHERE rank <= 10"""
SQL["vector_reuse"] = f"""WITH {_VERSIONS}
SELECT w.doc_id AS chunk_id, o.doc_id IS NOT NULL AS reused, CASE WHEN o.doc_id IS NOT NULL THEN length(w.text) ELSE -length(w.text) END::DOUBLE AS first
FROM w LEFT JOIN o ON w.doc_id = o.doc_id AND w.text = o.text"""
SQL["stale_purge"] = f"""WITH {_VERSIONS}
SELECT doc_id AS chunk_id, CASE WHEN doc_id IN (SELECT doc_id FROM w) THEN 'kept' ELSE 'stale' END AS state FROM o"""
SQL["priority_limit"] = """
WITH d AS (SELECT CASE WHEN doc_id % 3 = 0 THEN 'scale_' ELSE '' END || doc_id AS doc_id FROM documents)
SELECT doc_id, doc_id || '#s0' AS chunk_id FROM d ORDER BY doc_id LIKE 'scale\\_%' ESCAPE '\\', doc_id || '#s0' LIMIT 100"""
SQL["category_limit"] = f"""
WITH d AS (SELECT doc_id, source AS category, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS number FROM documents WHERE length({_STRIP.format("text")}) >= 200)
SELECT * FROM d WHERE number <= 20"""

# -- graph -----------------------------------------------------------------------------

_TRIPLES = f"""(SELECT * FROM {L.values(L.TRIPLES, "s, r, o, chunk_id")}
  UNION ALL SELECT split_part(text, ' ', 1), 'opens', concat_ws(' ', split_part(text, ' ', 2), split_part(text, ' ', 3)), 'b' || item_id FROM benchmark
  UNION ALL SELECT s_name, 'located in', 'NATION_' || s_nationkey, 's' || s_suppkey FROM supplier UNION ALL SELECT p_name, 'of', p_brand, 'p' || p_partkey FROM part)"""
_QUESTIONS = f"(SELECT * FROM {L.values(L.QUESTIONS, 'query_id, text')} UNION ALL SELECT doc_id + 1000, text FROM documents)"
_LINKED = f"""
t AS {_TRIPLES}, q AS {_QUESTIONS},
nm AS (SELECT min(name) AS name, lower(name) AS low FROM (SELECT s AS name FROM t UNION SELECT o FROM t) WHERE length(name) >= 3 GROUP BY lower(name)),
fd AS (SELECT query_id, name, low FROM q JOIN nm ON contains(lower(text), low)),
lk AS (SELECT query_id, name FROM fd a WHERE NOT EXISTS (SELECT 1 FROM fd b WHERE b.query_id = a.query_id AND b.low <> a.low AND contains(b.low, a.low)))"""
SQL["entity_link"] = f"WITH {_LINKED} SELECT * FROM lk"


def _hops(edges: str, starts: str, hops: int) -> str:
    return f"""
nd AS (SELECT query_id, lower(name) AS node, 0 AS d FROM {starts}
       UNION SELECT query_id, CASE WHEN lower(e.s) = node THEN lower(e.o) ELSE lower(e.s) END, d + 1
       FROM nd JOIN {edges} e ON node IN (lower(e.s), lower(e.o)) WHERE d < {hops - 1}),
mt AS (SELECT query_id, s, r, o, chunk_id, d + 1 AS hop FROM nd JOIN {edges} e ON node IN (lower(e.s), lower(e.o)))"""


SQL["khop_facts"] = f"""WITH RECURSIVE {_LINKED}, {_hops("t", "lk", 2)}
SELECT query_id, s, r, o, min(chunk_id) AS chunk_id, min(hop) AS hop FROM mt GROUP BY query_id, s, r, o"""
SQL["khop_tables"] = """
WITH c AS (SELECT 'n' || n_nationkey AS s, 'in' AS r, 'r' || n_regionkey AS o, n_regionkey AS q, 1 AS hop FROM nation
  UNION ALL SELECT 'c' || c_custkey, 'of', 'n' || c_nationkey, n_regionkey, 2 FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 'o' || o_orderkey, 'by', 'c' || o_custkey, n_regionkey, 3 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)
SELECT q AS query_id, s, r, o, hop FROM c WHERE q IN (SELECT r_regionkey FROM region)"""

# A customer's nation, its region and rows, its region's other nations, and their rows.
SQL["khop_deep"] = """
WITH q AS (SELECT c_custkey AS query_id, n_nationkey AS n, n_regionkey AS r FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey % 100 = 0),
e AS (SELECT c_nationkey AS n, 'c' || c_custkey AS id FROM customer UNION ALL SELECT s_nationkey, 's' || s_suppkey FROM supplier),
h AS (SELECT query_id, 1 AS hop, 'c' || query_id AS edge FROM q
  UNION ALL SELECT query_id, 2, 'n' || n FROM q
  UNION ALL SELECT query_id, 2, id FROM q JOIN e USING (n) WHERE id <> 'c' || query_id
  UNION ALL SELECT query_id, 3, 'n' || n_nationkey FROM q JOIN nation ON n_regionkey = r WHERE n_nationkey <> n
  UNION ALL SELECT query_id, 4, id FROM q JOIN nation ON n_regionkey = r AND n_nationkey <> q.n JOIN e ON e.n = n_nationkey)
SELECT query_id, hop, count(*) AS edges FROM h GROUP BY ALL"""

# -- measures ----------------------------------------------------------------------------

_GOLD = """
gd AS (SELECT item_id AS query_id, 'doc' || lpad(doc_id::VARCHAR, 9, '0') AS doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
gs AS (SELECT query_id, list(doc_id) AS gold, count(*) AS n FROM gd GROUP BY 1)"""


def _measures(hits: str) -> str:
    return f"""
rn AS (SELECT h.query_id, 'doc' || lpad(chunk_id::VARCHAR, 9, '0') AS doc, rank FROM {hits} h WHERE rank <= 10),
ht AS (SELECT g.query_id, g.n, r.rank, list_contains(g.gold, r.doc) AS hit FROM gs g LEFT JOIN rn r USING (query_id)),
ms AS (SELECT query_id, round(count(*) FILTER (hit AND rank <= 5) / 5, 4) AS precision, round(count(*) FILTER (hit AND rank <= 5) / any_value(n), 4) AS recall,
         round(coalesce(1 / min(rank) FILTER (hit), 0), 4) AS mrr,
         round(coalesce(sum(1 / log2(rank + 1)) FILTER (hit AND rank <= 5), 0) / list_sum(list_transform(range(1, least(any_value(n), 5) + 1), lambda i: 1 / log2(i + 1))), 4) AS ndcg
       FROM ht GROUP BY query_id)"""


SQL["ir_metrics"] = f"WITH {_BM25}, {_GOLD}, {_measures('bm')} SELECT * FROM ms"
_MEAN = "round(avg(round({0}, 3)), 3) AS {0}"
_MEANS = ", ".join(_MEAN.format(c) for c in ("precision", "recall", "mrr", "ndcg"))
SQL["metric_gate"] = f"""WITH {_BM25}, {_GOLD}, {_measures("bm")}, x AS (SELECT {_MEANS} FROM ms)
SELECT *, CASE WHEN coalesce(recall, 0) >= 0.6 AND coalesce(ndcg, 0) >= 0.6 THEN 'PASS' ELSE 'REVIEW' END AS gate FROM x"""
SQL["ndcg_graded"] = f"""WITH {_BM25}, {_GOLD},
gr AS (SELECT *, length(doc_id) % 2 + right(doc_id, 1)::INT % 2 AS g FROM gd),
rn AS (SELECT query_id, 'doc' || lpad(chunk_id::VARCHAR, 9, '0') AS doc_id, rank FROM bm WHERE rank <= 10),
jn AS (SELECT r.*, coalesce(g, 0) AS g FROM rn r LEFT JOIN gr USING (query_id, doc_id)),
gt AS (SELECT query_id, sum((2 ** g - 1) / log2(rank + 1)) AS dcg, count(*) FILTER (g > 0) AS hits, 1 / min(rank) FILTER (g > 0) AS mrr FROM jn GROUP BY 1),
oi AS (SELECT query_id, g, row_number() OVER (PARTITION BY query_id ORDER BY g DESC) AS i FROM gr),
id AS (SELECT query_id, sum((2 ** g - 1) / log2(i + 1)) FILTER (i <= 10) AS ideal, count(*) FILTER (g > 0) AS rel FROM oi GROUP BY 1)
SELECT query_id, round(CASE WHEN ideal > 0 THEN coalesce(dcg, 0) / ideal ELSE 0 END, 6) AS ndcg, round(coalesce(hits, 0) / greatest(rel, 1), 6) AS recall,
  round(coalesce(mrr, 0), 6) AS mrr FROM id LEFT JOIN gt USING (query_id)"""
_SUMMED = "SELECT round(avg(l_discount) * 10, 3) AS faithfulness, round(avg(l_tax) * 10, 3) AS recall, round(avg(l_quantity) / 100, 3) AS ndcg FROM lineitem"
SQL["drift_gate"] = f"""
WITH n AS ({_SUMMED} WHERE l_returnflag = 'R'), b AS ({_SUMMED}),
u AS (SELECT 'faithfulness' AS metric, b.faithfulness AS baseline, n.faithfulness AS current FROM n, b
      UNION ALL SELECT 'recall', b.recall, n.recall FROM n, b UNION ALL SELECT 'ndcg', b.ndcg, n.ndcg FROM n, b)
SELECT metric, baseline::DOUBLE AS baseline, current::DOUBLE AS current, round(current::DOUBLE - baseline::DOUBLE, 6) AS delta, round(baseline::DOUBLE - current::DOUBLE, 6) > 0.1 AS failed FROM u"""


def _ablated(hits: str, name: str, fill: str) -> str:
    return f"SELECT '{name}' AS config, {_MEANS} FROM (WITH {_measures(hits)} SELECT * FROM ms)"


SQL["ablation"] = f"""WITH {_BM25}, {_HASHED}, {_GOLD},
d10 AS (SELECT * FROM hk WHERE rank <= 10), s10 AS (SELECT * FROM bm WHERE rank <= 10), {_fused("d10", "s10", 10)}, {_RERANKED.format("hy")}
{_ablated("d10", "dense", "")} UNION ALL {_ablated("s10", "bm25", "")} UNION ALL {_ablated("hy", "hybrid", "")}
UNION ALL {_ablated("(SELECT * FROM rk WHERE rank <= 5)", "hybrid+rerank", "")}"""
SQL["answer_relevance"] = f"""
WITH a AS (SELECT * FROM {L.values(L.KEYWORDS, "query_id, answer, keywords")} UNION ALL
  SELECT doc_id + 1000, text, [source, lang[1:1], 'Est'] FROM documents WHERE text IS NOT NULL AND source IS NOT NULL AND lang IS NOT NULL)
SELECT query_id, round(CASE WHEN len(keywords) > 0 THEN len(list_filter(keywords, lambda k: contains(lower(answer), lower(k)))) / len(keywords) ELSE 0 END, 6) AS relevance FROM a"""

# -- sessions, logs ------------------------------------------------------------------------

SQL["last_turns"] = """
WITH r AS (SELECT conv_id AS session_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS recency FROM conversations)
SELECT * FROM r WHERE recency <= 6"""
SQL["history_block"] = """
WITH t AS (SELECT u.conv_id, u.turn, 'User: ' || substr(u.text, 1, 500) || chr(10) || 'Assistant: ' || substr(a.text, 1, 800) AS line
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant'),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM t)
SELECT conv_id::VARCHAR AS session_id, string_agg(line, chr(10) ORDER BY turn) AS history FROM r WHERE n <= 6 GROUP BY 1"""
SQL["rate_window"] = """
SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECONDS PRECEDING AND CURRENT ROW) AS in_window FROM events"""
SQL["latency_pcts"] = """
WITH r AS (SELECT event_type AS route, value AS ms, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS k FROM events),
s AS (SELECT route, list_sort(list(ms)) AS l, round(sum(ms), 4) AS total FROM r WHERE k <= 2000 GROUP BY 1)
SELECT route, len(l) AS n, total, l[len(l) // 2 + 1] AS p50, l[least(len(l) - 1, floor(len(l) * 0.95)::INT) + 1] AS p95 FROM s"""
SQL["event_counts"] = "SELECT '/' || event_type AS route, user_id % 3 AS status, count(*) AS n FROM events GROUP BY ALL"
SQL["gauges"] = "SELECT event_type AS name, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1"
SQL["exposition"] = """
SELECT 'events_total{app="x",type="' || event_type || '\\"\\n"} ' || count(*) AS line FROM events GROUP BY event_type"""
SQL["feedback_votes"] = """
SELECT count(*) FILTER (quality = 1) AS up, count(*) FILTER (quality IS DISTINCT FROM 1) AS down, count(*) AS total FROM labels"""
SQL["feedback_stream"] = SQL["feedback_votes"]
SQL["answer_cache"] = f"""
WITH a AS (SELECT * FROM {L.values(L.ASKED, "query_id, key, ts")} UNION ALL SELECT event_id + 100, 'u' || user_id % 50, ts::VARCHAR FROM events WHERE event_id % 3 = 0),
s AS (SELECT * FROM {L.values(L.STORED, "key, ts, answer")} UNION ALL SELECT 'u' || user_id % 50, ts::VARCHAR, event_id::VARCHAR FROM events WHERE event_id % 3 = 1),
m AS (SELECT key, max(ts::TIMESTAMP) AS t, arg_max(answer, ts::TIMESTAMP) AS answer FROM s GROUP BY 1),
j AS (SELECT query_id, m.answer, a.ts::TIMESTAMP >= t AND a.ts::TIMESTAMP < t + INTERVAL 600 SECONDS AS fresh FROM a LEFT JOIN m USING (key))
SELECT query_id, CASE WHEN fresh THEN answer END AS answer, coalesce(fresh, false) AS hit FROM j"""
SQL["qrels"] = f"""
WITH l AS (SELECT * FROM {L.values(L.QREL_LINES, "n, value")} UNION ALL SELECT doc_id * 2 + 100, 'q' || doc_id % 7 || chr(9) || 'd' || doc_id % 500 || chr(9) || quality FROM labels
  UNION ALL SELECT doc_id * 2 + 101, 'q' || doc_id % 7 || '  d' || doc_id % 500 || '  ' || toxic FROM labels), p AS (SELECT n, string_split_regex(trim(value), '\\s+') AS p FROM l),
g AS (SELECT p[1] AS query_id, p[2] AS doc_id, try_cast(try_cast(p[3] AS DOUBLE) AS INT) AS grade, n FROM p WHERE len(p) >= 3 AND p[1] <> 'query-id')
SELECT query_id, doc_id, arg_max(grade, n) AS grade FROM g GROUP BY ALL HAVING arg_max(grade, n) IS NOT NULL"""

_CONTEXTS = f"""{_BM25},
t10 AS (SELECT * FROM bm WHERE rank <= 10),
cs AS (SELECT h.query_id, h.chunk_id, h.rank AS prior, d.text, b.text AS question, list_distinct({_plain("b.text")}) AS q, {_plain("d.text")} AS t,
         regexp_extract_all(upper(b.text), '[A-Z]{{2,}}-\\d+') AS qc, regexp_extract_all(upper(d.text), '[A-Z]{{2,}}-\\d+') AS tc
       FROM t10 h JOIN benchmark b ON b.item_id = h.query_id JOIN documents d ON d.doc_id = h.chunk_id),
cr AS (SELECT *, round(len(list_intersect(q, t)) / greatest(len(q), 1) + CASE WHEN list_has_any(qc, tc) THEN 0.5 ELSE 0 END, 4) AS rerank_score FROM cs),
cx AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, prior) AS rank FROM cr QUALIFY rank <= 5)"""
_PROMPT = [part.replace("'", "''") for part in PROMPT]
SQL["prompt_context"] = f"""WITH {_CONTEXTS},
pg AS (SELECT query_id, any_value(question) AS question,
         string_agg('[' || chunk_id || '] ' || regexp_replace(substr(text, 1, 1200), '(?i)</\\s*(retrieved-context|context|system|instruction)\\s*>', '[escaped-tag]', 'g'),
                    chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS body, string_agg('[' || chunk_id || ']', ', ' ORDER BY rank) AS cited
       FROM cx GROUP BY query_id)
SELECT query_id, '{_PROMPT[0]}' || body || '{_PROMPT[1]}' || question || chr(10) || '(You may cite ONLY these files: ' || cited || '.)' || '{_PROMPT[2]}' AS prompt FROM pg"""
SQL["model_triples"] = f"""
WITH r AS (SELECT * FROM {L.values(L.REPLIES, "chunk_id, reply")} UNION ALL
  SELECT doc_id::VARCHAR, 'Reply: ' || to_json([{{'s': source, 'r': 'holds', 'o': lang}}]) || ' end' FROM documents), j AS (SELECT chunk_id, regexp_extract(reply, '(?s)(\\[.*\\])', 1) AS js FROM r),
u AS (SELECT chunk_id, unnest(from_json(js, '[{{"s":"VARCHAR","r":"VARCHAR","o":"VARCHAR"}}]')) AS t FROM j WHERE json_valid(js))
SELECT t.s AS s, t.r AS r, t.o AS o, chunk_id FROM u WHERE t.s IS NOT NULL AND t.r IS NOT NULL AND t.o IS NOT NULL"""
