"""SQL of the queries whose logic is sequential or long: chunks by structure, cleaning,
facts, rewriting, quotes, admission; and of those over stored files and models."""

from __future__ import annotations

from ..functions import text as T
from ..operators.answer import ABSTENTION
from ..operators.agent import SYNONYMS
from . import literals as L
from .oracle import SQL as FIRST
from .oracle import _BM25, _CONTEXTS, _GOLD, _HASHED, _HYBRID, _PARENTS, _QUESTIONS, _RERANKED, _STRIP, _TRIPLES, _VERSIONS, _fused, _hops, _plain, _windows

SQL: dict[str, str] = {}

_SPACE = "[\\s\\x0b\\x{00a0}]"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"


def _collapse(x: str) -> str:
    return _strip(f"regexp_replace({x}, '{_SPACE}+', ' ', 'g')")


def _quoted(x: str) -> str:
    return x.replace("'", "''")


def _is_table(x: str) -> str:
    return f"(len(list_filter(string_split({x}, chr(10)), lambda li: starts_with({_strip('li')}, '|'))) >= 2)"


# -- chunks by structure: a reduction over paragraphs that carries what is open ----------

_ALL = f"SELECT doc_id::VARCHAR AS id, coalesce(text, '') AS text FROM documents UNION ALL SELECT * FROM {L.values(L.STRUCTURED, 'doc_id, text')}"
_FLUSH = f"CASE WHEN a.p <> '' THEN [{{'text': a.p, 'tokens': a.n, 'flag': {_is_table('a.p')}}}] ELSE [] END"
SQL["semantic_chunks"] = f"""
WITH RECURSIVE al AS ({_ALL}),
pl AS (SELECT id, list_filter(list_transform(string_split_regex(text, '\\n\\s*\\n'), lambda p: {_strip('p')}), lambda p: p <> '') AS l FROM al),
pg AS (SELECT id, i, l[i] AS p, greatest(1, length(l[i]) // 4)::INT AS n, {_is_table('l[i]')} AS t FROM pl, unnest(range(1, len(l) + 1)) AS u(i)),
big AS (SELECT {{'d': id, 'i': i}} AS id, p AS text FROM pg WHERE n > 40 AND NOT t),
{_windows("w", "big", 40, 40)},
ws AS (SELECT id, list({{'text': text, 'tokens': tokens, 'flag': false}} ORDER BY seq) AS o FROM w GROUP BY id),
x AS (SELECT pg.id, i, {{'p': p, 'n': n, 'c': t OR n > 40,
        'o': CASE WHEN t THEN [{{'text': p, 'tokens': n, 'flag': true}}] WHEN n > 40 THEN ws.o ELSE [] END}} AS e
      FROM pg LEFT JOIN ws ON ws.id.d = pg.id AND ws.id.i = i),
g AS (SELECT id, list_prepend({{'p': '', 'n': 0, 'c': false, 'o': []}}, list(e ORDER BY i)) AS l FROM x GROUP BY id),
r AS (SELECT id, list_reduce(l, lambda a, x: {{
        'p': CASE WHEN x.c THEN '' WHEN a.p = '' OR a.n + x.n > 40 THEN x.p ELSE a.p || chr(10) || chr(10) || x.p END,
        'n': (CASE WHEN x.c THEN 0 WHEN a.p <> '' AND a.n + x.n > 40 THEN x.n ELSE a.n + x.n END)::INT, 'c': false,
        'o': CASE WHEN x.c OR (a.p <> '' AND a.n + x.n > 40) THEN a.o || {_FLUSH} ELSE a.o END || x.o}}) AS a FROM g),
f AS (SELECT id, a.o || {_FLUSH} AS o FROM r)
SELECT id || '#m' || (k - 1) AS chunk_id, o[k].text AS text, o[k].tokens::INT AS token_est, o[k].flag AS table_flag, (k - 1)::INT AS seq
FROM f, unnest(range(1, len(o) + 1)) AS u(k)"""
SQL["table_annotate"] = f"""
WITH d AS ({_ALL}), r AS (SELECT *, len(list_filter(string_split(text, chr(10)), lambda x: x LIKE '|%|' AND length(x) > 1)) AS n FROM d)
SELECT id AS chunk_id, n >= 2 AS has_table, n::INT AS table_rows, regexp_matches(text, 'Figure\\s+F-\\d+|Fig\\.\\s*\\d+') AS has_figure_ref FROM r"""

# -- cleaning ------------------------------------------------------------------------------

_SCAFFOLD = "(?i)^#{1,3}\\s+(why this document exists|relational note)\\b.*$"
_TEST_LINE = "(?im)^test query:.*$"
_META = "(?i)\\s*This row-level fact tests table-aware parsing and parent-child chunking( \\([^)]*\\))?\\.?\\s*"
_BOILER = "(?i)(page \\d+ of \\d+|confidential — internal|draft v\\d+)"


def _clean(source: str) -> str:
    """CTE cl: id, text and the counts of a table of id, raw."""
    tidy = f"CASE WHEN starts_with({_strip('x')}, '|') THEN {_collapse('x')} ELSE regexp_replace(regexp_replace(x, '[ \\x{{00a0}}]+', ' ', 'g'), '{_SPACE}+$', '') END"
    plain = "replace(replace(regexp_replace(b, '" + _META + "', ' ', 'g'), chr(13) || chr(10), chr(10)), chr(9), ' ')"
    return f"""
c0 AS (SELECT id, raw, string_split(coalesce(raw, ''), chr(10)) AS l FROM {source}),
c1 AS (SELECT *, list_transform(l, lambda x: CASE WHEN regexp_matches({_strip('x')}, '^#{{1,3}}\\s+') THEN regexp_matches({_strip('x')}, '{_SCAFFOLD}')::INT END) AS k FROM c0),
c2 AS (SELECT *, list_filter(l, lambda x, i: coalesce(list_filter(k[1:i], lambda y: y IS NOT NULL)[-1], 0) = 0) AS kept FROM c1),
c3 AS (SELECT id, raw, len(l) - len(kept) AS dropped, array_to_string(kept, chr(10)) AS a FROM c2),
c4 AS (SELECT *, regexp_replace(a, '{_TEST_LINE}', '', 'g') AS b FROM c3),
c5 AS (SELECT *, regexp_replace(array_to_string(list_transform(string_split({plain}, chr(10)), lambda x: {tidy}), chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g') AS t FROM c4),
cl AS (SELECT id, {_strip(f"regexp_replace(t, '{_BOILER}', '', 'g')")} AS text, length(coalesce(raw, '')) AS chars_in, dropped,
        len(regexp_extract_all(a, '{_TEST_LINE}')) AS lines, len(regexp_extract_all(b, '{_META}')) AS metas FROM c5)"""


SQL["clean_text"] = f"""
WITH s AS (SELECT doc_id::VARCHAR AS id, text AS raw FROM documents UNION ALL SELECT * FROM {L.values(L.DIRTY, 'doc_id, text')}), {_clean('s')}
SELECT id AS doc_id, text, chars_in, dropped AS scaffold_sections_dropped, lines AS test_query_lines_dropped, metas AS meta_sentences_dropped,
  length(text) AS chars_out, round(100 * (1 - length(text) / greatest(chars_in, 1)), 1) AS reduction_pct FROM cl"""
SQL["ingest_stats"] = f"""
WITH RECURSIVE s AS (SELECT doc_id::VARCHAR AS id, text AS raw FROM documents), {_clean('s')},
ct AS (SELECT id, text FROM cl), {_windows("w", "ct", 220, 30)},
p AS (SELECT id, count(*) AS c, sum(tokens) AS t FROM w GROUP BY id),
a AS (SELECT count(*) AS docs, sum(chars_in) AS chars_in, sum(length(text)) AS chars_out FROM cl)
SELECT docs, chars_in, chars_out, sum(c) AS chunks, round(sum(t) / sum(c), 1) AS mean_token_est, count(*) FILTER (c > 1) AS split_docs,
  round(100 * (1 - any_value(chars_out) / greatest(any_value(chars_in), 1)), 1) AS reduction_pct FROM p, a GROUP BY docs, chars_in, chars_out"""

# -- scalar functions ------------------------------------------------------------------------


def _canonical(x: str) -> str:
    tidy = f"regexp_replace({_collapse(x)}, '^[.,;:]+|[.,;:]+$', '', 'g')"
    code = f"regexp_extract({tidy}, '(?i)^(?:component\\s+)?([a-z]{{1,3}}-?\\d+)$', 1)"
    letter = f"regexp_extract({tidy}, '(?i)^product\\s+([a-z])$', 1)"
    return f"CASE WHEN {letter} <> '' THEN 'Product ' || upper({letter}) WHEN {code} <> '' THEN 'Component ' || upper({code}) ELSE {tidy} END"


_ABSTAINS = _quoted(T.ABSTENTION)
SQL["scalar_functions"] = f"""
WITH r AS (SELECT * FROM {L.values(L.NAMES, 'id, name, forwarded, socket')}
  UNION ALL SELECT page_id + 1000, url, concat_ws(',', '10.0.0.1', url), '9.9.9.9' FROM pages),
p AS (SELECT *, list_filter(list_transform(string_split(coalesce(forwarded, ''), ','), lambda x: {_strip('x')}), lambda x: x <> '') AS f, string_split(name, ' ') AS w FROM r)
SELECT id, {_canonical('name')} AS canonical, substr(regexp_replace(coalesce(name, '?'), '[<>\\r\\n]', '', 'g'), 1, 120) AS safe_id,
  regexp_replace(name, '(?i)</\\s*(retrieved-context|context|system|instruction)\\s*>', '[escaped-tag]', 'g') AS escaped, split_part(name, '#', 1) AS doc,
  sha256(name)[1:16] AS hash, coalesce(CASE WHEN len(f) >= 2 THEN f[-2] END, socket, '?') AS client,
  array_to_string(list_transform(range(1, len(w) + 1, 2), lambda i: array_to_string(w[i:i + 1], ' ') || ' '), '/') AS pieces,
  sha256(concat_ws('|', lower({_strip('name')}), 5, 'true', 'false', 'v1')) AS key,
  regexp_matches(substr(string_split({_strip('name')}, chr(10))[1], 1, 300), '{_ABSTAINS}') AS abstains FROM p"""


def _point(x: str) -> str:
    d = f"sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || ({x})::VARCHAR::BLOB)"
    variant = f"printf('%02x', ((('0x' || substr(d, 17, 2))::INT & 63) | 128))"
    return f"(SELECT concat_ws('-', substr(d, 1, 8), substr(d, 9, 4), '5' || substr(d, 14, 3), {variant} || substr(d, 19, 2), substr(d, 21, 12)) FROM (SELECT {d} AS d))"


SQL["point_ids"] = f"SELECT doc_id::VARCHAR AS doc_id, {_point('doc_id')} AS point_id FROM documents"
SQL["upsert_prune"] = f"WITH {_VERSIONS} SELECT doc_id AS chunk_id, {_point('doc_id')} AS point_id, length(text) AS n FROM w"
SQL["upsert_buckets"] = SQL["upsert_prune"]
SQL["parent_expand"] = f"""{_PARENTS},
ca AS (SELECT * FROM {L.values(L.FAMILY, "chunk_id, doc_id, text, parent_id")}
  UNION ALL SELECT id || '#p' || seq, id, text, NULL FROM p UNION ALL SELECT d || '#p' || p || 'c' || n, d, text, d || '#p' || p FROM n),
h AS (SELECT * FROM {L.values(L.HITS, "query_id, chunk_id, rank")} UNION ALL SELECT d::BIGINT + 1000, d || '#p' || p || 'c' || n, n + 1 FROM n),
j AS (SELECT h.query_id, coalesce(q.chunk_id, h.chunk_id) AS context_id, coalesce(q.doc_id, ca.doc_id) AS doc_id, coalesce(q.text, ca.text) AS text,
        CASE WHEN q.chunk_id IS NOT NULL THEN h.chunk_id END AS retrieved_via, h.rank AS r
      FROM h LEFT JOIN ca ON ca.chunk_id = h.chunk_id LEFT JOIN ca q ON q.chunk_id = ca.parent_id),
f AS (SELECT *, row_number() OVER (PARTITION BY query_id, context_id ORDER BY r) AS n FROM j),
g AS (SELECT query_id, context_id, doc_id, text, retrieved_via, row_number() OVER (PARTITION BY query_id ORDER BY r) AS rank FROM f WHERE n = 1)
SELECT * FROM g WHERE rank <= 3"""

# -- facts -------------------------------------------------------------------------------------

_USES = "(?is)(Product\\s+[A-Z])\\b.*?uses\\b.*?((?:Component\\s+)?[A-Z]{1,3}-?\\d+)"
_SUPPLIED = "(?is)((?:Component\\s+)?XK-7)\\b.*?supplied by\\s+([A-Z][A-Za-z.\\- ]+(?:GmbH|Inc|LLC|Electrics|Precision)?)"
_SUPPLIES = "(?is)Supplies:\\s*((?:Component\\s+)?[A-Z]{1,3}-?\\d+).*?([A-Z][A-Za-z.\\- ]+(?:GmbH|Inc|LLC))"


def _triples(source: str) -> str:
    """CTE tx: s, r, o, chunk_id of a table of chunk_id, text."""
    marked = "regexp_replace(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), '\\n+', chr(1), 'g')"
    parts = " UNION ALL ".join(
        f"""SELECT chunk_id, '{r}' AS r, unnest(list_zip(regexp_extract_all(x, '{p}', 1), regexp_extract_all(x, '{p}', 2))) AS z FROM ts WHERE regexp_matches(x, '{p}')"""
        for p, r in ((_USES, "uses"), (_SUPPLIED, "supplied_by"), (_SUPPLIES, "supplies_rev"))
    )
    return f"""
ts AS (SELECT chunk_id, x FROM (SELECT chunk_id, unnest(string_split({marked}, chr(1))) AS x FROM {source}) WHERE length(x) >= 12),
tf AS ({parts}),
tg AS (SELECT chunk_id, r, {_collapse('z[1]')} AS a, {_collapse('z[2]')} AS b FROM tf),
tk AS (SELECT CASE WHEN v THEN b ELSE a END AS s, CASE WHEN v THEN 'supplies' WHEN r = 'supplies_rev' THEN 'supplied_by' ELSE r END AS r,
         CASE WHEN v THEN a ELSE b END AS o, min(chunk_id) AS chunk_id
       FROM (SELECT *, r = 'supplies_rev' AND regexp_matches(b, 'GmbH|Electrics') AS v FROM tg) GROUP BY ALL),
sd AS (SELECT * FROM (VALUES ('Product X', 'uses', 'Component XK-7', 'seed'), ('Component XK-7', 'supplied_by', 'Nordwerk Precision GmbH', 'seed')) AS v(s, r, o, chunk_id)),
tx AS (SELECT * FROM tk UNION ALL SELECT * FROM sd WHERE NOT EXISTS (SELECT 1 FROM tk WHERE tk.s = sd.s AND tk.r = sd.r AND tk.o = sd.o))"""


SQL["triples"] = f"""
WITH al AS (SELECT chunk_id, text FROM {L.values(L.FACT_TEXTS, 'chunk_id, doc_id, text')} UNION ALL SELECT doc_id::VARCHAR, coalesce(text, '') FROM documents), {_triples('al')}
SELECT s, r, o, chunk_id FROM tx"""
_FACTS = _TRIPLES
SQL["alias_merge"] = f"""
WITH t AS {_FACTS}, nm AS (SELECT name, {_canonical('name')} AS c FROM (SELECT s AS name FROM t UNION SELECT o FROM t)),
fm AS (SELECT DISTINCT c FROM nm),
rs AS (SELECT a.c, coalesce((SELECT b.c FROM fm b WHERE contains(lower(b.c), lower(a.c)) AND length(b.c) > length(a.c) ORDER BY length(b.c) DESC, b.c LIMIT 1), a.c) AS z FROM fm a),
mp AS (SELECT name, z FROM nm JOIN rs USING (c)),
j AS (SELECT x.z AS s, r, y.z AS o, chunk_id, x.z LIKE 'Component %' AS l, y.z LIKE 'Component %' AS g FROM t JOIN mp x ON x.name = s JOIN mp y ON y.name = o),
k AS (SELECT *, (r = 'supplies' AND l AND NOT g) AS f1, (r = 'supplied_by' AND NOT l AND g) AS f2 FROM j)
SELECT CASE WHEN f1 OR f2 THEN o ELSE s END AS s, CASE WHEN f1 THEN 'uses' ELSE r END AS r, CASE WHEN f1 OR f2 THEN s ELSE o END AS o, min(chunk_id) AS chunk_id FROM k GROUP BY ALL"""


def _named(asked: str) -> str:
    """CTEs: qs (query_id, text), lk (query_id, name): the nodes that questions name."""
    return f"""
t AS {_FACTS}, qs AS ({asked}),
nm AS (SELECT min(name) AS name, lower(name) AS low FROM (SELECT s AS name FROM t UNION SELECT o FROM t) WHERE length(name) >= 3 GROUP BY lower(name)),
fd AS (SELECT query_id, name, low FROM qs JOIN nm ON contains(lower(text), low)),
lk AS (SELECT query_id, name FROM fd a WHERE NOT EXISTS (SELECT 1 FROM fd b WHERE b.query_id = a.query_id AND b.low <> a.low AND contains(b.low, a.low)))"""


_RULES = " ".join(
    f"WHEN regexp_matches(text, '(?i)\\b{w}\\b') AND NOT ({' OR '.join(f'contains(lower(text), {x!r})' for x in more.split())}) THEN text || ' {more}'" for w, more in SYNONYMS
)


def _rewritten(asked: str, reply: str) -> str:
    return f"""
WITH RECURSIVE {_named(asked)}, {_hops("t", "lk", 2)},
sn AS (SELECT query_id, name, min(hop) AS hop FROM (SELECT query_id, hop, unnest([trim(s), trim(o)]) AS name FROM mt) WHERE name <> '' GROUP BY ALL),
sl AS (SELECT query_id, list_prepend([]::VARCHAR[], list([name] ORDER BY hop, name)) AS l FROM sn GROUP BY query_id),
ex AS (SELECT query_id, text, coalesce(list_reduce(l, lambda a, x: CASE WHEN contains(lower(text), lower(x[1])) OR len(list_filter(a, lambda y: contains(lower(y), lower(x[1])))) > 0
        THEN a ELSE a || x END), []) AS e FROM qs LEFT JOIN sl USING (query_id)),
rp AS (SELECT *, {reply} AS reply FROM ex)
SELECT query_id, CASE WHEN len(e) > 0 THEN text || ' ' || array_to_string(e[1:4], ' ') WHEN reply IS NOT NULL THEN reply {_RULES} ELSE text END AS text,
  CASE WHEN len(e) > 0 THEN 'graph-expansion' WHEN reply IS NOT NULL THEN 'llm-rewrite' ELSE 'lexical-rules' END AS method FROM rp"""


_ASKED = f"SELECT * FROM {_QUESTIONS}"
SQL["query_rewrite"] = _rewritten(_ASKED, "NULL::VARCHAR")
SQL["model_rewrite"] = _rewritten(
    f"SELECT * FROM {L.values(L.QUESTIONS, 'query_id, text')} UNION ALL SELECT item_id + 1000, text FROM benchmark", "CASE WHEN length(text) % 3 > 0 THEN length(text) || ' characters' END"
)
SQL["follow_ups"] = f"""
WITH us AS (SELECT 'c' || conv_id AS session_id, conv_id, turn, text, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations WHERE role = 'user'),
fu AS (SELECT * FROM {L.values(L.FOLLOW_UPS, 'query_id, session_id, text')} UNION ALL SELECT conv_id + 1000, session_id, substr(text, 1, 40) || ' it' FROM us WHERE turn = last),
tn AS (SELECT * FROM {L.values(L.TURNS, 'session_id, turn, q')} UNION ALL SELECT session_id, turn, text FROM us WHERE turn < last),
{_named("SELECT {'s': session_id, 'n': turn} AS query_id, q AS text FROM tn")},
ln AS (SELECT * FROM fu WHERE session_id IS NOT NULL AND (regexp_matches(lower(text), '{T.PRONOUN}') OR len({_plain("text")}) <= 4)),
rw AS (SELECT ln.query_id, name, lk.query_id.n AS turn FROM ln JOIN lk ON lk.query_id.s = ln.session_id WHERE NOT contains(lower(text), lower(name))),
fi AS (SELECT query_id, name, min(turn) AS turn FROM rw GROUP BY ALL),
ex AS (SELECT query_id, list(name ORDER BY turn, length(name) DESC, name)[1:3] AS e FROM fi GROUP BY query_id)
SELECT fu.query_id, CASE WHEN e IS NULL THEN text ELSE text || ' ' || array_to_string(e, ' ') END AS text, coalesce(array_to_string(e, ','), '') AS expansion
FROM fu LEFT JOIN ex USING (query_id)"""
SQL["graph_merge"] = f"""
WITH RECURSIVE {_named(_ASKED)}, {_hops("t", "lk", 2)},
ca AS (SELECT * FROM {L.values(L.CANDIDATES, 'query_id, chunk_id, rrf, rank')} UNION ALL SELECT doc_id + 1000, doc_id::VARCHAR, 0.03, 1 FROM documents
  UNION ALL SELECT doc_id + 1000, 'b' || doc_id % 40, 0.02, 2 FROM documents),
fc AS (SELECT chunk_id, text FROM {L.values(L.FACT_TEXTS, 'chunk_id, doc_id, text')} UNION ALL SELECT 'b' || item_id, text FROM benchmark),
kf AS (SELECT query_id, s, r, o, min(chunk_id) AS chunk_id, min(hop) AS hop FROM mt GROUP BY query_id, s, r, o),
wn AS (SELECT query_id, chunk_id, min(hop) AS hop FROM kf WHERE chunk_id IN (SELECT chunk_id FROM fc) GROUP BY ALL),
la AS (SELECT query_id, max(rank) AS last FROM ca GROUP BY 1),
nw AS (SELECT wn.*, last FROM wn LEFT JOIN la USING (query_id) WHERE NOT EXISTS (SELECT 1 FROM ca WHERE ca.query_id = wn.query_id AND ca.chunk_id = wn.chunk_id))
SELECT query_id, chunk_id, rrf, rank, false AS via_graph FROM ca
UNION ALL SELECT query_id, chunk_id, 0.01, coalesce(last, 0) + row_number() OVER (PARTITION BY query_id ORDER BY hop, chunk_id), true FROM nw"""


# -- the agent: three rounds of search over weak questions, then the graph's chunks and a reranking ----


def _over(sql: str, docs: str, asked: str) -> str:
    """Search SQL over other tables: docs (doc_id, text), asked (item_id, text)."""
    return sql.replace("documents", docs).replace("benchmark", asked)


def _round(n: int) -> str:
    """CTEs from the hits h{n} of questions q{n} (item_id, text, tried): weak ones rewritten as
    q{n + 1}, and their hits."""
    text = _strip("r.text")
    return f"""
w{n} AS (SELECT q.* FROM q{n} q LEFT JOIN (SELECT query_id, sum(rrf) FILTER (rank <= 5) AS mass FROM h{n} GROUP BY 1) m ON m.query_id = q.item_id WHERE coalesce(mass, 0) < 0.02),
r{n} AS ({_rewritten(f"SELECT item_id AS query_id, text FROM w{n}", "NULL::VARCHAR")}),
q{n + 1} AS (SELECT item_id, r.text AS text, list_append(tried, lower({text})) AS tried FROM r{n} r JOIN w{n} w ON w.item_id = r.query_id WHERE NOT list_contains(tried, lower({text}))),
h{n + 1} AS (WITH {_over(_HYBRID, "dcs", f"q{n + 1}")} SELECT * FROM hy)"""


SQL["agent_search"] = f"""
WITH RECURSIVE dcs AS (SELECT chunk_id AS doc_id, text FROM {L.values(L.FACT_TEXTS, 'chunk_id, doc_id, text')} UNION ALL SELECT doc_id::VARCHAR, text FROM documents),
q1 AS (SELECT query_id AS item_id, text, [lower({_strip('text')})] AS tried
  FROM (SELECT * FROM {L.values(L.QUESTIONS, 'query_id, text')} UNION ALL SELECT item_id + 1000, text FROM benchmark)),
h1 AS (WITH {_over(_HYBRID, "dcs", "q1")} SELECT * FROM hy), {_round(1)}, {_round(2)},
hits AS (SELECT * FROM h1 WHERE query_id NOT IN (SELECT item_id FROM q2) UNION ALL SELECT * FROM h2 WHERE query_id NOT IN (SELECT item_id FROM q3) UNION ALL SELECT * FROM h3),
{_named("SELECT item_id AS query_id, text FROM q1")}, {_hops("t", "lk", 2)},
wn AS (SELECT query_id, chunk_id, min(hop) AS hop FROM (SELECT query_id, s, r, o, min(chunk_id) AS chunk_id, min(hop) AS hop FROM mt GROUP BY query_id, s, r, o)
  WHERE chunk_id IN (SELECT doc_id FROM dcs) GROUP BY ALL),
la AS (SELECT query_id, max(rank) AS last FROM hits GROUP BY 1),
nw AS (SELECT wn.*, last FROM wn LEFT JOIN la USING (query_id) WHERE NOT EXISTS (SELECT 1 FROM hits WHERE hits.query_id = wn.query_id AND hits.chunk_id = wn.chunk_id)),
mg AS (SELECT query_id, chunk_id, rank FROM hits
  UNION ALL SELECT query_id, chunk_id, coalesce(last, 0) + row_number() OVER (PARTITION BY query_id ORDER BY hop, chunk_id) FROM nw), {_over(_RERANKED.format("mg"), "dcs", "q1")}
SELECT query_id, chunk_id, prior, rerank_score, rank FROM rk WHERE rank <= 5"""
SQL["model_facts"] = """
WITH c AS (SELECT doc_id::VARCHAR AS chunk_id, length(substr(text || ' vendor', 1, 1500)) AS n FROM documents WHERE NOT starts_with(doc_id::VARCHAR, 'scale_20news') AND text IS NOT NULL),
r AS (SELECT *, row_number() OVER (ORDER BY chunk_id) AS k FROM c)
SELECT 'T' || (n % 5) AS s, 'uses' AS r, 'T' || (n % 11) AS o, chunk_id FROM r WHERE k <= 20"""

# -- quotes: lines to blocks, blocks to units, units to sentences --------------------------------

_START = "^(?:[-*#>]|\\d+[.)])"
_ROW = "starts_with(coalesce({0}, ''), '|')"
_QUOTES = f"""{_CONTEXTS},
qa AS (SELECT query_id, chunk_id, rank, rerank_score, q, list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: {_strip('x')}) AS l FROM cx WHERE rank <= 3),
qb AS (SELECT *, list_filter(range(1, len(l) + 1), lambda i: i = 1 OR l[i - 1] = '' OR l[i] = '' OR
         CASE WHEN {_ROW.format('l[i]')} THEN NOT {_ROW.format('l[i - 1]')} ELSE regexp_matches(l[i], '{_START}') END) AS st FROM qa),
qc AS (SELECT *, list_filter(list_transform(range(1, len(st) + 1), lambda j: array_to_string(l[st[j]:coalesce(st[j + 1], len(l) + 1) - 1], ' ')), lambda b: b <> '') AS bs FROM qb),
qd AS (SELECT *, list_filter(list_transform(range(1, len(bs) + 1), lambda j: CASE
         WHEN NOT {_ROW.format('bs[j]')} AND j > 1 AND {_ROW.format('bs[j - 1]')} THEN bs[j - 1] || ' ' || bs[j]
         WHEN {_ROW.format('bs[j]')} AND j < len(bs) AND NOT {_ROW.format('bs[j + 1]')} THEN NULL ELSE bs[j] END), lambda u: u IS NOT NULL) AS us FROM qc),
qe AS (SELECT *, list_filter(list_transform(flatten(list_transform(us, lambda u: CASE WHEN {_ROW.format('u')} THEN [u]
         ELSE string_split(regexp_replace(u, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) END)), lambda x: {_strip('x')}), lambda x: length(x) >= 20) AS ss FROM qd),
qf2 AS (SELECT query_id, max(rerank_score) AS best FROM qa GROUP BY 1),
qg AS (SELECT e.query_id, chunk_id, rank, pos, ss[pos] AS s,
         len(list_intersect(q, {_plain('ss[pos]')})) * CASE WHEN best > 0 THEN 0.25::DOUBLE + 0.75::DOUBLE * (rerank_score / best) ELSE 1 END AS score
       FROM qe e JOIN qf2 USING (query_id), unnest(range(1, len(ss) + 1)) AS u(pos)),
qh AS (SELECT *, row_number() OVER (PARTITION BY query_id, lower(s) ORDER BY score DESC, rank, pos) AS copy FROM qg),
qi AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank, pos) AS n FROM qh WHERE copy = 1),
qj AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS top FROM qi WHERE n <= 3),
qk AS (SELECT query_id, string_agg(s || ' [' || chunk_id || ']', ' ' ORDER BY n) AS answer FROM qj WHERE (n = 1 OR score >= greatest(1, top / 2)) AND top > 0 GROUP BY 1)"""
SQL["extractive_answer"] = f"WITH {_QUOTES} SELECT item_id AS query_id, coalesce(answer, '{_quoted(ABSTENTION)}') AS answer FROM benchmark LEFT JOIN qk ON item_id = query_id"
_PROMPTS = FIRST["prompt_context"].removeprefix("WITH ").rsplit("SELECT query_id,", 1)
SQL["model_answers"] = f"""WITH {_PROMPTS[0].rstrip()},
pr AS (SELECT query_id,{_PROMPTS[1]}), ml AS (SELECT query_id, length(prompt) AS n FROM pr)
SELECT query_id, CASE WHEN n % 3 > 0 THEN 'model' ELSE 'extractive' END AS method, CASE WHEN n % 3 > 0 THEN n || ' characters' END AS reply, n // 4 AS prompt_tokens FROM ml"""

# -- faithfulness: sentences with the marks beside them, judged against the contexts' sentences ----

_CITE = T.CITATION
_LOOSE = "string_split(regexp_replace(regexp_replace({0}, '([.!?])\\s+', '\\1' || chr(1), 'g'), '\\n+', chr(1), 'g'), chr(1))"
_TOKEN = "{{'o': []::STRUCT(t VARCHAR, d VARCHAR[])[], 'w': []::VARCHAR[], 't': NULL::VARCHAR, 'd': []::VARCHAR[], 'c': {c}, 'v': {v}}}"
_CLOSED = "CASE WHEN a.t IS NOT NULL AND length(regexp_replace(a.t, '^[ .,\\n\\t]+|[ .,\\n\\t]+$', '', 'g')) >= 3 THEN a.o || [{'t': a.t, 'd': a.d}] ELSE a.o END"
_NEGATIONS = "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in T.NEGATIONS) + "]"
_OVERLAP = "len(list_intersect(ds, s)) / n"
SQL["faithfulness"] = f"""WITH {_QUOTES},
an AS (SELECT * FROM {L.values(L.ANSWERS, 'query_id, answer')} UNION ALL
  SELECT item_id + 1000, coalesce(answer, '{_quoted(ABSTENTION)}') FROM benchmark LEFT JOIN qk ON item_id = query_id),
co AS (SELECT * FROM {L.values(L.CONTEXTS, 'query_id, doc_id, text')} UNION ALL SELECT query_id + 1000, chunk_id::VARCHAR, coalesce(text, '') FROM cx),
cs2 AS (SELECT query_id, doc_id, list_transform(list_filter({_LOOSE.format('text')}, lambda x: length({_strip('x')}) > 8), lambda x: list_distinct({_plain('x')})) AS sets FROM co),
ag AS (SELECT query_id, answer, string_split_regex(answer, '{_CITE}') AS g, regexp_extract_all(answer, '{_CITE}', 1) AS m FROM an),
tk2 AS (SELECT query_id, answer, flatten(list_transform(range(1, len(g) + 1), lambda i:
          list_transform(list_filter(list_transform({_LOOSE.format('g[i]')}, lambda x: {_strip('x')}), lambda x: x <> ''), lambda x: {_TOKEN.format(c='false', v='x')})
          || CASE WHEN i <= len(m) THEN [{_TOKEN.format(c='true', v=_strip('m[i]'))}] ELSE [] END)) AS l FROM ag),
st2 AS (SELECT query_id, answer, list_reduce(list_prepend({_TOKEN.format(c='false', v="''")}, l), lambda a, x: {{
          'o': CASE WHEN x.c THEN a.o ELSE {_CLOSED} END,
          'w': CASE WHEN x.c AND a.t IS NULL THEN a.w || [x.v] WHEN x.c THEN a.w ELSE [] END,
          't': CASE WHEN x.c THEN a.t ELSE x.v END,
          'd': CASE WHEN x.c AND a.t IS NOT NULL THEN a.d || [x.v] WHEN x.c THEN a.d ELSE a.w END, 'c': false, 'v': ''}}) AS a FROM tk2),
sp AS (SELECT query_id, k, sp[k].t AS t, sp[k].d AS d FROM (SELECT query_id, {_CLOSED} AS sp FROM st2), unnest(range(1, len(sp) + 1)) AS u(k)),
dc AS (SELECT query_id, k, t, unnest(CASE WHEN len(d) > 0 THEN d ELSE [NULL] END) AS doc FROM sp),
jn2 AS (SELECT dc.query_id, k, t, doc, coalesce(flatten(list(sets) FILTER (sets IS NOT NULL)), []) AS sets
        FROM dc LEFT JOIN cs2 ON cs2.query_id = dc.query_id AND (doc IS NULL OR cs2.doc_id = doc) GROUP BY ALL),
wd AS (SELECT *, list_filter({_plain('t')}, lambda x: length(x) > 3) AS tk, list_filter(regexp_extract_all(lower(t), '[a-z0-9'']+'), lambda x: list_contains({_NEGATIONS}, x) OR ends_with(x, 'n''t')) AS ng FROM jn2),
we AS (SELECT *, len(tk) AS n, list_distinct(tk) AS ds, flatten(sets) AS ev FROM wd),
jd AS (SELECT query_id, k, CASE WHEN n = 0 OR len(list_filter(tk, lambda x: list_contains(ev, x))) < 0.5 * n THEN false
         WHEN len(ng) > 0 THEN len(list_filter(sets, lambda s: list_has_any(ng, s) AND {_OVERLAP} >= 0.5)) > 0
         ELSE len(list_filter(sets, lambda s: len(list_filter(list_intersect({_NEGATIONS}, s), lambda y: NOT list_contains(ds, y))) > 0 AND {_OVERLAP} >= 0.6)) = 0 END AS good FROM we),
js AS (SELECT query_id, k, bool_or(good) AS good FROM jd GROUP BY ALL),
jt AS (SELECT query_id, count(*) AS n, count(*) FILTER (good) AS g FROM js GROUP BY 1)
SELECT query_id, round(CASE WHEN regexp_matches(substr(string_split({_strip('answer')}, chr(10))[1], 1, 300), '{_ABSTAINS}') THEN 1 WHEN n > 0 THEN g / n ELSE 0 END, 6) AS faithfulness
FROM an LEFT JOIN jt USING (query_id)"""

# -- admission: two admitted calls decide, one event of every client at a time ----------------------

SQL["rate_limit_state"] = """
WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
r AS (SELECT event_id, user_id, k, true AS admitted, NULL::BIGINT AS a, t AS b FROM e WHERE k = 1
  UNION ALL
  SELECT e.event_id, e.user_id, e.k, ok, CASE WHEN ok THEN b ELSE a END, CASE WHEN ok THEN t ELSE b END
  FROM (SELECT e.*, r.a, r.b, NOT coalesce(e.t - r.a <= 86400000000, false) AS ok FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1) e)
SELECT event_id, user_id, admitted FROM r"""
SQL["rate_limit_stream"] = SQL["rate_limit_state"]
SQL["session_stream"] = """
WITH t AS (SELECT u.conv_id, u.turn, 'User: ' || substr(u.text, 1, 500) || chr(10) || 'Assistant: ' || substr(a.text, 1, 800) AS line
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant')
SELECT conv_id::VARCHAR AS session_id, turn, coalesce(lag(line) OVER (PARTITION BY conv_id ORDER BY turn) || chr(10), '') || line AS history FROM t"""
SQL["answer_cache_stream"] = """
WITH e AS (SELECT event_id, 'u' || user_id % 50 AS key, epoch_us(ts) AS t, CASE WHEN event_id % 3 = 1 THEN event_id::VARCHAR END AS answer
  FROM events WHERE event_id % 3 < 2 AND user_id IS NOT NULL AND ts IS NOT NULL),
p AS (SELECT *, last_value(answer IGNORE NULLS) OVER w AS held, last_value(CASE WHEN answer IS NOT NULL THEN t END IGNORE NULLS) OVER w AS since
  FROM e WINDOW w AS (PARTITION BY key ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT event_id AS query_id, CASE WHEN t - since <= 86400000000 THEN held END AS answer, coalesce(t - since <= 86400000000, false) AS hit FROM p WHERE answer IS NULL"""
SQL["admission_cap"] = """
WITH e AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
h AS (SELECT user_id, max(ts) FILTER (before IS NULL OR ts - before > INTERVAL 86400 SECONDS) AS since, max(ts) AS last FROM e GROUP BY 1)
SELECT * FROM h WHERE (SELECT max(ts) FROM events) - last <= INTERVAL 86400 SECONDS ORDER BY since DESC, user_id LIMIT 50"""

# -- stored zones, files, models ----------------------------------------------------------------------

SQL["rich_documents"] = """
SELECT 'n' || c_nationkey || '/c' || c_custkey || ['.docx', '.pdf', '.txt'][c_custkey % 3 + 1] AS doc_id, 'Customer ' || c_name || ' (no. ' || c_custkey || ')' ||
  CASE c_custkey % 3 WHEN 0 THEN chr(10) || '| field | value |' || chr(10) || '|---|---|' || chr(10) || '| Segment | ' || c_mktsegment || ' |'
    WHEN 1 THEN chr(10) || chr(10) || 'Segment: ' || c_mktsegment ELSE chr(10) || 'Segment: ' || c_mktsegment END AS text FROM customer"""
SQL["stored_index"] = FIRST["bm25_topk"]
SQL["backend_fallback"] = FIRST["dense_topk"]
SQL["zone_roundtrip"] = f"""
WITH RECURSIVE s AS (SELECT doc_id::VARCHAR AS id, text AS raw FROM documents), {_clean('s')},
src AS (SELECT id, text FROM cl), {_windows("p", "src", 1000, 40)}, cs AS (SELECT {{'d': id, 'p': seq}} AS id, text FROM p), {_windows("c", "cs", 220, 30)},
n AS (SELECT id.d AS d, id.p AS p, text, row_number() OVER (PARTITION BY id.d ORDER BY id.p, seq) - 1 AS n FROM c),
ch AS (SELECT id || '#p' || seq AS chunk_id, text FROM p UNION ALL SELECT d || '#p' || p || 'c' || n, text FROM n), {_triples('ch')}
SELECT 'cleaned' AS zone, id, length(text) AS n FROM cl UNION ALL SELECT 'chunked', chunk_id, length(text) FROM ch
UNION ALL SELECT 'vectors', d || '#p' || p || 'c' || n, 384 FROM n UNION ALL SELECT 'edges', concat_ws(' ', s, r, o), length(chunk_id) FROM tx"""
SQL["ingest_tables"] = f"""
WITH RECURSIVE s AS (SELECT doc_id::VARCHAR AS id, text AS raw FROM documents), {_clean('s')},
src AS (SELECT id, text FROM cl), {_windows("w", "src", 220, 30)}, {_windows("p", "src", 1000, 40)},
cs AS (SELECT {{'d': id, 'p': seq}} AS id, text FROM p), {_windows("c", "cs", 220, 30)},
ch AS (SELECT 'sliding' AS strategy, text, tokens FROM w UNION ALL SELECT 'another name', text, tokens FROM w
  UNION ALL SELECT 'parent_child', text, tokens FROM p UNION ALL SELECT 'parent_child', text, tokens FROM c)
SELECT strategy, count(*) AS chunks, sum(tokens) AS tokens, sum(length(text)) AS chars FROM ch GROUP BY strategy"""
SQL["json_lines"] = "SELECT conv_id, turn, text, true AS stamped FROM conversations"
SQL["history_last"] = """
WITH r AS (SELECT event_id, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS k FROM events)
SELECT event_id, row_number() OVER (ORDER BY k DESC) AS place FROM r WHERE k <= 100"""
SQL["corpus_files"] = f"""
SELECT item_id::VARCHAR AS doc_id, {_STRIP.format("concat_ws(' ', ' title ' || item_id, text)")} AS text, len(string_split(text, ' ')) AS keywords,
  CASE WHEN item_id % 2 = 0 THEN item_id % 3 END AS grade FROM benchmark"""
SQL["raw_scan"] = "SELECT 'key' || n_nationkey AS name, '# Nation ' || n_name AS text FROM nation WHERE n_nationkey % 5 <> 0"
SQL["result_files"] = f"""
WITH b AS (SELECT round(avg(l_discount) * 10, 3)::DOUBLE AS f, round(avg(l_tax) * 10, 3)::DOUBLE AS r, round(avg(l_quantity) / 100, 3)::DOUBLE AS n FROM lineitem), c AS {L.values(L.NOW, 'f, r, n')},
u AS (SELECT 'faithfulness' AS metric, b.f AS baseline, c.f::DOUBLE AS current FROM b, c UNION ALL SELECT 'recall', b.r, c.r::DOUBLE FROM b, c UNION ALL SELECT 'ndcg', b.n, c.n::DOUBLE FROM b, c)
SELECT metric, baseline, current, round(current - baseline, 6) AS delta, round(baseline - current, 6) > 0.1 AS failed FROM u"""
SQL["rerank_tiers"] = f"""WITH {_BM25},
c AS (SELECT query_id, chunk_id, rank AS prior, (length(substr(d.text, 1, 1500)) % 97 + length(b.text) % 7) / 100 AS rerank_score
  FROM bm JOIN documents d ON d.doc_id = chunk_id JOIN benchmark b ON b.item_id = query_id WHERE rank <= 20),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, prior) AS rank FROM c)
SELECT query_id, chunk_id, prior, rerank_score, rank, 'flashrank' AS method FROM r WHERE rank <= 5"""


def _letters(x: str) -> str:
    return f"[length({x})::DOUBLE, 1 + length({x}) - length(replace({x}, 'a', '')), 1 + length({x}) - length(replace({x}, 'e', ''))]"


_QUESTION = _strip("lower(text)")
SQL["embed_tiers"] = f"""
WITH d AS (SELECT doc_id, {_letters("coalesce(text, '')")}::DOUBLE[] AS v FROM documents), q AS (SELECT item_id, {_letters(_QUESTION)}::DOUBLE[] AS v FROM benchmark),
s AS (SELECT item_id AS query_id, doc_id AS chunk_id, round(list_cosine_similarity(q.v, d.v), 4) AS score FROM q, d),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s) SELECT * FROM r WHERE rank <= 10"""
SQL["benchmark_systems"] = f"""WITH {_BM25}, {_HASHED},
al AS (SELECT item_id AS query_id, doc_id AS chunk_id FROM benchmark, documents),
dz AS (SELECT query_id, chunk_id, coalesce(score, 0.0) AS score FROM al LEFT JOIN hs USING (query_id, chunk_id)),
sz AS (SELECT query_id, chunk_id, coalesce(score, 0.0) AS score FROM al LEFT JOIN sc USING (query_id, chunk_id)),
d50 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM dz QUALIFY rank <= 50),
s50 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM sz QUALIFY rank <= 50), {_fused("d50", "s50", 50)}
SELECT 'dense' AS system, query_id, chunk_id, rank FROM d50 WHERE rank <= 10 UNION ALL SELECT 'bm25', query_id, chunk_id, rank FROM s50 WHERE rank <= 10
UNION ALL SELECT 'hybrid', query_id, chunk_id, rank FROM hy WHERE rank <= 10"""
