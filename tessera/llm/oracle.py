"""Queries of this subpackage as SQL for DuckDB, written independently of the Spark code,
and the pipeline as their chain.

The others (personal data with its trained classifier, language model, quality
classifier) are tested by brute force or held-out accuracy.
"""

from __future__ import annotations

from . import quality_rules, secret_scan, url_filters

_WORD = "[^\\x20\\x09-\\x0D]+"


def _words(x: str) -> str:
    return f"regexp_extract_all(coalesce({x}, ''), '{_WORD}')"


def _op2_ctes(table: str) -> str:
    """CTE v2: the row's number `id`, its measures and verdict."""
    languages = quality_rules.COMMON
    classes = [
        f"len(regexp_extract_all(text, '{p.replace(chr(92) + chr(34), chr(34)).replace(chr(39), chr(39) * 2)}'))"
        for _, p in quality_rules.CLASSES[:-1]
    ]
    # RE2 has no intersection of classes: symbols are printable ASCII less the rest.
    classes.append("len(regexp_extract_all(text, '[\\x21-\\x7E]')) - len(regexp_extract_all(text, '[a-zA-Z0-9.,;:!?''\"()-]'))")
    counted = " ".join(
        f"WHEN lang = '{code}' THEN list_transform([{', '.join(repr(w) for w in own)}], lambda c: len(list_filter(lw, lambda x: x = c)))"
        for code, own in languages.items()
    )
    first = next(iter(languages.values()))
    width, common = len(classes) + 1, len(first) + 1

    def shares(counts: str, total: str) -> str:
        return (
            f"CASE WHEN {total} > 0 THEN list_transform(list_append({counts}, {total} - list_sum({counts})), lambda c: c / {total}) END"
        )

    def distance(p: str, q: str, n: int) -> str:
        terms = []
        for i in range(1, n + 1):
            a, b = f"{p}[{i}]", f"{q}[{i}]"
            for x, y in ((a, b), (b, a)):
                terms.append(f"CASE WHEN {x} > 0 THEN {x} * log2(2 * {x} / ({x} + {y})) ELSE 0 END")
        return f"sqrt(greatest(0, ({' + '.join(terms)}) / 2))"

    means = ", ".join(f"avg(chars[{i}])" for i in range(1, width + 1))
    word_means = ", ".join(f"avg(common[{i}])" for i in range(1, common + 1))
    names = ", ".join(repr(x) for x in languages)
    return f"""
d AS (SELECT row_number() OVER () AS id, doc_id, lang, coalesce(text, '') AS text, {_words("text")} AS w FROM {table}),
g AS (SELECT id, i, array_to_string(w[i:i + 4], chr(1)) AS gram FROM d, unnest(range(1, len(w) - 3)) AS u(i)),
r AS (SELECT id, i FROM (SELECT *, count(*) OVER (PARTITION BY id, gram) AS n FROM g) WHERE n > 1),
c AS (SELECT id, count(DISTINCT i + k) AS n FROM r, (SELECT unnest(range(5)) AS k) GROUP BY id),
f AS (SELECT d.id, doc_id, CASE WHEN lang IN ({names}) THEN lang ELSE 'other' END AS lang, text, w, coalesce(c.n, 0) AS n_repeat_words,
        list_transform(w, lambda x: lower(x)) AS lw, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS li
      FROM d LEFT JOIN c ON c.id = d.id),
m AS (SELECT id, doc_id, lang, len(w) AS n_words, length(text) AS n_chars, length(array_to_string(w, '')) AS word_chars,
        len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, len(li) - len(list_distinct(li)) AS n_dup_lines, n_repeat_words,
        len(w) < 10 OR 100 * n_repeat_words > 20 * len(w) AS base_failed,
        [{", ".join(classes)}] AS rawc,
        CASE {counted} ELSE list_transform([{', '.join(repr(w) for w in first)}], lambda c: len(list_filter(lw, lambda x: x = c))) END AS raww FROM f),
s AS (SELECT *, {shares("rawc", "n_chars")} AS chars, {shares("raww", "n_words")} AS common FROM m),
e AS (SELECT lang, [{means}] AS cr, [{word_means}] AS wr FROM s WHERE NOT base_failed GROUP BY lang),
j AS (SELECT s.*, CASE WHEN n_chars >= {quality_rules.MIN_CHARS} THEN {distance("chars", "cr", width)} END AS cd,
        CASE WHEN n_words >= {quality_rules.MIN_WORDS} THEN {distance("common", "wr", common)} END AS wd FROM s LEFT JOIN e USING (lang)),
v2 AS (SELECT id, doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(cd, 0) <= {quality_rules.MAX_CHAR_DISTANCE} AND coalesce(wd, 0) <= {quality_rules.MAX_WORD_DISTANCE} AS kept,
  round(cd, 6) AS char_distance, round(wd, 6) AS word_distance FROM j)"""


def _op2() -> str:
    return f"WITH {_op2_ctes('documents')} SELECT * EXCLUDE (id) FROM v2"


def _op5() -> str:
    # RE2 takes the plain forms of the possessive patterns.
    plain = {k: p.replace("}+", "}").replace("++", "+") for k, p in secret_scan.RULES.items()}
    parts, kinds = [], list(plain)
    holds = {"assign": "length(regexp_extract(m[k], '{p}', 1)) >= 6", "access": "length(m[k]) >= 20"}
    for n, (kind, pattern) in enumerate(plain.items()):
        p = pattern.replace("'", "''")
        held = holds.get(kind, "true").format(p=p) if kind != "assign" else holds["assign"].replace("{p}", p)
        parts.append(
            f"""SELECT id, {n} AS n, '{kind}' AS kind, list_sum(list_transform(g[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: length(x))), 0) AS s, length(m[k]) AS l
      FROM (SELECT id, string_split_regex(text, '{p}') AS g, regexp_extract_all(text, '{p}') AS m FROM d WHERE regexp_matches(text, '{p}')), unnest(range(1, len(m) + 1)) AS u(k) WHERE {held}"""
        )
    base = kinds[: secret_scan.BASE]
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in base)
    zeros = ", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in base)
    text = "kind || ':' || s::BIGINT || ':' || (s + l)::BIGINT"
    return f"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text FROM documents),
f AS ({" UNION ALL ".join(parts)}),
a AS (SELECT id, {counts}, string_agg({text}, ',' ORDER BY s, n) FILTER (n < {secret_scan.BASE}) AS b, string_agg({text}, ',' ORDER BY s, n) AS spans FROM f GROUP BY id)
SELECT doc_id, {zeros}, sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (id)"""


def _op7_ctes(table: str) -> str:
    """CTE p7: doc_id and number of the lines to drop. Ids are distinct."""
    return f"""
d7 AS (SELECT doc_id, coalesce(text, '') AS text FROM {table}),
l7 AS (SELECT doc_id, i - 1 AS line, regexp_extract_all(string_split(text, chr(10))[i], '{_WORD}') AS w
      FROM d7, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS u(i)),
n7 AS (SELECT *, (doc_id, line) AS place, array_to_string(w, chr(1)) AS t FROM l7 WHERE len(w) >= 1),
x7 AS (SELECT *, min(place) OVER (PARTITION BY t) AS first FROM n7),
y7 AS (SELECT place, w, t FROM x7 WHERE place = first AND len(w) >= 5),
v7 AS (SELECT place, w, len(w) AS size, i, array_to_string(w[1:i - 1] || w[i + 1:], chr(1)) AS k FROM y7, unnest(range(1, len(w) + 1)) AS u(i)),
e7 AS (SELECT a.place FROM v7 a JOIN v7 b ON a.k = b.k AND a.i = b.i AND a.size = b.size AND b.place < a.place
      UNION SELECT a.place FROM v7 a JOIN y7 b ON a.k = b.t WHERE b.place < a.place
      UNION SELECT a.place FROM y7 a JOIN v7 b ON a.t = b.k WHERE b.place < a.place),
p7 AS (SELECT doc_id, line FROM x7 WHERE place <> first OR place IN (SELECT place FROM e7))"""


_OP7 = f"""WITH {_op7_ctes("documents")},
g7 AS (SELECT doc_id, count(*) AS n, string_agg(line::VARCHAR, ',' ORDER BY line) AS dropped FROM p7 GROUP BY doc_id)
SELECT doc_id, CASE WHEN text = '' THEN 0 ELSE len(string_split(text, chr(10))) END AS n_lines, coalesce(n, 0) AS n_dropped, coalesce(dropped, '') AS dropped
FROM d7 LEFT JOIN g7 USING (doc_id)"""

def _op8_ctes(table: str, width: int, num: int) -> str:
    """CTE m8: each row's id, its set's size, and its component."""
    return f"""
w8 AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS w FROM {table}),
s8 AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + {width - 1}], ' ') AS g FROM w8, unnest(range(1, greatest(2, len(w) - {width - 2}))) AS u(i) WHERE len(w) > 0),
n8 AS (SELECT doc_id, count(*) AS n FROM s8 GROUP BY doc_id),
c8 AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s8 a JOIN s8 b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
k8 AS (SELECT a, b FROM c8 JOIN n8 x ON x.doc_id = a JOIN n8 y ON y.doc_id = b WHERE 100 * c >= {num} * (x.n + y.n - c)),
r8 AS (SELECT doc_id AS v, doc_id AS root FROM {table} UNION SELECT k8.b, r8.root FROM r8 JOIN k8 ON k8.a = r8.v WHERE r8.root < k8.b),
m8 AS (SELECT d.doc_id, coalesce(n, 0) AS n_shingles, m.root AS component_id
  FROM {table} d LEFT JOIN n8 USING (doc_id) JOIN (SELECT v, min(root) AS root FROM r8 GROUP BY v) m ON m.v = d.doc_id)"""


_OP8 = f"WITH RECURSIVE {_op8_ctes('documents', 3, 90)} SELECT * FROM m8"


def _op1_ctes(table: str) -> str:
    """CTE o1: every overlap. Words that agree are counted on each diagonal of each pair,
    without any seeds."""
    words = "regexp_extract_all(translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-zA-Z\\x{{80}}-\\x{{10FFFF}}]+')"
    return f"""
d1 AS (SELECT row_number() OVER () AS row1, doc_id, {words.format('text')} AS w FROM {table}),
i1 AS (SELECT item_id, {words.format('text')} AS w FROM benchmark),
a1 AS (SELECT row1, doc_id, i, w[i] AS x FROM d1, unnest(range(1, len(w) + 1)) AS u(i)),
b1 AS (SELECT item_id, len(w) AS n, i, w[i] AS x FROM i1, unnest(range(1, len(w) + 1)) AS u(i)),
g1 AS (SELECT row1, doc_id, item_id, n, a1.i - b1.i AS shift, count(*) AS same FROM a1 JOIN b1 USING (x) GROUP BY ALL),
h1 AS (SELECT *, row_number() OVER (PARTITION BY row1, item_id ORDER BY same DESC, shift) AS k FROM g1 WHERE same >= CASE WHEN n < 7 THEN n ELSE (n + 1) // 2 END),
o1 AS (SELECT doc_id, item_id, same AS matched_words, n AS item_words, greatest(shift, 0) AS first_word, same / n AS overlap FROM h1 WHERE k = 1)"""


_OP1 = f"WITH {_op1_ctes('documents')} SELECT * FROM o1"

def _op9_ctes(table: str) -> str:
    """CTE z9: each row's share of the mix."""
    return f"""
d9 AS (SELECT doc_id, source, {_words("text")} AS w FROM {table}),
e9 AS (SELECT doc_id, source, len(w) AS size,
        CASE WHEN len(w) > 0 THEN 0.5 + 0.5 * len(list_distinct(w)) / len(w) ELSE 1.0 END AS q,
        (('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT + 0.5) / 4503599627370496.0 AS u FROM d9),
s9 AS (SELECT source, sum(size)::BIGINT AS source_size FROM e9 GROUP BY source),
o9 AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS wt, 2 * source_size AS lim FROM s9),
b9 AS (SELECT *, (SELECT sum(size) FROM e9) * 1.5::DOUBLE AS budget,
        coalesce(sum(lim) OVER (ORDER BY lim / wt, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
        sum(wt) OVER (ORDER BY lim / wt, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS after FROM o9),
v9 AS (SELECT arg_min((budget - before) / after, lim / wt) FILTER ((budget - before) / after <= lim / wt) AS level FROM b9),
t9 AS (SELECT source, source_size, least(wt * coalesce(level, 1e300), lim)::DOUBLE AS target FROM o9, v9),
f9 AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM t9),
x9 AS (SELECT doc_id, e9.source AS source, size, source_size, target, epochs, floor(target - epochs * source_size + 1e-6)::BIGINT AS rest,
        sum(size) OVER (PARTITION BY e9.source ORDER BY -ln(u) / q, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto
      FROM e9 JOIN f9 ON e9.source IS NOT DISTINCT FROM f9.source),
z9 AS (SELECT doc_id, source, size, source_size, round(target, 6) AS target, epochs, size * epochs + least(size, greatest(0, rest - (upto - size)))::BIGINT AS taken FROM x9)"""


_OP9 = f"WITH {_op9_ctes('documents')} SELECT doc_id, size, source_size, target, taken FROM z9"


def pipeline_sql() -> str:
    """The five stages of the pipeline, each over what the one before kept."""
    return f"""
WITH RECURSIVE {_op2_ctes("documents")},
q1 AS (SELECT * FROM documents WHERE doc_id IN (SELECT doc_id FROM v2 WHERE kept)), {_op7_ctes("q1")},
r7 AS (SELECT doc_id, list(line) AS gone FROM p7 GROUP BY doc_id),
t7 AS (SELECT q1.* REPLACE (CASE WHEN gone IS NULL THEN text ELSE
         array_to_string(list_filter(string_split(text, chr(10)), lambda x, i: NOT list_contains(gone, i - 1)), chr(10)) END AS text), gone FROM q1 LEFT JOIN r7 USING (doc_id)),
q2 AS (SELECT * FROM t7 WHERE gone IS NULL OR regexp_matches(text, '{_WORD}')), {_op8_ctes("q2", 5, 80)},
q3 AS (SELECT * FROM q2 WHERE doc_id IN (SELECT doc_id FROM m8 WHERE component_id = doc_id)), {_op1_ctes("q3")},
q4 AS (SELECT * FROM q3 WHERE doc_id NOT IN (SELECT doc_id FROM o1)), {_op9_ctes("q4")}
SELECT doc_id, source, size, source_size, target, epochs, taken FROM z9"""


def _hex(x: str, at: int) -> str:
    return f"('0x' || substr(md5({x}), {at}, 3))::INT"


_FOUND = (
    "regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?(\\[[0-9A-Fa-f:.]+\\]|[^/?#:@]+)', 1)"
    " || regexp_extract(url, '^([A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)+\\.?)(?:[:/?#].*)?$', 1)"
)
_HOST = f"regexp_replace(lower({_FOUND}), '\\.+$', '')"
_ADDRESS = "'^[0-9]{1,3}(\\.[0-9]{1,3}){3}$|^\\['"
_OP10 = f"""
WITH c AS (SELECT page_id, nullif({_HOST}, '') AS host, DATE '2024-01-01' + (page_id % 366)::INT AS fetched FROM pages),
h AS (SELECT DISTINCT host, string_split(host, '.') AS p FROM c WHERE host IS NOT NULL),
n AS (SELECT DISTINCT host AS asked, array_to_string(p[i:], '.') AS host FROM h, unnest(range(1, CASE WHEN regexp_matches(host, {_ADDRESS}) THEN 2 ELSE greatest(2, len(p)) END)) AS u(i) WHERE len(p) - i < {url_filters.MOST_LABELS}),
k AS (SELECT DISTINCT host, CASE WHEN {_hex("host", 4)} % 2 = 0 THEN 'ads' ELSE 'malware' END AS list, {_hex("host", 7)} % 200 AS d,
        {_hex("host", 10)} % 100 + 1 AS st, {_hex("host", 13)} % 4 AS kind FROM n WHERE {_hex("host", 1)} % 5 < 2),
i AS (SELECT host, list, DATE '2024-01-01' + d AS since, CASE WHEN kind > 0 THEN DATE '2024-01-01' + (d + st) END AS until FROM k
      UNION ALL SELECT host, list, DATE '2024-01-01' + (d + 2 * st), NULL FROM k WHERE kind = 3),
m AS (SELECT c.page_id, i.list, i.host AS entry, i.since, row_number() OVER (PARTITION BY c.page_id ORDER BY length(i.host) DESC, i.list, i.host, i.since) AS r
      FROM c JOIN n ON n.asked = c.host JOIN i ON i.host = n.host AND i.since <= fetched AND (until IS NULL OR fetched < until))
SELECT c.page_id, c.host, fetched, entry IS NOT NULL AS blocked, list, entry, since FROM c LEFT JOIN m ON m.page_id = c.page_id AND r = 1"""


_OP13 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_words("text")} AS w FROM documents),
g AS (SELECT r, doc_id, i, array_to_string(w[i:i + 19], ' ') AS s FROM d, unnest(range(1, len(w) - 18)) AS u(i)),
f AS (SELECT r, i FROM (SELECT *, min((doc_id, i)) OVER (PARTITION BY s) AS first FROM g) WHERE (doc_id, i) > first),
c AS (SELECT DISTINCT r, i + k AS i FROM f, (SELECT unnest(range(20)) AS k)),
p AS (SELECT r, i, w[i] AS word FROM d, unnest(range(1, len(w) + 1)) AS u(i)),
k AS (SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS kept FROM p ANTI JOIN c USING (r, i) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (r)"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_decontaminate": _OP1,
        "op2_quality_divergence": _op2(),
        "op5_secrets": _op5(),
        "op7_line_dedup": _OP7,
        "op8_ngram_jaccard": _OP8,
        "op9_mix_sources": _OP9,
        "op10_url_filters": _OP10,
        "op13_substring_dedup": _OP13,
    }
