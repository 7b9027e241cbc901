"""SQL for DuckDB that gives the rows of the operators that SQL can express."""

from __future__ import annotations

from nearfield.llm import quality, urls

_WORD = r"[^\x20\x09-\x0D]+"

#: One letter of a SHA-1 in base32: five hexadecimal digits are four letters.
_LETTER = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(sha1(p), 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1)::INT, 1)"

OP2 = f"""
WITH d AS (SELECT page_id, encode(coalesce(html, '')) AS p FROM pages),
     e AS (SELECT page_id, p, min(page_id) OVER (PARTITION BY p) AS first, array_to_string([{_LETTER} for i in range(32)], '') AS digest FROM d)
SELECT page_id, octet_length(p)::BIGINT AS payload_bytes, digest AS payload_digest, CASE WHEN page_id > first OR page_id IS NULL AND first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first OR page_id IS NULL THEN first END AS refers_to
FROM e
"""


def _closure(edges: str) -> str:
    """Recursive query named reach (a, b) over the symmetric edges (a, b) of ``edges``."""
    return f"both_ways AS (SELECT a, b FROM {edges} UNION SELECT b, a FROM {edges}), reach AS (SELECT a, b FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a)"


def _shingle_sql(size: int, percent: int) -> str:
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{urls.UPPER}', '{urls.LOWER}'), '{_WORD}') AS w FROM documents),
     s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= {size} THEN [array_to_string(w[i:i + {size - 1}], ' ') for i in range(1, len(w) - {size - 2})] WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
     u AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
     p AS (SELECT l.doc_id AS a, r.doc_id AS b, any_value(l.n) AS m, any_value(r.n) AS n, count(*) AS k FROM u l JOIN u r ON l.x = r.x AND l.doc_id < r.doc_id GROUP BY 1, 2),
     links AS (SELECT a, b FROM p WHERE 100 * k >= {percent} * (m + n - k)),
     {_closure("links")},
     least AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT doc_id, len(g)::BIGINT AS n_shingles, least(doc_id, coalesce(l.b, doc_id)) AS component_id, doc_id <= coalesce(l.b, doc_id) AS kept FROM s LEFT JOIN least l ON l.a = doc_id
"""


OP7 = _shingle_sql(4, 80)

OP8 = f"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
                     AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x != 0)) > 0),
     links AS (SELECT l.vec_id AS a, r.vec_id AS b FROM v l JOIN v r ON l.vec_id < r.vec_id AND len(l.e) = len(r.e) WHERE list_cosine_similarity(l.e, r.e) >= 0.95),
     {_closure("links")},
     least AS (SELECT a, min(b) AS b FROM reach GROUP BY a), n AS (SELECT a, count(*) AS n FROM both_ways GROUP BY a)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(vec_id, coalesce(l.b, vec_id)) AS component_id, vec_id <= coalesce(l.b, vec_id) AS kept
FROM embeddings LEFT JOIN least l ON l.a = vec_id LEFT JOIN n ON n.a = vec_id
"""


def _host(u: str) -> str:
    return f"coalesce(translate(regexp_extract({u}, '^.*?://([^/?#]*)', 1, 's'), '{urls.UPPER}', '{urls.LOWER}'), '')"


def _path(u: str) -> str:
    return f"coalesce(regexp_extract({u}, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '')"


def _key(u: str) -> str:
    return f"CASE WHEN contains({u}, '://') THEN {_host(u)} || regexp_extract({u}, '^.*?://[^/?#]*([^#]*)', 1, 's') END"


_RULES = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in urls.RULES)
_FITS = "(x.host = r.h OR ends_with(x.host, '.' || r.h)) AND starts_with(x.path, r.p)"
_LINK = r"""nullif(regexp_extract(regexp_extract(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>'), '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1), '')"""
_SENT = r"""nullif(regexp_extract(regexp_extract(html, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>'), '(?is)\burl\s*=\s*["'']?([^"''\s>;]+)', 1), '')"""

OP4 = f"""
WITH RECURSIVE rules(v, h, p) AS (VALUES {_RULES}),
     t AS (SELECT url, coalesce({_LINK}, {_SENT}) AS go FROM pages WHERE contains(url, '://')),
     f AS (SELECT url, go, regexp_extract(url, '^(.*?)://', 1, 's') AS scheme, regexp_extract(url, '^(.*?://[^/?#]*)', 1, 's') AS root, regexp_extract(url, '^(.*?://[^/?#]*)', 1, 's') || regexp_replace({_path("url")}, '[^/]*$', '') AS base FROM t WHERE go IS NOT NULL),
     g AS (SELECT url, CASE WHEN contains(go, '://') THEN go WHEN starts_with(go, '//') THEN scheme || ':' || go WHEN starts_with(go, '/') THEN root || go WHEN ends_with(base, '/') THEN base || go ELSE base || '/' || go END AS target FROM f),
     links AS (SELECT {_key("url")} AS a, {_key("target")} AS b, url, target FROM g WHERE {_key("url")} != {_key("target")}),
     {_closure("links")},
     least AS (SELECT a, least(a, min(b)) AS c FROM reach GROUP BY a),
     nodes AS (SELECT a AS key, url AS u FROM links UNION ALL SELECT b, target FROM links),
     one AS (SELECT key, min(u) AS u FROM nodes GROUP BY key),
     x1 AS (SELECT key, {_host("u")} AS host, {_path("u")} AS path FROM one),
     n AS (SELECT x.key, arg_max(r.v, (len(r.h) + len(r.p)) * 2 + (r.v = 'allow')::INT) AS v FROM x1 x LEFT JOIN rules r ON {_FITS} GROUP BY x.key),
     c AS (SELECT l.c, bool_or(n.v = 'block') AS blocked, coalesce(bool_or(n.v = 'allow'), false) AS allowed FROM n JOIN least l ON l.a = n.key GROUP BY l.c),
     bad AS (SELECT l.a AS key FROM least l JOIN c USING (c) WHERE blocked AND NOT allowed),
     x0 AS (SELECT row_number() OVER () AS id, page_id, {_host("url")} AS host, {_path("url")} AS path, {_key("url")} AS key FROM pages),
     best AS (SELECT x.id, arg_max(struct_pack(rule := r.h || r.p, v := r.v), (len(r.h) + len(r.p)) * 2 + (r.v = 'allow')::INT) AS b FROM x0 x JOIN rules r ON {_FITS} GROUP BY x.id)
SELECT page_id, host, path, b.rule AS rule, coalesce(b.v, CASE WHEN key IN (SELECT key FROM bad) THEN 'block' END, 'allow') AS verdict FROM x0 LEFT JOIN best USING (id)
"""


def _quote(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_SHORT = rf"^[\x20\x09-\x0D]*(?:[^\x20\x09-\x0D]+[\x20\x09-\x0D]+){{{quality.SHORT_LINE - 1}}}[^\x20\x09-\x0D]"
_NOT_SEPARATOR = quality.SEPARATOR.replace("[", "[^")
_NAVIGATION = f"^(?:{_NOT_SEPARATOR}{{1,{quality.PART}}}{quality.SEPARATOR}){{2,}}{_NOT_SEPARATOR}{{0,{quality.PART}}}$"
_BAD = (
    f"((regexp_matches(x, {_quote(quality.BOILERPLATE)}) AND length(x) - length(regexp_replace(x, {_quote(quality.BOILERPLATE)}, '', 'g')) >= {quality.MOST_BOILERPLATE} * length(x))"
    f" OR regexp_matches(x, {_quote(_NAVIGATION)})"
    f" OR (regexp_matches(x, '{_WORD}') AND NOT regexp_matches(x, {_quote(_SHORT)}) AND NOT regexp_matches(x, {_quote(quality.CLOSED)}))"
    f" OR length(x) - length(regexp_replace(x, {_quote(quality.SYMBOLS)}, '', 'g')) > {quality.MOST_SYMBOLS} * length(x))"
)

OP10 = f"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS t FROM documents),
     w AS (SELECT id, doc_id, t, regexp_extract_all(t, '{_WORD}') AS w, string_split(t, chr(10)) AS l FROM d),
     g AS (SELECT id, unnest(range(1, len(w) - 1)) AS i, unnest([w[k] || ' ' || w[k + 1] || ' ' || w[k + 2] for k in range(1, len(w) - 1)]) AS g FROM w WHERE len(w) > 2),
     r AS (SELECT id, i FROM g QUALIFY count(*) OVER (PARTITION BY id, g) > 1),
     n AS (SELECT id, count(DISTINCT i + k) AS n FROM r, range(3) y(k) GROUP BY id),
     c AS (SELECT w.id, doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, (length(t) - length(regexp_replace(t, '{quality.SYMBOLS}', '', 'g')))::BIGINT AS n_symbols,
                  [x for x in l if regexp_matches(x, '{_WORD}')] AS ink, l, [x for x in l if NOT {_BAD}] AS good, coalesce(n, 0) AS n_repeat_words
           FROM w LEFT JOIN n ON n.id = w.id),
     f AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, (len(ink) - len(list_distinct(ink)))::BIGINT AS n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND length(regexp_replace(array_to_string(good, chr(10)), '[\\x20\\x09-\\x0D]+', '', 'g')) >= {1 - quality.MOST_LOST} * word_chars AS kept, (len(l) - len(good))::BIGINT AS n_lines_removed
FROM f
"""

SQL = {"op2_warc": OP2, "op4_url_filters": OP4, "op7_minhash_near_dedup": OP7, "op8_embedding_near_dedup": OP8, "op10_quality_rules": OP10}
