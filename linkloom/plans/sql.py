"""The queries in DuckDB's SQL, put together from common table expressions. Written apart from the Spark code, to check it."""

from __future__ import annotations

import re

from ..functions import rules
from . import answers, captured, fixtures
from .golden import GOLDEN

_SPLIT = r"'(?s)^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$'"
_ATTR = r"""'(?is)(href|src|action|data-href|data-url|data-src|poster|onclick)\s*=\s*(?:"(.*?)"|''(.*?)'')'"""


def names(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def part(url: str, n: int) -> str:
    return f"regexp_extract({url}, {_SPLIT}, {n})"


def decode(x: str) -> str:
    return f"url_decode(replace({x}, '+', ' '))"


def encode(x: str) -> str:
    return f"replace(url_encode({x}), '%20', '+')"


def pairs(q: str) -> str:
    value = r"CASE WHEN contains(p, '=') THEN regexp_replace(p, '(?s)^[^=]*=', '') ELSE '' END"
    return f"list_transform(list_filter(string_split({q}, '&'), lambda p: p <> ''), lambda p: {{'k': {decode('split_part(p, ' + chr(39) + '=' + chr(39) + ', 1)')}, 'v': {decode(value)}}})"


def sort_query(q: str) -> str:
    named = f"list_transform({pairs(q)}, lambda kv: {{'k': regexp_replace(kv.k, '^(amp;)+', '', 'i'), 'v': kv.v}})"
    kept = f"list_sort(list_filter({named}, lambda kv: kv.v <> '' AND kv.k <> '' AND kv.k NOT IN ({names(rules.TRACKING_KEYS)})))"
    return f"coalesce(array_to_string(list_transform({kept}, lambda kv: {encode('kv.k')} || '=' || {encode('kv.v')}), '&'), '')"


def whole(scheme: str, netloc: str, path: str, query: str, fragment: str) -> str:
    tail = lambda sign, x: f"CASE WHEN {x} = '' THEN '' ELSE '{sign}' || {x} END"
    return f"{scheme} || '://' || {netloc} || {path} || {tail('?', query)} || {tail('#', fragment)}"


def seeds(source: str) -> str:
    """CTE q: id, line, url and site_key of seed lines (id, line)."""
    own = "(s = 'https' AND port = '443') OR (s = 'http' AND port = '80') OR port = ''"
    path = "CASE WHEN " + part("c", 3) + " = '' THEN '/' ELSE " + part("c", 3) + " END"
    return f"""
q0 AS (SELECT id, line, CASE WHEN trim(line) = '' OR trim(line) LIKE '#%' THEN NULL WHEN regexp_matches(trim(line), '^[a-zA-Z][a-zA-Z0-9+.-]*://') THEN trim(line) ELSE 'https://' || trim(line) END AS c FROM {source}),
q1 AS (SELECT *, lower({part('c', 1)}) AS s, lower(regexp_extract({part('c', 2)}, '^(?:.*@)?([^:]*)(?::(.*))?$', 1)) AS h, regexp_extract({part('c', 2)}, '^(?:.*@)?([^:]*)(?::(.*))?$', 2) AS port FROM q0),
q2 AS (SELECT *, CASE WHEN {own} THEN h ELSE h || ':' || port END AS netloc, s IN ('http', 'https') AND h <> '' AS good FROM q1),
q AS (SELECT id, line, CASE WHEN good THEN {whole('s', 'netloc', f'({path})', '(' + sort_query(part('c', 4)) + ')', '(' + part('c', 5) + ')')} END AS url,
  CASE WHEN good THEN netloc END AS site_key, CASE WHEN good THEN h END AS host, CASE WHEN good THEN s || '://' || netloc END AS origin FROM q2)"""


#: pg: captured pages with their site.
PAGES = f"""{seeds("(SELECT page_id AS id, url AS line FROM pages)")},
sites0 AS (SELECT site_key, min_by(origin, id) AS site_origin FROM q WHERE url IS NOT NULL GROUP BY site_key),
pg AS (SELECT id AS page_id, q.site_key, host AS site_host, site_origin, q.url AS source_url, html
  FROM q JOIN sites0 USING (site_key) JOIN pages ON page_id = id WHERE q.url IS NOT NULL)"""

_CLEANED = r"""regexp_replace(regexp_extract(trim({x}), '^[^\s\x0B\x1C-\x1F"''<>\x{{80}}-\x{{10FFFF}}]*'), '[).,;:!?\]}}]+$', '')"""


def clean(x: str) -> str:
    """A link cut out of text; null if nothing useful is left."""
    c = _CLEANED.format(x=x)
    tag = f"lower(regexp_replace(regexp_replace(regexp_replace(c, '^(\\./|\\.\\./)+', ''), '[?#].*$', ''), '^/+|/+$', '', 'g')) IN ({names(rules.HTML_TAGS)}) AND c NOT LIKE '//%'"
    number = "c LIKE '/%' AND length(c) <= 4 AND regexp_matches(regexp_replace(c, '^/+|/+$', '', 'g'), '^[0-9]+$')"
    return f"(SELECT CASE WHEN regexp_matches(c, '^(?i)({rules.PSEUDO_SCHEMES}|blob:)') OR regexp_matches(c, '[{{}}\\[\\]|]') OR ({number}) OR ({tag}) OR c IN ('', '/', '//', '?', './', '../') THEN NULL ELSE c END FROM (SELECT {c} AS c))"


def links(pages: str = "pg") -> str:
    """CTE raw: source_url, raw_url, raw_kind of every link of pages, repeats kept."""
    path = "CASE WHEN {0} = '' THEN '/' ELSE {0} END"
    r = "regexp_replace(" + path.format(part("t", 3)) + ", '/{2,}', '/', 'g')"
    other = path.format(part("t", 3))
    target = "CASE WHEN value LIKE '//%' THEN regexp_extract(source_url, '^[a-z]+:') || value WHEN value LIKE '/%' THEN regexp_extract(source_url, '^[a-z]+://[^/?#]*') || value WHEN regexp_matches(value, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN value WHEN value LIKE '?%' THEN regexp_extract(source_url, '^[^?#]*') || value ELSE regexp_replace(regexp_extract(source_url, '^[^?#]*'), '[^/]*$', '') || value END"
    return f"""
a0 AS (SELECT {pages}.*, unnest(regexp_extract_all(substr(html, 1, {rules.HTML_LIMIT}), {_ATTR}, 0)) AS m FROM {pages}),
a AS (SELECT * EXCLUDE (m), lower(regexp_extract(m, {_ATTR}, 1)) AS attr, trim(regexp_extract(m, {_ATTR}, 2) || regexp_extract(m, {_ATTR}, 3)) AS value FROM a0),
w0 AS (SELECT *, {target} AS t FROM a WHERE value <> '' AND attr <> 'onclick' AND regexp_matches(value, '[/.?=]')),
w1 AS (SELECT *, lower({part('t', 2)}) AS h FROM w0),
raw0 AS (
  SELECT site_key, site_host, site_origin, source_url, {clean('x')} AS raw_url, kind AS raw_kind FROM (
    SELECT *, unnest(regexp_extract_all(value, '(?i)https?://[^\\s"''<>]+')) AS x, 'absolute' AS kind FROM a
    UNION ALL SELECT *, unnest(regexp_extract_all(value, '(?:/|\\./|\\.\\./|\\?)[^\\s"''<>]+')), 'relative' FROM a
    UNION ALL SELECT *, unnest(regexp_extract_all(value, '#/[A-Za-z0-9_./?=&%-]+')), 'hash' FROM a)
  UNION ALL SELECT site_key, site_host, site_origin, source_url, {clean('x')}, 'absolute' FROM (SELECT *, unnest(regexp_extract_all(html, '(?i)https?://[^\\s"''<>]+')) AS x FROM {pages})
  UNION ALL SELECT site_key, site_host, site_origin, source_url, value, 'value' FROM a WHERE regexp_matches(value, '^(/|\\./|\\.\\./|\\?|#/)')
  UNION ALL SELECT site_key, site_host, site_origin, source_url,
    {whole("CASE WHEN h = site_host THEN split_part(site_origin, ':', 1) ELSE lower(" + part('t', 1) + ") END", 'h', f"(CASE WHEN h = site_host THEN {r} ELSE {other} END)", '(' + sort_query(part('t', 4)) + ')', '(' + part('t', 5) + ')')}, 'normalized' FROM w1
  UNION ALL SELECT site_key, site_host, site_origin, source_url, source_url, 'location' FROM {pages}),
raw AS (SELECT * FROM raw0 WHERE raw_url IS NOT NULL)"""


_UNSAFE = f"""(list_bool_or(list_transform(string_split(lower(path), '/'), lambda s: s IN ({names(rules.UNSAFE_SEGMENTS)})))
  OR coalesce((SELECT k || '=' || v IN ({names('='.join(p) for p in rules.UNSAFE_PAIRS)}) OR v NOT IN ({names(rules.HARMLESS_VALUES)}) FROM (
    SELECT lower(list_first(hits).k) AS k, lower(list_first(hits).v) AS v FROM (SELECT list_filter({{pairs}},
      lambda kv: lower(kv.k) || '=' || lower(kv.v) IN ({names('='.join(p) for p in rules.UNSAFE_PAIRS)}) OR lower(kv.k) IN ({names(rules.DESTRUCTIVE_KEYS)})) AS hits))), false))"""


def unsafe() -> str:
    return _UNSAFE.replace("{pairs}", pairs("query"))


def found(raw: str = "raw", name: str = "f") -> str:
    """CTE f: distinct links with url, same_site, queueable and page_kind, for sites of no special family."""
    target = "CASE WHEN regexp_matches(raw_url, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN raw_url WHEN raw_url LIKE '//%' THEN regexp_extract(source_url, '^[a-z]+:') || raw_url WHEN raw_url LIKE '/%' THEN regexp_extract(source_url, '^[a-z]+://[^/?#]*') || raw_url WHEN raw_url LIKE '?%' THEN regexp_extract(source_url, '^[^?#]*') || raw_url ELSE regexp_replace(regexp_extract(source_url, '^[^?#]*'), '[^/]*$', '') || raw_url END"
    path = "CASE WHEN {0} = '' THEN '/' ELSE {0} END".format(part("t", 3))
    suffix = "|".join(rules.NON_HTML_SUFFIXES)
    static = "|".join(rules.STATIC_PREFIXES)
    file = r"regexp_extract(lower(path), '([^/]+)/*$', 1)"
    return f"""
{name}0 AS (SELECT DISTINCT site_key, site_host, site_origin, source_url, raw_url, {target} AS t FROM {raw}),
{name}1 AS (SELECT *, lower({part('t', 2)}) AS host, {path} AS path0, {sort_query(part('t', 4))} AS query, {part('t', 5)} AS fragment, lower({part('t', 1)}) AS scheme0 FROM {name}0),
{name}2 AS (SELECT * EXCLUDE (path0, scheme0), host = site_host AS same_site, CASE WHEN host = site_host THEN regexp_replace(path0, '/{{2,}}', '/', 'g') ELSE path0 END AS path,
  CASE WHEN host = site_host THEN split_part(site_origin, ':', 1) ELSE scheme0 END AS scheme FROM {name}1 WHERE scheme0 IN ('http', 'https') AND host <> ''),
{name}3 AS (SELECT *, {whole('scheme', 'host', 'path', 'query', 'fragment')} AS url,
  same_site AND NOT regexp_matches(lower(path), '\\.({suffix})$') AND NOT regexp_matches(lower(path), '^/({static})(/|$)')
  AND NOT {unsafe()} AND NOT starts_with(lower(path), '{rules.UPLOAD_PREFIX}') AND {file} NOT IN ({names(rules.ENDPOINT_FILENAMES)}) AND NOT contains(lower(query), 'aspxerrorpath=') AS queueable FROM {name}2),
{name} AS (SELECT *, CASE WHEN NOT queueable THEN 'resource' WHEN path = '/' AND query = '' AND fragment = '' THEN 'root' ELSE 'page' END AS page_kind FROM {name}3)"""


def nodes(f: str = "f", name: str = "n") -> str:
    return f"""
{name} AS (SELECT site_key, url, bool_or(same_site) AS same_site, bool_or(queueable) AS queueable, 1 AS first_depth, min(source_url) AS first_source, 'dom' AS first_method,
  count(*) AS seen_count, min(page_kind) AS page_kind FROM {f} GROUP BY site_key, url)"""


_FOUND = f"{PAGES},{links()},{found()}"
_NODES = f"{_FOUND},{nodes()}"
_E = "e AS (SELECT DISTINCT site_key, source_url, url AS target_url, same_site, queueable FROM f)"
FOLDER = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', '_', 'g'), '_')"


def visited(pages: str = "pg") -> str:
    return f"vraw AS (SELECT site_key, site_host, site_origin, source_url, source_url AS raw_url FROM {pages}),{found('vraw', 'vf')},\nvis AS (SELECT DISTINCT site_key, url FROM vf)"


def share(n: int, of: int, prefix: str) -> str:
    """CTEs of the links of pages whose ids leave n when divided by of, all names with a prefix."""
    body = f"p_ AS (SELECT * FROM pg WHERE page_id % {of} = {n}),{links('p_')},{found()},{nodes()}"
    for name in ("a0", "raw0", "raw", "w0", "w1", "f0", "f1", "f2", "f3", "f", "n", "a", "p_"):
        body = re.sub(rf"(?<![\w.'])({name})(?= AS \(|$)", f"{prefix}{name}", body)
        body = re.sub(rf"(?<=FROM )({name})(?![\w])", f"{prefix}{name}", body)
        body = re.sub(rf"(?<=SELECT )({name})(?=\.\*)", f"{prefix}{name}", body)
    return body


_EVEN_ODD = f"""{PAGES},{share(0, 2, 'x_')},{share(1, 2, 'y_')},
pe AS (SELECT * FROM pg WHERE page_id % 2 = 0),{visited('pe')},
wanted AS (SELECT DISTINCT site_key, url FROM y_f WHERE queueable),
lacks AS (SELECT * FROM wanted WHERE (site_key, url) NOT IN (SELECT (site_key, url) FROM x_n WHERE queueable)),
open AS (SELECT * FROM x_n WHERE queueable AND (site_key, url) NOT IN (SELECT (site_key, url) FROM vis))"""

_SAVED = f"""{_NODES},
pe AS (SELECT * FROM pg WHERE page_id IN (SELECT user_id FROM events WHERE event_type <> 'error')),{visited('pe')},
open AS (SELECT * FROM n WHERE queueable AND (site_key, url) NOT IN (SELECT (site_key, url) FROM vis))"""

#: found_by: the nodes that each delta of a state found, a row a delta and node.
_DELTAS = f"""{share(0, 3, 'd0_')},{share(1, 3, 'd1_')},{share(2, 3, 'd2_')},
found_by AS ({' UNION ALL '.join(f'SELECT {n} AS delta, * FROM d{n}_n' for n in range(3))})"""

_LOG = """log AS (SELECT event_id AS visit_id, user_id AS page_id, 'http://e/' || user_id AS requested_url, CASE WHEN user_id % 4 = 0 THEN '<direct>' ELSE 'p' || (user_id % 4) END AS proxy,
  event_type <> 'error' AS ok, CASE WHEN event_type <> 'error' THEN '' WHEN event_id % 3 = 0 THEN 'Error: Target closed' WHEN event_id % 3 = 1 THEN 'Timeout 30000ms exceeded' ELSE 'Protocol Error (x)' END AS error,
  epoch_us(ts) AS started, epoch_us(ts) / 1000000.0::DOUBLE + value / 8 AS finished, trunc(round(value * 8) / 64 * 1000)::BIGINT AS duration_ms FROM events)"""

_SUMMARY = f"""{_NODES}, {_E}, {_LOG},
c AS (SELECT site_key, count(*) AS discovered_urls, count_if(queueable) AS queueable_urls, count_if(same_site) AS same_site_urls, count_if(NOT queueable) AS external_or_non_queueable_urls, bool_or(seen_count > 2 AND queueable) AS waits FROM n GROUP BY site_key),
ce AS (SELECT site_key, count(*) AS edges FROM e GROUP BY site_key),
cv AS (SELECT site_key, count(*) AS visited_pages, count_if(ok) AS visit_ok, count_if(NOT ok) AS visit_failed FROM log JOIN (SELECT page_id, site_key FROM pg) USING (page_id) GROUP BY site_key),
summary AS (SELECT {FOLDER.format('s.site_key')} AS site_folder, site_host, 'generic' AS site_family, NOT coalesce(waits, false) AS completed,
  {', '.join(f'coalesce({x}, 0) AS {x}' for x in ('discovered_urls', 'queueable_urls', 'same_site_urls', 'external_or_non_queueable_urls', 'edges', 'visited_pages', 'visit_ok', 'visit_failed'))}
  FROM (SELECT DISTINCT site_key, site_host FROM pg) s LEFT JOIN c USING (site_key) LEFT JOIN ce USING (site_key) LEFT JOIN cv USING (site_key))"""


def literal(value) -> str:
    if value is None:
        return "NULL"
    return str(value).lower() if isinstance(value, bool) else str(value) if isinstance(value, int) else names([value])


def own(x: str) -> str:
    """A made-up text as it is on the sites of page page_id."""
    return f"replace(regexp_replace({x}, '{fixtures.HOSTS}', 'p' || page_id || '.\\1', 'gi'), '{{n}}', page_id::VARCHAR)"


def keyed(columns: str, rows: list[tuple]) -> str:
    """Rows of (name type, ...) for each page, texts on the page's own sites."""
    fields = [c.split() for c in columns.split(", ")]
    shown = ", ".join(f"CAST({own(f) if t.lower() in ('string', 'varchar') else f} AS {t}) AS {f}" for f, t in fields)
    return f"SELECT page_id, {shown} FROM (SELECT page_id FROM pages), (VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)}) AS t({', '.join(f for f, _ in fields)})"


def values(name: str) -> str:
    """Made-up rows of all pages as a subquery."""
    return f"({keyed(*fixtures.TABLES[name])})"


def golden(name: str) -> str:
    """Results that were worked out by hand from the rules, on the sites of each page."""
    columns, rows = GOLDEN[name]
    found = keyed(columns, rows)
    return found if columns.startswith("id ") else f"SELECT * EXCLUDE (page_id) FROM ({found})"


_REACH = """WITH RECURSIVE links AS (
  SELECT 'c' || o_custkey AS src, 'o' || o_orderkey AS dst FROM orders UNION SELECT 'o' || l_orderkey, 's' || l_suppkey FROM lineitem
  UNION SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION SELECT 'r' || n_regionkey, 'n' || n_nationkey FROM nation
), walk AS (
  SELECT 'c' || c_custkey AS node, 0 AS depth FROM customer
  UNION SELECT dst, depth + 1 FROM walk JOIN links ON src = node WHERE depth < 8
) SELECT node, min(depth) AS depth FROM walk GROUP BY node"""


_SEGMENTS = """WITH RECURSIVE v AS (
  SELECT event_id AS visit_id, epoch_us(ts) AS started, epoch_us(ts) + floor(value * 125000)::BIGINT AS fin FROM events
), p AS (
  SELECT visit_id, fin, row_number() OVER (ORDER BY fin, visit_id) AS place FROM v UNION ALL SELECT NULL, min(started), 0 FROM v
), t AS (
  SELECT a.place, min(b.place) AS timed FROM p a ASOF JOIN (SELECT fin, min(place) AS place FROM p WHERE place > 0 GROUP BY fin) b ON a.fin + 1800000000 <= b.fin GROUP BY a.place
), hop AS (
  SELECT place, least(place + 10, timed) AS next FROM p LEFT JOIN t USING (place) WHERE least(place + 10, timed) <= (SELECT max(place) FROM p)
), saves AS (
  SELECT 0::BIGINT AS segment, 0::BIGINT AS place UNION ALL SELECT segment + 1, next FROM saves JOIN hop USING (place)
)
SELECT visit_id, segment, next IS NOT NULL AS saved FROM p ASOF JOIN saves ON p.place > saves.place LEFT JOIN hop ON hop.place = saves.place WHERE p.place > 0"""

_DEQUE = """WITH RECURSIVE log AS (
  SELECT event_id, CASE WHEN event_type IN ('purchase', 'signup') THEN 'take' WHEN event_type = 'error' THEN 'front' ELSE 'back' END AS op, row_number() OVER (ORDER BY ts, event_id) AS i FROM events
), sim AS (
  SELECT 0::BIGINT AS i, []::BIGINT[] AS dq, NULL::BIGINT AS event_id, NULL::BIGINT AS put_by
  UNION ALL SELECT l.i, CASE l.op WHEN 'back' THEN list_append(dq, l.event_id) WHEN 'front' THEN list_prepend(l.event_id, dq) ELSE dq[2:] END,
    CASE WHEN l.op = 'take' THEN l.event_id END, CASE WHEN l.op = 'take' THEN dq[1] END FROM sim JOIN log l ON l.i = sim.i + 1
)"""

_WALK = """WITH RECURSIVE walk AS (
  SELECT event_id, []::VARCHAR[] AS path, (repeat('{"at":"http://e/' || event_id || '","in":[null,', (event_id % 12)::INT) || coalesce(props, '{}') || repeat(']}', (event_id % 12)::INT))::JSON AS v FROM events
  UNION ALL SELECT event_id, list_append(walk.path, e.key), e.value FROM walk, json_each(walk.v) e WHERE json_type(walk.v) IN ('OBJECT', 'ARRAY')
) SELECT event_id, array_to_string(path, '/') AS path, CASE json_type(v) WHEN 'VARCHAR' THEN 'string' WHEN 'NULL' THEN 'null' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' ELSE 'number' END AS kind,
  CASE WHEN json_type(v) = 'NULL' THEN 'null' ELSE v->>'$' END AS value FROM walk WHERE v::VARCHAR IN ('{}', '[]') OR json_type(v) NOT IN ('OBJECT', 'ARRAY')"""


def oracle_sql() -> dict[str, str]:
    kind_rank = "CASE page_kind WHEN 'root' THEN 0 WHEN 'resource' THEN 4 ELSE 2 END"
    low = f"(starts_with(lower(path), '{rules.UPLOAD_PREFIX}') OR regexp_extract(lower(path), '([^/]+)/*$', 1) IN ({names(rules.LOW_PRIORITY_FILENAMES)}) OR list_has_any(string_split(lower(path), '/'), [{names(rules.LOW_PRIORITY_SEGMENTS)}]))::INT"
    deep = "len(list_filter(string_split(path, '/'), lambda s: s <> ''))"
    frontier = f"{_FOUND},{visited()},\nnext AS (SELECT site_key, url, 1 AS depth, min(source_url) AS discovered_from, 'dom' AS discovery_method, 0 AS attempts FROM f WHERE queueable AND (site_key, url) NOT IN (SELECT (site_key, url) FROM vis) GROUP BY site_key, url)"
    sample = "SELECT site_key, {item}count(*) AS total, array_to_string(list_sort(list(url))[1:20], ' ') AS sample FROM {rows} GROUP BY site_key"
    out = {
        "site_counts": f"WITH {_NODES}, {_E} SELECT site_key, count(*) AS discovered_urls, count_if(queueable) AS queueable_urls, count_if(same_site) AS same_site_urls, count_if(NOT queueable) AS external_or_non_queueable_urls, any_value(edges) AS edges FROM n JOIN (SELECT site_key, count(*) AS edges FROM e GROUP BY site_key) USING (site_key) GROUP BY site_key",
        "sites": f"WITH {PAGES} SELECT site_key, any_value(site_host) AS site_host, any_value(site_origin) AS site_origin, 'generic' AS site_family, {FOLDER.format('site_key')} AS site_folder, array_to_string(list_sort(list_distinct(list_append(list(source_url), any_value(site_origin) || '/'))), ' ') AS seed_urls FROM pg GROUP BY site_key",
        "site_folder": f"WITH {PAGES} SELECT DISTINCT site_key, {FOLDER.format('site_key')} AS site_folder FROM pg",
        "url_normalize": f"WITH {PAGES}, vraw AS (SELECT page_id, site_key, site_host, site_origin, source_url, source_url AS raw_url FROM pg),{found('vraw', 'vf')} SELECT page_id, url FROM pg JOIN (SELECT DISTINCT source_url, url FROM vf) USING (source_url)",
        "url_sort_query": f"SELECT page_id AS id, {sort_query(part('url', 4))} AS sorted FROM pages UNION ALL SELECT -100 * page_id - id, {sort_query('query')} FROM {values('queries')}",
        "seed_normalize": f"WITH {PAGES} SELECT id, url, site_key FROM q",
        "seed_normalize_cases": f"WITH {seeds('(SELECT 100 * page_id + id AS id, line FROM ' + values('seeds') + ')')} SELECT id, url, site_key FROM q",
        "title_truncate": r"SELECT page_id, CASE WHEN length(t) <= 40 THEN t ELSE substr(t, 1, 37) || '...' END AS title FROM (SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title>(.*?)</title>', 1), '\s+', ' ', 'g')) AS t FROM pages)",
        "links_extract": f"WITH {PAGES},{links()} SELECT source_url, raw_url, raw_kind, count(*) AS n FROM raw GROUP BY ALL",
        "link_clean": f"WITH {PAGES},{links()} SELECT DISTINCT page_id, value, {clean('value')} AS cleaned FROM a WHERE value <> ''",
        "links_same_site": f"WITH {_FOUND} SELECT source_url, raw_url, url, same_site FROM f",
        "links_queueable": f"WITH {_FOUND} SELECT source_url, raw_url, queueable FROM f",
        "should_visit": f"WITH {_FOUND} SELECT source_url, raw_url, queueable AS should_visit FROM f",
        "unsafe_urls": f"SELECT page_id, id, {unsafe()} AS unsafe FROM (SELECT page_id, id, {part('raw', 3)} AS path, {sort_query(part('raw', 4))} AS query FROM {values('unsafe')})",
        "method_priority": f"SELECT page_id, method, CASE WHEN m = 'seed' THEN 0 WHEN m = 'dom' THEN 1 WHEN m LIKE 'api:%' THEN 2 WHEN m LIKE 'click%' OR m LIKE 'popup:%' OR m LIKE 'selector:%' THEN 3 WHEN m LIKE 'response:document%' THEN 4 WHEN m LIKE 'response:script%' THEN 5 WHEN m LIKE 'response:json%' THEN 6 WHEN m LIKE 'response:xhr%' OR m LIKE 'response:fetch%' THEN 7 WHEN m LIKE 'download:%' THEN 9 ELSE 8 END AS rank FROM (SELECT page_id, method, lower(method) AS m FROM {values('methods')})",
        "prioritized_links": f"WITH {_FOUND} SELECT source_url, raw_url, url, row_number() OVER (PARTITION BY source_url ORDER BY {low}, {kind_rank}, {deep}, url, raw_url) AS place FROM f",
        "edges": f"WITH {_FOUND}, {_E} SELECT site_key, source_url, target_url, 1 AS depth, 'dom' AS method, same_site, queueable, '' AS note FROM e",
        "nodes": f"WITH {_NODES} SELECT * FROM n",
        "page_kind_histogram": f"WITH {_NODES} SELECT site_key, page_kind, count(*) AS n FROM n WHERE queueable GROUP BY site_key, page_kind",
        "frontier_next": f"WITH {frontier} SELECT * FROM next",
        "frontier_limit": f"WITH {frontier} SELECT * FROM next ORDER BY depth, site_key, url LIMIT 100",
        "bfs_reachability": _REACH,
        "json_walk": _WALK,
        "saved_sites": f"""WITH {_SUMMARY}, ends AS (SELECT min(site_folder) AS first, max(site_folder) AS last FROM summary), r AS (SELECT {FOLDER.format('site_key')} AS site_folder, count(*) AS links, count(DISTINCT url) AS urls FROM n GROUP BY ALL)
            SELECT summary.*, CASE WHEN site_folder = first THEN 0 ELSE coalesce(links, 0) END AS links, CASE WHEN site_folder = first THEN 0 ELSE coalesce(urls, 0) END AS urls, CASE WHEN site_folder = last THEN 2 ELSE 0 END AS broken_lines
            FROM summary LEFT JOIN r USING (site_folder), ends""",
        "resumed_nodes": f"""WITH {PAGES},{_DELTAS},{visited()}, every AS (SELECT site_key, url, seen_count, first_depth, queueable, page_kind FROM found_by UNION ALL SELECT DISTINCT site_key, url, 1, 0, queueable, page_kind FROM vf)
            SELECT site_key, url, sum(seen_count)::BIGINT AS seen_count, min(first_depth) AS first_depth, bool_or(queueable) AS queueable, min(page_kind) AS page_kind FROM every GROUP BY site_key, url""",
        "resumed_frontier": f"""WITH {_SAVED},{_DELTAS}, araw AS (SELECT site_key, site_host, site_origin, source_url, source_url AS raw_url FROM pg),{found('araw', 'af')}, own AS (SELECT DISTINCT page_id, pg.site_key, v.url FROM pg JOIN (SELECT DISTINCT source_url, url FROM af) v USING (source_url)),
            fs AS (SELECT site_key, url, min((delta, first_source)) AS first FROM found_by GROUP BY site_key, url),
            queue AS (SELECT site_key, url, coalesce(max(n) FILTER (n < 2), max(n)) AS attempts FROM (SELECT site_key, url, (page_id % 3)::INT AS n FROM own) GROUP BY site_key, url)
            SELECT o.site_key, o.url, CASE WHEN queue.url IS NULL THEN 1 ELSE 0 END AS depth, CASE WHEN queue.url IS NULL THEN fs.first[2] ELSE o.url END AS discovered_from, CASE WHEN queue.url IS NULL THEN 'dom' ELSE 'seed' END AS discovery_method, coalesce(queue.attempts, 0) AS attempts
            FROM open o JOIN fs USING (site_key, url) LEFT JOIN queue USING (site_key, url)""",
        "run_plan": f"""WITH {PAGES}, k AS (SELECT site_key, count(*) AS n, min(page_id) AS first FROM pg WHERE page_id % 4 < 3 GROUP BY site_key),
            fresh AS (SELECT site_key, count(DISTINCT source_url) AS new_seeds FROM pg WHERE (site_key, source_url) NOT IN (SELECT (site_key, source_url) FROM pg WHERE page_id % 4 < 3) GROUP BY site_key)
            SELECT s.site_key, CASE WHEN k.n IS NULL THEN 'start' WHEN n % 4 = 3 THEN 'unfinished' WHEN first % 5 = 0 THEN 'policy' WHEN new_seeds > 0 THEN 'seeds' ELSE 'skip' END AS decision, coalesce(new_seeds, 0) AS new_seeds
            FROM (SELECT DISTINCT site_key FROM pg) s LEFT JOIN k USING (site_key) LEFT JOIN fresh USING (site_key)""",
        "save_segments": _SEGMENTS,
        "run_ticks": f"""WITH s AS ({_SEGMENTS}), {_LOG}, c AS (SELECT segment, count(*) AS new_visits, count_if(ok) AS new_ok, count_if(NOT ok) AS new_failed FROM log JOIN s USING (visit_id) GROUP BY segment)
            SELECT *, (sum(new_visits) OVER (ORDER BY segment))::BIGINT AS visits, (sum(new_ok) OVER (ORDER BY segment))::BIGINT AS ok FROM c""",
        "worker_totals": f"""WITH {PAGES}, {_LOG}, w AS (SELECT page_id % 64 AS worker, count(DISTINCT site_key) AS sites FROM pg GROUP BY ALL),
            r AS (SELECT page_id % 64 AS worker, arg_max(error LIKE '%Target closed' OR error LIKE 'Protocol Error%', visit_id) AS lost FROM log GROUP BY ALL), a AS (SELECT *, coalesce(lost, true) AS bad FROM w LEFT JOIN r USING (worker))
            SELECT count(*) AS workers, count_if(bad) AS failed_workers, sum(sites)::BIGINT AS sites, coalesce(sum(sites) FILTER (WHERE bad), 0)::BIGINT AS sites_of_failed FROM a""",
        "response_routing": captured.ROUTING,
        "response_links": captured.ALL_LINKS,
        "deque_taken": f"{_DEQUE} SELECT sim.event_id, put_by, e.user_id AS page_id, CASE log.op WHEN 'front' THEN 'front' WHEN 'back' THEN 'back' END AS came FROM sim LEFT JOIN events e ON e.event_id = put_by LEFT JOIN log ON log.event_id = put_by WHERE sim.event_id IS NOT NULL",
        "deque_waiting": f"{_DEQUE}, left_over AS (SELECT unnest(dq) AS put_by, unnest(range(1, len(dq) + 1)) AS place FROM sim ORDER BY i DESC LIMIT (SELECT len(dq) FROM sim ORDER BY i DESC LIMIT 1)) SELECT place, put_by, e.user_id AS page_id, (log.op = 'back')::INT AS side FROM left_over JOIN events e ON e.event_id = put_by JOIN log ON log.event_id = put_by",
        "dispatch_order": f"""WITH {_FOUND},{visited()}, own AS (SELECT source_url, any_value(url) AS start_url FROM vf GROUP BY source_url),
            it AS (SELECT site_key, url, any_value(path) AS path, min(({low}, {kind_rank})) AS kind, (site_key, url) IN (SELECT (site_key, url) FROM vis) AS start FROM f WHERE queueable GROUP BY site_key, url),
            rk AS (SELECT *, row_number() OVER (PARTITION BY site_key ORDER BY kind, CASE WHEN start THEN 0 ELSE 1 END, {deep}, url) AS p FROM it),
            par AS (SELECT f.site_key, f.url, min(s.p) AS parent FROM f JOIN own USING (source_url) JOIN rk s ON s.site_key = f.site_key AND s.url = start_url AND s.start WHERE f.queueable GROUP BY f.site_key, f.url),
            ord AS (SELECT rk.*, CASE WHEN start THEN p ELSE greatest(p, parent) END AS gate FROM rk LEFT JOIN par USING (site_key, url) WHERE start OR parent IS NOT NULL)
            SELECT site_key, url, row_number() OVER (PARTITION BY site_key ORDER BY gate, CASE WHEN gate = p THEN 0 ELSE 1 END, p) AS place FROM ord""",
        "coverage_missing": f"WITH {_EVEN_ODD} SELECT site_key, 'linked' AS category, url FROM lacks",
        "coverage_samples": f"WITH {_EVEN_ODD} {sample.format(item='', rows='lacks')}",
        "verification": f"""WITH {_EVEN_ODD}, v0 AS ({sample.format(item='', rows='lacks')}), v1 AS (SELECT site_key, count(*) AS expected FROM wanted GROUP BY site_key), v2 AS ({sample.format(item='', rows='open')})
            SELECT site_key, 'linked' AS item, expected, coalesce(total, 0) AS total, coalesce(sample, '') AS sample FROM v1 LEFT JOIN v0 USING (site_key)
            UNION ALL SELECT site_key, 'unvisited_queueable', NULL, total, sample FROM v2 UNION ALL SELECT site_key, 'frontier', NULL, total, sample FROM v2""",
        "unvisited_queueable": f"WITH {_SAVED} SELECT site_key, url FROM open",
        "resume_requeue": f"WITH {_SAVED} SELECT site_key, url, 1 AS depth, first_source AS discovered_from, 'dom' AS discovery_method, 0 AS attempts FROM open",
        "resume_equivalence": f"WITH {_SAVED} SELECT 'nodes' AS part, site_key, url FROM n UNION ALL SELECT 'visited', site_key, url FROM vis UNION ALL SELECT 'frontier', site_key, url FROM open",
        "json_links": f"WITH {answers.LINKS} SELECT * FROM lk",
        "json_items": f"WITH {answers.LINKS} SELECT * FROM lk WHERE method LIKE 'api:GetIssueinfoList%'",
        "year_issue_tree": f"WITH {answers.LINKS} SELECT * FROM lk WHERE method = 'api:GetYearVolumeTree:search'",
        "pagination_plan": answers.pagination(2),
        "pagination_plan_all": answers.pagination(),
        "answer_coverage": answers.COVERAGE,
        "new_seeds": f"WITH {PAGES} SELECT DISTINCT source_url AS url FROM pg WHERE source_url NOT IN (SELECT source_url FROM pg WHERE page_id % 2 = 0)",
        "nodes_merged": f"WITH {PAGES},{share(0, 2, 'x_')},{share(1, 2, 'y_')} SELECT site_key, url, sum(seen_count)::BIGINT AS seen_count, min(first_depth) AS first_depth FROM (SELECT * FROM x_n UNION ALL SELECT * FROM y_n) GROUP BY site_key, url",
        "global_urls": f"WITH {_NODES} SELECT DISTINCT url FROM n WHERE url <> ''",
        "global_links": f"WITH {_NODES} SELECT {FOLDER.format('site_key')} AS site_folder, site_key AS site_host, 'generic' AS site_family, url, same_site, queueable, page_kind, first_depth FROM n",
        "sites_summary": f"WITH {_SUMMARY} SELECT * FROM summary",
        "batch_summary": f"WITH {_SUMMARY} SELECT count(*) AS sites_total, count_if(completed) AS sites_completed FROM summary",
        "visits_transport_errors": f"WITH {_LOG} SELECT visit_id, error FROM log WHERE contains(lower(error), 'target closed') OR contains(lower(error), 'protocol error')",
        "visits_by_proxy": f"WITH {_LOG} SELECT proxy, count(*) AS visits, count_if(ok) AS ok, count_if(NOT ok) AS failed, count_if(contains(lower(error), 'target closed') OR contains(lower(error), 'protocol error')) AS transport_errors, sum(duration_ms)::BIGINT AS duration_ms FROM log GROUP BY proxy",
        "visit_attempts": f"WITH {_LOG} SELECT visit_id, row_number() OVER (PARTITION BY requested_url ORDER BY started, finished, visit_id) AS attempt FROM log",
        "retry_candidates": f"WITH {_LOG}, t AS (SELECT *, row_number() OVER (PARTITION BY requested_url ORDER BY started, finished, visit_id) AS attempts FROM log) SELECT requested_url, attempts FROM t WHERE NOT ok AND attempts < 4",
        "new_nodes_feed": f"WITH {_NODES} SELECT site_key, url, same_site, queueable, first_depth, first_source, first_method, page_kind FROM n",
        "new_nodes_stream": f"WITH {_NODES} SELECT site_key, url, same_site, queueable, first_depth, first_source, first_method, page_kind FROM n",
        "crawl_levels": f"WITH {_FOUND},{visited()} SELECT 0 AS depth, count(*) AS n FROM vis UNION ALL SELECT 1, count(*) FROM (SELECT DISTINCT site_key, url FROM f WHERE queueable AND (site_key, url) NOT IN (SELECT (site_key, url) FROM vis)) HAVING count(*) > 0",
    }
    return out | {name: golden(name) for name in GOLDEN}
