"""DuckDB SQL fragments for the oracle queries.

The oracles restate each job in plain SQL over the same supplied tables, so the
driver can compare both engines row for row. Fragments here are shared
building blocks (derived inputs, the canonical-URL expression).
"""

from __future__ import annotations

ISO_FMT = "'%Y-%m-%dT%H:%M:%S.%gZ'"

URL_RE = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]+)([^?#]*)(\?[^#]*)?(#.*)?$"

COLLECTED = f"""
collected AS (
  SELECT date '2024-01-01' + CAST(page_id % 30 AS INTEGER) AS edition_date,
         2 * page_id AS seq,
         regexp_extract(html, '<title>([^<]*)</title>', 1) AS title,
         CASE WHEN page_id % 4 = 0 THEN '' ELSE regexp_extract(html, '<title>([^<]*)</title>', 1) END AS snippet,
         url,
         lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#:]+)', 1)) AS source,
         timestamp '2024-01-01' + page_id * INTERVAL 1 MINUTE AS published_at,
         CASE WHEN page_id % 3 = 0 THEN NULL ELSE (page_id * 37) % 211 END AS points
  FROM pages
  UNION ALL
  SELECT date '2024-01-01' + CAST(page_id % 30 AS INTEGER),
         2 * page_id + 1,
         regexp_extract(html, '<title>([^<]*)</title>', 1),
         'late',
         url || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'utm_source=hn',
         lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#:]+)', 1)),
         timestamp '2024-01-01' + page_id * INTERVAL 1 MINUTE,
         (page_id * 53) % 307
  FROM pages
  WHERE page_id % 5 = 0 AND NOT contains(url, '#')
)"""


def _enc(x: str) -> str:
    # form encoding: DuckDB's url_encode keeps '~' and encodes '*' and ' ' as %2A / %20
    return f"replace(replace(replace(url_encode({x}), '%20', '+'), '%2A', '*'), '~', '%7E')"


# F1 percent-encode sets (see functions/text.py), as SQL string literals.
_PATH_ENC_SQL = "'[^\\x21\\x24-\\x3B\\x3D\\x40-\\x5F\\x61-\\x7A\\x7C\\x7E]'"
_QUERY_ENC_SQL = "'[^\\x21\\x24-\\x26\\x28-\\x3B\\x3D\\x3F-\\x7E]'"


def _pct_sql(x: str, cls: str) -> str:
    """Percent-encode the characters of ``cls`` in ``x``, one character at a time."""
    each = f"lambda ch: CASE WHEN regexp_matches(ch, {cls}) THEN url_encode(ch) ELSE ch END"
    return (f"(CASE WHEN regexp_matches({x}, {cls}) "
            f"THEN array_to_string(list_transform(string_split({x}, ''), {each}), '') ELSE {x} END)")


def _resolve_path_sql(path: str) -> str:
    """Dot segments and backslashes of an http(s) path, as F1 resolves them."""
    p = f"replace({path}, '\\', '/')"
    segs = f"string_split(substr({p}, 2), '/')"
    popped = "CASE WHEN len(acc) > 0 THEN acc[1:len(acc) - 1] ELSE acc END"
    step = (f"lambda acc, x, i: CASE "
            f"WHEN lower(x) IN ('..', '.%2e', '%2e.', '%2e%2e') THEN "
            f"(CASE WHEN i = len({segs}) THEN list_append({popped}, '') ELSE {popped} END) "
            f"WHEN lower(x) IN ('.', '%2e') THEN (CASE WHEN i = len({segs}) THEN list_append(acc, '') ELSE acc END) "
            f"ELSE list_append(acc, x) END")
    resolved = f"'/' || array_to_string(list_reduce({segs}, {step}, CAST([] AS VARCHAR[])), '/')"
    return f"(CASE WHEN regexp_matches({p}, '/(\\.|%2[eE])') THEN {resolved} ELSE {p} END)"


def canonical_sql(u: str) -> str:
    """SQL expression for the canonical URL of expression ``u`` (same rules as F1)."""
    t = f"trim({u})"
    c = f"regexp_replace({t}, '[\\t\\n\\r]', '', 'g')"
    m = f"regexp_extract({c}, '{URL_RE}', ['scheme', 'hostport', 'path', 'query'])"
    scheme = f"lower(({m}).scheme)"
    hostport = f"lower(({m}).hostport)"
    host = f"regexp_extract({hostport}, '^(.*?)(:[0-9]*)?$', 1)"
    digits = f"regexp_extract({hostport}, ':([0-9]*)$', 1)"
    port_num = f"(CASE WHEN length(ltrim({digits}, '0')) <= 5 THEN TRY_CAST({digits} AS INTEGER) END)"
    port = f"(CASE WHEN {digits} = '' THEN '' ELSE CAST({port_num} AS VARCHAR) END)"
    port_ok = f"coalesce({digits} = '' OR {port_num} <= 65535, false)"
    default = f"(({scheme} = 'http' AND {port} = '80') OR ({scheme} = 'https' AND {port} = '443'))"
    authority = f"CASE WHEN {port} <> '' AND NOT {default} THEN {host} || ':' || {port} ELSE {host} END"
    path = _pct_sql(_resolve_path_sql(f"CASE WHEN ({m}).path = '' THEN '/' ELSE ({m}).path END"), _PATH_ENC_SQL)
    query = f"({m}).query"
    pairs = f"list_filter(string_split(substr({query}, 2), '&'), lambda p: p <> '')"
    key = "url_decode(split_part(p, '=', 1))"
    track = f"(lower(left({key}, 4)) = 'utm_' OR {key} IN ('ref', 'fbclid'))"
    value = "CASE WHEN contains(p, '=') THEN substr(p, strpos(p, '=') + 1) ELSE '' END"
    ser = f"{_enc(key)} || '=' || {_enc(f'url_decode({value})')}"
    kept = f"array_to_string(list_transform(list_filter({pairs}, lambda p: NOT {track}), lambda p: {ser}), '&')"
    drops = f"len(list_filter({pairs}, lambda p: {track})) > 0"
    newq = (f"CASE WHEN {drops} THEN (CASE WHEN {kept} = '' THEN '' ELSE '?' || {kept} END) "
            f"ELSE {_pct_sql(query, _QUERY_ENC_SQL)} END")
    rebuilt = f"regexp_replace({scheme} || '://' || {authority} || {path} || {newq}, '/$', '')"
    is_web = f"(regexp_matches({c}, '{URL_RE}') AND {scheme} IN ('http', 'https') AND {host} <> '' AND {port_ok})"
    return f"(CASE WHEN {is_web} THEN {rebuilt} ELSE {t} END)"


def iso(ts: str) -> str:
    return f"strftime({ts}, {ISO_FMT})"
