"""The registered queries in the SQL of another engine, written from the same rules.

The sample capture is spelled out once as common table expressions; every query
adds its own. Identifiers, bodies and headers are known from those expressions,
so the SQL states what the operators have to find in them.
"""

from __future__ import annotations

from callsight import fixed_values as fv

ORACLES: dict[str, str] = {}


def _list(names: list[str]) -> str:
    return ", ".join(f"'{name}'" for name in names)


def _normalized(url: str) -> str:
    """A URL without fragment and tracking parameters, parameters sorted, no trailing slash."""
    site = f"regexp_extract({url}, '^([a-z]+://[^/?#]+)', 1)"
    path = f"regexp_extract({url}, '^[a-z]+://[^/?#]+([^?#]*)', 1)"
    kept = (
        f"list_sort(list_filter(string_split(regexp_extract({url}, '[?]([^#]*)', 1), '&'), "
        f"lambda x: x <> '' AND NOT regexp_matches(split_part(x, '=', 1), '{fv.TRACKING_PARAM}')))"
    )
    return (
        f"{site} || CASE WHEN {path} IN ('', '/') THEN '/' ELSE regexp_replace({path}, '/+$', '') END || "
        f"CASE WHEN len({kept}) > 0 THEN '?' || array_to_string({kept}, '&') ELSE '' END"
    )


def _tracking_domains() -> str:
    return "|".join(
        domain.replace(".", "[.]") for _, kind, domains in fv.VENDORS if kind in fv.TRACKING_CATEGORIES for domain in domains
    )


CALLS = f"""
e AS (
  SELECT event_id, user_id, event_type, ts, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k,
         CAST(round(value * 100) AS BIGINT) AS c, epoch_us(ts) // 1000 AS started_at,
         CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 'before' ELSE 'after' END AS scan_id
  FROM events
),
e2 AS (
  SELECT e.*, p.url AS page_url, {_normalized('p.url')} AS page_norm,
         event_type = 'view' AND k % 10 = 4 AS gql, event_type = 'view' AND k = 13 AS failed, scan_id = 'after' AS aft
  FROM e JOIN pages p ON p.page_id = e.event_id % (SELECT count(*) FROM pages)
),
e3 AS (
  SELECT *,
    CASE WHEN gql THEN 'graphql' WHEN event_type = 'view' THEN 'products'
         WHEN event_type = 'click' AND k % 3 = 1 THEN 'assets' WHEN event_type = 'click' THEN 'track'
         WHEN event_type = 'signup' AND k % 5 = 0 THEN 'login' WHEN event_type = 'signup' THEN 'users'
         WHEN event_type = 'purchase' AND k % 4 = 3 THEN CASE WHEN aft THEN 'invoices' ELSE 'carts' END
         ELSE 'orders' END AS noun,
    CASE WHEN event_type = 'click' AND k % 3 = 0 THEN 'api.segment.io'
         WHEN event_type = 'click' AND k % 3 = 1 THEN 'cdn.other.example.net' ELSE 'shop.example.com' END AS host,
    CASE WHEN gql OR event_id % 2 = 1 THEN 0 WHEN event_type = 'purchase' THEN 2 ELSE 1 END AS ids,
    CASE WHEN gql THEN 'POST' WHEN event_type IN ('view', 'click') THEN 'GET'
         WHEN event_type IN ('signup', 'purchase') THEN 'POST' WHEN k % 2 = 0 THEN 'GET' ELSE 'DELETE' END AS method,
    CASE WHEN failed THEN 0 WHEN event_type = 'error' THEN [400, 401, 404, 500][k % 4 + 1]
         WHEN event_type = 'signup' THEN 201 ELSE 200 END AS status,
    ['new', 'paid', 'sent'][k % 3 + 1] AS state,
    CASE WHEN k = 8 THEN '' WHEN k = 7 THEN ',"total":"' || c || '"' ELSE ',"total":' || c END AS total_field
  FROM e2
),
calls AS (
  SELECT scan_id, event_id AS call_seq, method, host, noun, ids, status, k, c, user_id, event_type, started_at, gql, failed, aft, state,
    '/api/' || noun || CASE ids WHEN 0 THEN '' WHEN 1 THEN '/' || user_id ELSE '/' || user_id || '/items/' || event_id END AS path,
    '/api/' || noun || CASE ids WHEN 0 THEN '' WHEN 1 THEN '/{{id}}' ELSE '/{{id}}/items/{{id2}}' END AS url_pattern,
    'https://' || host AS origin,
    CASE WHEN failed OR event_type = 'click' THEN '' ELSE 'application/json' END AS mime_type,
    CASE WHEN k % 10 = 9 THEN 'image' WHEN k % 2 = 1 THEN 'xhr' ELSE 'fetch' END AS resource_type,
    CASE WHEN failed THEN page_url ELSE page_norm END AS triggered_by, page_url, page_norm,
    CASE WHEN gql AND k % 20 = 4 THEN
        '{{"query":"query Product($id: ID!) {{ item: product(id: $id) {{ name }} reviews(first: 3) @include(if: true)'
        || ' {{ id ...Stars }} }} fragment Stars on Review {{ stars }}","operationName":"Product","variables":{{"id":"' || user_id || '"}}}}'
      WHEN gql AND aft THEN '{{"query":"mutation AddItem {{ addItem(sku: \\"s{{1}}\\", qty: ' || k || ') {{ total }} }}"}}'
      WHEN gql THEN '{{"query":"{{ viewer {{ id }} __schema {{ types {{ name }} }} }}","user":' || user_id || '}}'
      WHEN event_type IN ('signup', 'purchase') THEN '{{"user":' || user_id || ',"email":"u' || user_id || '@example.com","amount":' || c || '}}'
    END AS request_body,
    CASE WHEN failed OR event_type = 'click' THEN NULL
      WHEN event_type = 'error' AND k % 4 = 3 AND aft THEN '{{"error":"e' || (k % 3) || '","trace":"stack trace ' || repeat('x', 6000) || '"}}'
      WHEN event_type = 'error' THEN '{{"error":"e' || (k % 3) || '"}}'
      WHEN gql THEN '{{"data":{{"product":{{"name":"p' || (k % 7) || '"}}}}}}'
      WHEN event_type = 'view' AND aft THEN '{{"id":' || event_id || total_field || ',"currency":"EUR","lines":[null,{{"sku":"s' || (k % 3) || '","qty":' || (k % 5) || '}}]}}'
      WHEN event_type = 'view' THEN '{{"id":' || event_id || ',"state":"' || state || '"' || total_field || ',"lines":[{{"sku":"s' || (k % 3) || '","qty":' || (k % 5) || '}}]}}'
      WHEN k = 18 THEN 'not available'
      ELSE '{{"id":' || event_id || ',"state":"' || state || '"' || total_field || '}}'
    END AS response_body,
    CASE WHEN k % 2 = 0 AND event_type <> 'signup' THEN 'sid=' || user_id END AS cookie,
    CASE WHEN k % 10 = 1 THEN 'ops' || k || '@example.com' END AS contact
  FROM e3
),
api AS (SELECT *, method || ' ' || url_pattern AS id FROM calls WHERE resource_type IN ('xhr', 'fetch'))
"""

KEY = "scan_id, method, url_pattern"

# Nearest rank: the value at position ceil(p * n) of the sorted values.
RANK = "list_sort(list({v}))[CAST(ceil({p}::DOUBLE * count({v})) AS BIGINT)]"

FIRST = f"""
first_call AS (
  SELECT {KEY}, arg_min(host, call_seq) AS host, arg_min(path, call_seq) AS path, arg_min(mime_type, call_seq) AS mime, bool_or(gql) AS gql
  FROM api GROUP BY ALL
),
cat AS (
  SELECT {KEY}, method || ' ' || url_pattern AS id,
    CASE WHEN regexp_matches(lower(path), '{fv.AUTH_PATH}') THEN 'auth-path'
      WHEN regexp_matches(host, '(^|[.])({_tracking_domains()})$') THEN 'analytics-host'
      WHEN regexp_matches(lower(path), '{fv.ANALYTICS_PATH}') THEN 'analytics-path'
      WHEN regexp_replace(host, '^www[.]', '') <> 'shop.example.com' THEN 'third-party'
      WHEN gql THEN 'graphql' WHEN method NOT IN ('GET', 'HEAD', 'OPTIONS') THEN 'mutation-method'
      WHEN contains(mime, 'json') THEN 'json-response' ELSE 'fallback' END AS heuristic
  FROM first_call
),
endpoints AS (
  SELECT cat.*, CASE heuristic WHEN 'auth-path' THEN 'authentication' WHEN 'analytics-host' THEN 'analytics' WHEN 'analytics-path' THEN 'analytics'
      WHEN 'third-party' THEN 'third-party' WHEN 'graphql' THEN 'graphql' WHEN 'mutation-method' THEN 'mutations'
      WHEN 'json-response' THEN 'data-fetching' ELSE 'uncategorized' END AS category,
    s.calls, s.statuses, s.p95_ms, s.p95_bytes, s.last_cookie, s.nosniff
  FROM cat JOIN (
    SELECT {KEY}, count(*) AS calls, list_sort(list(DISTINCT status)) AS statuses,
      {RANK.format(v='c', p=0.95)} AS p95_ms, {RANK.format(v='octet_length(encode(response_body))', p=0.95)} AS p95_bytes,
      arg_max(coalesce(cookie, ''), call_seq) <> '' AS last_cookie, arg_max(event_type, call_seq) = 'signup' AS nosniff
    FROM api GROUP BY ALL) s USING ({KEY})
)
"""


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(part.strip() for part in parts) + "\n"


# --- URLs ----------------------------------------------------------------------

# Unsafe path characters are percent-encoded one by one.
def _encoded(path: str) -> str:
    return (
        f"array_to_string(list_transform(regexp_extract_all({path}, '.'), "
        "lambda ch: CASE WHEN regexp_matches(ch, '[^!-~]|[\"#<>?`{}]') THEN url_encode(ch) ELSE ch END), '')"
    )


_PATH = "coalesce(nullif(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), ''), '/')"
_PAGE_PATTERN = (
    f"CASE WHEN {_PATH} = '/' THEN '/' ELSE "
    f"regexp_replace(regexp_replace({_PATH}, '/+$', ''), '/[0-9]+(/|$)', '/{{id}}\\1') END"
)

ORACLES["url_parts"] = f"""
SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host,
  {_PATH} AS path, regexp_extract(url, '[?]([^#]*)', 1) AS query
FROM pages"""

ORACLES["url_normalize"] = f"SELECT page_id, {_normalized('url')} AS normalized FROM pages"

ORACLES["url_pattern"] = f"""
SELECT page_id, pattern, CASE WHEN contains(pattern, '{{id}}') THEN 'id' ELSE '' END AS params,
  CASE WHEN regexp_matches(pattern, '^/.+/\\{{id\\}}') THEN regexp_replace(pattern, '/\\{{id\\}}.*$', '') ELSE pattern END AS root,
  contains(pattern, '{{id}}') AS has_param, ends_with(pattern, '/{{id}}') AS is_item,
  'get' || regexp_replace(regexp_replace(regexp_replace(pattern, '\\{{([^}}]+)\\}}', 'by-\\1', 'g'), '[^a-zA-Z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS operation_id
FROM (SELECT page_id, {_PAGE_PATTERN} AS pattern FROM pages)"""
ORACLES["url_pattern"] = ORACLES["url_pattern"].replace(
    "'get' || regexp_replace(", "'get' || regexp_replace(", 1
)

ORACLES["same_domain"] = f"""
SELECT page_id, regexp_replace(host, '^www[.]', '') = 'ththre.example.com' AS same_domain, FALSE AS private_host,
  regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) AS origin,
  CASE WHEN host = 'ththre.example.com' THEN '' ELSE host END || path || CASE WHEN query <> '' THEN '?' || query ELSE '' END AS label
FROM (SELECT page_id, url, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, {_PATH} AS path, regexp_extract(url, '[?]([^#]*)', 1) AS query FROM pages)"""

LINKS = f"""
hrefs AS (
  SELECT url, unnest(regexp_extract_all(html, '(?i)<a\\s[^>]*href\\s*=\\s*["'']([^"''#\\s]+)["''][^>]*>', 1)) AS href,
    generate_subscripts(regexp_extract_all(html, '(?i)<a\\s[^>]*href\\s*=\\s*["'']([^"''#\\s]+)["''][^>]*>', 1), 1) - 1 AS pos
  FROM pages
),
absolute AS (
  SELECT url, pos, href, CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN href
    WHEN starts_with(href, '/') THEN regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) || href
    ELSE regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) || regexp_replace({_PATH}, '[^/]*$', '') || href END AS raw
  FROM hrefs
),
links AS (
  SELECT url, pos, href, regexp_extract(raw, '^([a-z]+://[^/?#]+)', 1)
    || {_encoded("coalesce(nullif(regexp_extract(raw, '^[a-z]+://[^/?#]+([^?#]*)', 1), ''), '/')")}
    || CASE WHEN contains(raw, '?') THEN regexp_extract(raw, '([?][^#]*)', 1) ELSE '' END AS link
  FROM absolute
),
link_table AS (
  SELECT {_normalized('url')} AS source, {_normalized('link')} AS target, min(pos) AS pos,
    min(struct_pack(pos := pos, link := link)).link AS link FROM links GROUP BY ALL
)
"""

ORACLES["link_extract"] = _with(LINKS) + "SELECT url AS page_url, CAST(pos AS BIGINT) AS pos, href, link FROM links"

# --- filters and limits --------------------------------------------------------

_SCOPED = "(host = 'shop.example.com' OR (scan_id = 'before' AND host = 'cdn.other.example.net'))"
_EXCLUDED = (
    "CASE scan_id WHEN 'before' THEN regexp_matches(path, '^/api/users(/|$)|^/api/.*/items/.*$') "
    "ELSE regexp_matches(path, '^/api/orders(/|$)') END"
)

ORACLES["scope_filter"] = _with(CALLS) + f"SELECT scan_id, call_seq FROM calls WHERE {_SCOPED}"
ORACLES["capture_scope"] = _with(CALLS) + f"SELECT scan_id, count(*) AS calls FROM calls WHERE aft OR {_SCOPED} GROUP BY ALL"
ORACLES["path_exclude"] = _with(CALLS) + f"SELECT scan_id, call_seq FROM calls WHERE NOT {_EXCLUDED}"
ORACLES["redirect_guard"] = _with(CALLS) + f"""
SELECT scan_id, CASE WHEN NOT {_SCOPED} THEN 'host out of scope' WHEN {_EXCLUDED} THEN 'path excluded' ELSE 'kept' END AS reason, count(*) AS landings
FROM (SELECT DISTINCT scan_id, page_url, host, path, k FROM calls) GROUP BY ALL"""
ORACLES["target_guard"] = "SELECT page_id, 'accepted' AS verdict FROM pages"

_RANKED = "row_number() OVER (PARTITION BY scan_id ORDER BY call_seq)"
ORACLES["cap_calls"] = _with(CALLS) + f"SELECT scan_id, call_seq FROM calls QUALIFY {_RANKED} <= 2000"
ORACLES["dropped_calls"] = _with(CALLS) + "SELECT scan_id, greatest(count(*) - 2000, 0) AS dropped FROM calls GROUP BY ALL"

FRAMES = """
frames AS (
  SELECT conv_id AS conn_seq, CAST(turn AS BIGINT) AS frame_seq, CASE role WHEN 'user' THEN 'sent' ELSE 'received' END AS direction,
    role, turn, length(text) AS size,
    CASE WHEN role = 'system' THEN 'hello' WHEN turn % 5 = 4 THEN '{"type":"note","turn":' || turn || ',"chars":"' || length(text) || '"}'
      ELSE '{"type":"message","turn":' || turn || ',"chars":' || length(text) || '}' END AS payload,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS nth
  FROM conversations
)
"""
ORACLES["cap_frames"] = _with(FRAMES) + "SELECT conn_seq, frame_seq, direction, payload FROM frames WHERE nth <= 5"
ORACLES["conn_counters"] = _with(FRAMES) + """
SELECT conn_seq, count(*) AS frame_count, count(*) FILTER (direction = 'sent') AS sent_count,
  count(*) FILTER (direction = 'received') AS received_count, count(*) > 5 AS frames_truncated
FROM frames GROUP BY conn_seq"""

PAYLOADS = """
payloads AS (
  SELECT scan_id, call_seq, 0 AS part, 'request' AS kind, request_body AS body FROM calls WHERE request_body IS NOT NULL
  UNION ALL SELECT scan_id, call_seq, 1, 'response', response_body FROM calls WHERE response_body IS NOT NULL
)
"""
_RUNNING = "OVER (PARTITION BY scan_id ORDER BY call_seq, part ROWS UNBOUNDED PRECEDING)"
ORACLES["body_budget"] = _with(CALLS, PAYLOADS) + f"""
SELECT scan_id, call_seq, kind, fits AND length(body) > 60 AS truncated, CASE WHEN fits THEN body[1:60] ELSE '(dropped)' END AS body
FROM (SELECT *, sum(least(length(body), 60)) {_RUNNING} <= 150000 AS fits FROM payloads)"""
ORACLES["spill_budget"] = _with(CALLS, PAYLOADS) + f"""
SELECT scan_id, call_seq, 'payloads/' || kind || '-body-' || call_seq AS payload_key,
  sha256(regexp_replace(body, '"email":"[^"]*"', '"email":"{fv.REDACTED}"', 'g')) AS digest
FROM payloads WHERE length(body) > 60 QUALIFY sum(length(body)) {_RUNNING} <= 150000"""

ORACLES["resumed_calls"] = ORACLES["cap_calls"]
ORACLES["resumed_bodies"] = ORACLES["body_budget"]
ORACLES["resumed_state"] = _with(CALLS) + """
SELECT scan_id, 'https://shop.example.com/' AS seed_url, min(started_at) AS started_at, count(*) AS calls, max(call_seq) AS last_seq,
  (sum(least(coalesce(length(request_body), 0), 60)) + sum(least(coalesce(length(response_body), 0), 60)))::BIGINT AS stored_chars,
  (coalesce(sum(length(request_body)) FILTER (length(request_body) > 60), 0)
    + coalesce(sum(length(response_body)) FILTER (length(response_body) > 60), 0))::BIGINT AS spilled_chars, 0::BIGINT AS sockets
FROM calls GROUP BY scan_id"""

ORACLES["recent_pages"] = f"""
SELECT host, page_id, host || path || CASE WHEN query <> '' THEN '?' || query ELSE '' END AS label, row_number() OVER w AS position
FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, {_PATH} AS path, regexp_extract(url, '[?]([^#]*)', 1) AS query FROM pages)
WINDOW w AS (PARTITION BY host ORDER BY page_id DESC) QUALIFY position <= 3"""

ORACLES["pacing_audit"] = _with(CALLS) + """
SELECT origin, call_seq, started_at, started_at - lag(started_at) OVER w AS gap_ms,
  coalesce(started_at - lag(started_at) OVER w < 120000, FALSE) AS too_soon,
  i * 120000 + max(started_at - i * 120000) OVER (w ROWS UNBOUNDED PRECEDING) AS paced_at
FROM (SELECT origin, call_seq, started_at, row_number() OVER (PARTITION BY origin ORDER BY started_at, call_seq) AS i FROM calls)
WINDOW w AS (PARTITION BY origin ORDER BY started_at, call_seq)"""

ORACLES["dedupe_pages"] = _with(CALLS) + """
SELECT scan_id, min(call_seq) AS page_seq, page_norm AS normalized_url FROM calls GROUP BY scan_id, page_norm"""

# --- endpoints -----------------------------------------------------------------

ORACLES["endpoint_rollup"] = _with(CALLS) + f"""
SELECT {KEY}, count(*) AS calls, array_to_string(list_sort(list(DISTINCT status)), '|') AS statuses,
  {RANK.format(v='c', p=0.5)} AS p50_ms, {RANK.format(v='c', p=0.95)} AS p95_ms, max(c) AS max_ms
FROM api GROUP BY ALL"""


def _sizes(side: str) -> str:
    size = f"octet_length(encode({side}_body))"
    return (
        f"{RANK.format(v=size, p=0.5)} AS {side}_p50, {RANK.format(v=size, p=0.95)} AS {side}_p95, max({size}) AS {side}_max"
    )


ORACLES["size_stats"] = _with(CALLS) + f"SELECT {KEY}, {_sizes('request')}, {_sizes('response')} FROM api GROUP BY ALL"

VALUES = f"""
vals AS (
  SELECT {KEY}, 'origin' AS kind, origin AS value, min(call_seq) AS first_seq, count(*) AS calls FROM api GROUP BY ALL
  UNION ALL SELECT {KEY}, 'mime', mime_type, min(call_seq), count(*) FROM api WHERE mime_type <> '' GROUP BY ALL
  UNION ALL SELECT {KEY}, 'page', triggered_by, min(call_seq), count(*) FROM api GROUP BY ALL
)
"""
ORACLES["endpoint_values"] = _with(CALLS, VALUES) + "SELECT * FROM vals"
ORACLES["categorize"] = _with(CALLS, FIRST) + f"SELECT {KEY}, category, heuristic FROM endpoints"

# Reason of every call: no body, text that is not JSON, or none.
_REQUEST_GAP = "CASE WHEN request_body IS NULL THEN 0 END"
_RESPONSE_GAP = "CASE WHEN response_body IS NULL THEN 0 WHEN response_body = 'not available' THEN 1 END"
_GAP_NAME = "CASE {} WHEN 0 THEN 'no-body' WHEN 1 THEN 'not-json' ELSE '' END"
GAPS = f"""
gaps AS (
  SELECT {KEY}, method || ' ' || url_pattern AS id, max({_REQUEST_GAP}) AS request_rank,
    bool_or(status BETWEEN 200 AND 299 AND response_body IS NOT NULL) AS success_sampled,
    CASE WHEN bool_or(status BETWEEN 200 AND 299 AND response_body IS NOT NULL)
      THEN max({_RESPONSE_GAP}) FILTER (status BETWEEN 200 AND 299) ELSE max({_RESPONSE_GAP}) END AS response_rank
  FROM api GROUP BY ALL
)
"""
ORACLES["gap_reasons"] = _with(CALLS, GAPS) + f"""
SELECT {KEY}, {_GAP_NAME.format('request_rank')} AS request_gap, {_GAP_NAME.format('response_rank')} AS response_gap FROM gaps"""

ORACLES["endpoint_samples"] = _with(CALLS) + f"""
SELECT {KEY}, arg_min(request_body, call_seq) FILTER (request_body IS NOT NULL) AS request_body_sample,
  arg_min(response_body, call_seq) FILTER (response_body IS NOT NULL) AS response_body_sample,
  arg_max(coalesce(cookie, ''), call_seq) <> '' AS sent_cookie,
  arg_max(CASE WHEN failed THEN '' WHEN k % 2 = 0 THEN 'HIT' ELSE 'MISS' END, call_seq) AS x_cache
FROM api GROUP BY ALL"""

ORACLES["cache_info"] = _with(CALLS) + f"""
SELECT {KEY}, arg_min(CASE WHEN call_seq % 2 = 0 THEN 'max-age=60' ELSE '' END, call_seq) AS control,
  CAST(nullif(arg_min(CASE WHEN call_seq % 2 = 0 THEN k ELSE -1 END, call_seq), -1) AS BIGINT) AS age,
  arg_min(CASE WHEN k % 2 = 0 THEN 'HIT' ELSE 'MISS' END, call_seq) AS status
FROM api WHERE NOT failed GROUP BY ALL"""

ORACLES["query_params"] = _with(CALLS) + f"""
SELECT {KEY}, 'token' AS name, '{fv.REDACTED}' AS samples FROM api GROUP BY ALL
UNION ALL
SELECT {KEY}, 'page', array_to_string(list(page ORDER BY first_seq)[1:5], '|')
FROM (SELECT {KEY}, k % 5 AS page, min(call_seq) AS first_seq FROM api GROUP BY ALL) GROUP BY ALL"""

ORACLES["query_param_types"] = _with(CALLS) + f"""
SELECT {KEY}, unnest(['page', 'token']) AS name, unnest(['integer', 'string']) AS type, unnest([FALSE, TRUE]) AS sensitive
FROM api GROUP BY {KEY}"""

ERRORS = f"""
errors AS (
  SELECT {KEY}, CAST(status AS BIGINT) AS status, count(*) AS calls, arg_min(response_body, call_seq) AS body_sample, min(call_seq) AS first_seq
  FROM api WHERE status >= 400 GROUP BY ALL
)
"""
ORACLES["error_contracts"] = _with(CALLS, ERRORS) + f"SELECT {KEY}, status, calls, body_sample, '' AS schema_reason FROM errors"
ORACLES["error_mimes"] = _with(CALLS, ERRORS) + f"SELECT {KEY}, status, 'application/json' AS mime_type, first_seq, calls FROM errors"

ORACLES["vendor_attribution"] = _with(CALLS, FIRST) + f"""
SELECT DISTINCT {KEY}, 'Segment' AS vendor, 'analytics' AS vendor_category, 'page|token' AS payload_keys
FROM api JOIN endpoints USING ({KEY}) WHERE category IN ('analytics', 'third-party') AND api.host = 'api.segment.io'"""

ORACLES["failed_calls"] = _with(CALLS) + f"""
SELECT {KEY}, count(*) AS failed, min(call_seq) AS first_seq FROM api WHERE status = 0 GROUP BY ALL"""

# --- shapes --------------------------------------------------------------------

# One row per observed node: path, type, string value, number value. ``shape`` marks nodes a shape is read from.
NODES = f"""
bodies AS (
  SELECT {KEY}, 'request' AS side, api.* EXCLUDE ({KEY}) FROM api WHERE request_body IS NOT NULL
  UNION ALL SELECT {KEY}, 'response', api.* EXCLUDE ({KEY}) FROM api JOIN gaps USING ({KEY})
    WHERE response_body IS NOT NULL AND response_body <> 'not available' AND (status BETWEEN 200 AND 299 OR NOT success_sampled)
  UNION ALL SELECT {KEY}, 'error:' || status, api.* EXCLUDE ({KEY}) FROM api WHERE status >= 400
),
kinds AS (
  SELECT *, CASE WHEN side = 'request' AND gql THEN CASE WHEN k % 20 = 4 THEN 'gq' WHEN aft THEN 'gm' ELSE 'ga' END
    WHEN side = 'request' THEN 'rq' WHEN event_type = 'error' AND k % 4 = 3 AND aft THEN 'et' WHEN event_type = 'error' THEN 'er'
    WHEN gql THEN 'gr' WHEN event_type = 'view' AND aft THEN 'va' WHEN event_type = 'view' THEN 'vb' ELSE 'rs' END AS body_kind
  FROM bodies
),
nodes AS (
  SELECT {KEY}, side, '' AS path, 'object' AS type, NULL AS text, NULL::BIGINT AS number FROM kinds
  UNION ALL SELECT {KEY}, side, 'user', 'integer', NULL, user_id FROM kinds WHERE body_kind IN ('rq', 'ga')
  UNION ALL SELECT {KEY}, side, 'email', 'string', 'u' || user_id || '@example.com', NULL FROM kinds WHERE body_kind = 'rq'
  UNION ALL SELECT {KEY}, side, 'amount', 'integer', NULL, c FROM kinds WHERE body_kind = 'rq'
  UNION ALL SELECT {KEY}, side, 'query', 'string', 'long document ' || k, NULL FROM kinds WHERE body_kind IN ('gq', 'gm', 'ga')
  UNION ALL SELECT {KEY}, side, 'operationName', 'string', 'Product', NULL FROM kinds WHERE body_kind = 'gq'
  UNION ALL SELECT {KEY}, side, 'variables', 'object', NULL, NULL FROM kinds WHERE body_kind = 'gq'
  UNION ALL SELECT {KEY}, side, 'variables.id', 'string', '' || user_id, NULL FROM kinds WHERE body_kind = 'gq'
  UNION ALL SELECT {KEY}, side, 'error', 'string', 'e' || (k % 3), NULL FROM kinds WHERE body_kind IN ('er', 'et')
  UNION ALL SELECT {KEY}, side, 'trace', 'string', 'stack trace x', NULL FROM kinds WHERE body_kind = 'et'
  UNION ALL SELECT {KEY}, side, 'data', 'object', NULL, NULL FROM kinds WHERE body_kind = 'gr'
  UNION ALL SELECT {KEY}, side, 'data.product', 'object', NULL, NULL FROM kinds WHERE body_kind = 'gr'
  UNION ALL SELECT {KEY}, side, 'data.product.name', 'string', 'p' || (k % 7), NULL FROM kinds WHERE body_kind = 'gr'
  UNION ALL SELECT {KEY}, side, 'id', 'integer', NULL, call_seq FROM kinds WHERE body_kind IN ('va', 'vb', 'rs')
  UNION ALL SELECT {KEY}, side, 'state', 'string', state, NULL FROM kinds WHERE body_kind IN ('vb', 'rs')
  UNION ALL SELECT {KEY}, side, 'currency', 'string', 'EUR', NULL FROM kinds WHERE body_kind = 'va'
  UNION ALL SELECT {KEY}, side, 'total', CASE WHEN k = 7 THEN 'string' ELSE 'integer' END, CASE WHEN k = 7 THEN '' || c END,
    CASE WHEN k <> 7 THEN c END FROM kinds WHERE body_kind IN ('va', 'vb', 'rs') AND k <> 8
  UNION ALL SELECT {KEY}, side, 'lines', 'array', NULL, NULL FROM kinds WHERE body_kind IN ('va', 'vb')
  UNION ALL SELECT {KEY}, side, 'lines[]', 'object', NULL, NULL FROM kinds WHERE body_kind IN ('va', 'vb')
  UNION ALL SELECT {KEY}, side, 'lines[].sku', 'string', 's' || (k % 3), NULL FROM kinds WHERE body_kind IN ('va', 'vb')
  UNION ALL SELECT {KEY}, side, 'lines[].qty', 'integer', NULL, k % 5 FROM kinds WHERE body_kind IN ('va', 'vb')
)
"""


def _shape(nodes: str, keys: str) -> str:
    """Merged shape of node rows: types, format, required, enum, bounds."""
    return f"""
shape0 AS (
  SELECT {keys}, path, list_sort(list(DISTINCT type)) AS types, count(*) AS n, count(*) FILTER (type = 'object') AS objects,
    CASE WHEN bool_and(type <> 'string' OR text LIKE 'u%@example.com') AND bool_or(type = 'string') THEN 'email'
         WHEN bool_and(type <> 'string' OR text = 'EUR') AND bool_or(type = 'string') THEN 'currency' ELSE '' END AS format,
    count(DISTINCT text) AS n_texts, bool_and(text IS NULL OR (length(text) BETWEEN 1 AND 40 AND NOT contains(text, ' '))) AS plain,
    list_sort(list(DISTINCT text) FILTER (text IS NOT NULL)) AS texts, min(number) AS low, max(number) AS high
  FROM {nodes} GROUP BY ALL
),
shape AS (
  SELECT {keys}, path, types, format,
    coalesce(path <> '' AND NOT ends_with(path, '[]') AND n = (
      SELECT p.objects FROM shape0 p WHERE ({', '.join('p.' + k.strip() for k in keys.split(','))}) = ({', '.join('s.' + k.strip() for k in keys.split(','))})
        AND p.path = regexp_replace(s.path, '(^|[.])[^.]*$', '')), FALSE) AS required,
    CASE WHEN list_contains(types, 'string') AND format = '' AND n_texts BETWEEN 2 AND 10 AND plain THEN texts END AS enum,
    CASE WHEN low < high THEN low END AS minimum, CASE WHEN low < high THEN high END AS maximum
  FROM shape0 s
)
"""


_FLAT_SHAPE = (
    "path, array_to_string(types, '|') AS types, format, required, coalesce(array_to_string(enum, '|'), '') AS enum, minimum, maximum"
)
SHAPES = [CALLS, GAPS, NODES, _shape("nodes", f"{KEY}, side")]
ORACLES["schema_paths"] = _with(*SHAPES) + f"SELECT {KEY}, side, {_FLAT_SHAPE} FROM shape"

FRAME_NODES = """
fnodes AS (
  SELECT conn_seq, direction, '' AS path, 'object' AS type, NULL AS text, NULL::BIGINT AS number FROM frames WHERE role <> 'system'
  UNION ALL SELECT conn_seq, direction, 'type', 'string', CASE WHEN turn % 5 = 4 THEN 'note' ELSE 'message' END, NULL FROM frames WHERE role <> 'system'
  UNION ALL SELECT conn_seq, direction, 'turn', 'integer', NULL, turn FROM frames WHERE role <> 'system'
  UNION ALL SELECT conn_seq, direction, 'chars', CASE WHEN turn % 5 = 4 THEN 'string' ELSE 'integer' END,
    CASE WHEN turn % 5 = 4 THEN '' || size END, CASE WHEN turn % 5 <> 4 THEN size END FROM frames WHERE role <> 'system'
)
"""
ORACLES["socket_shapes"] = _with(FRAMES, FRAME_NODES, _shape("fnodes", "conn_seq, direction")) + f"SELECT conn_seq, direction, {_FLAT_SHAPE} FROM shape"

ORACLES["socket_gaps"] = _with(FRAMES) + """
SELECT c.conn_seq, d.direction, CASE WHEN c.n > 7 THEN 'truncated' WHEN s.n IS NULL THEN 'no-body' WHEN s.shaped > 0 THEN '' ELSE 'not-json' END AS reason
FROM (SELECT conn_seq, count(*) AS n FROM frames GROUP BY ALL) c
CROSS JOIN (VALUES ('sent'), ('received')) d(direction)
LEFT JOIN (SELECT conn_seq, direction, count(*) AS n, count(*) FILTER (role <> 'system') AS shaped FROM frames WHERE nth <= 7 GROUP BY ALL) s
  ON s.conn_seq = c.conn_seq AND s.direction = d.direction"""

ORACLES["string_formats"] = """
SELECT source, format, enum_member, count(*) AS n FROM (
  SELECT 'url' AS source, 'uri' AS format, FALSE AS enum_member FROM pages
  UNION ALL SELECT 'lang', 'none', TRUE FROM documents
  UNION ALL SELECT 'date', 'date', FALSE FROM orders
  UNION ALL SELECT 'stamp', 'date-time', FALSE FROM events
  UNION ALL SELECT 'money', CASE WHEN round(value * 100) < 1000 THEN 'currency' ELSE 'none' END, round(value * 100) >= 1000 FROM events
) GROUP BY ALL"""

# --- redaction -----------------------------------------------------------------

_TRIMMED = "regexp_replace(value, '^\\s+|\\s+$', '', 'g')"
_ENTROPY = (
    "-list_sum(list_transform(list_distinct(string_split(v, '')), lambda ch: "
    "(length(v) - length(replace(v, ch, ''))) / length(v)::DOUBLE * log2((length(v) - length(replace(v, ch, ''))) / length(v)::DOUBLE)))"
)
ORACLES["sensitive_values"] = f"""
WITH texts AS (
  SELECT 'document' AS source, doc_id AS id, text AS value FROM documents
  UNION ALL SELECT 'url', page_id, url FROM pages
  UNION ALL SELECT 'customer', c_custkey, c_name FROM customer
),
t AS (SELECT source, id, {_TRIMMED} AS v FROM texts),
judged AS (
  SELECT source, id, v, v <> '' AND (regexp_matches(v, '{fv.JWT_VALUE}') OR regexp_full_match(v, '{fv.EMAIL_TEXT}') OR regexp_full_match(v, '{fv.SSN_TEXT}')
    OR (regexp_matches(v, '{fv.PHONE_VALUE}') AND length(regexp_replace(v, '[^0-9]', '', 'g')) >= 10 AND regexp_matches(v[2:-2], '[ ().-]'))
    OR CASE WHEN length(v) >= 20 AND (regexp_matches(v, '{fv.BASE64_VALUE}') OR regexp_matches(v, '{fv.BASE64URL_VALUE}'))
         AND regexp_matches(v, '[A-Za-z]') AND regexp_matches(v, '[0-9]') THEN {_ENTROPY} >= 3.5 ELSE FALSE END) AS scalar
  FROM t
)
SELECT source, id, scalar, scalar OR regexp_matches(v, '{fv.EMAIL_TEXT}') OR regexp_matches(v, '\\b{fv.SSN_TEXT}\\b') AS sensitive FROM judged"""

ORACLES["entropy"] = f"SELECT page_id, CAST(floor({_ENTROPY} * 1000000 + 0.5) AS BIGINT) AS micro_bits FROM (SELECT page_id, url AS v FROM pages)"

ORACLES["redact_log_lines"] = f"""
SELECT doc_id, sha256(masked) AS digest, length(masked) AS chars FROM (
  SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '{fv.LOG_ASSIGNMENT}', '\\1={fv.REDACTED}', 'g'),
    '{fv.LOG_BEARER}', 'Bearer {fv.REDACTED}', 'g'), '{fv.LOG_JWT}', 'JWT {fv.REDACTED}', 'g') AS masked
  FROM documents)"""

ORACLES["redact_headers"] = _with(CALLS) + f"""
SELECT scan_id, call_seq, 'accept' AS name, '*/*' AS value FROM calls
UNION ALL SELECT scan_id, call_seq, 'content-type', 'application/json' FROM calls WHERE request_body IS NOT NULL
UNION ALL SELECT scan_id, call_seq, 'cookie', '{fv.REDACTED}' FROM calls WHERE cookie IS NOT NULL
UNION ALL SELECT scan_id, call_seq, 'x-contact', '{fv.REDACTED}' FROM calls WHERE contact IS NOT NULL"""

ORACLES["redact_bodies"] = _with(CALLS) + f"""
SELECT scan_id, call_seq, regexp_replace(request_body, '"email":"[^"]*"', '"email":"{fv.REDACTED}"') AS body FROM calls WHERE request_body IS NOT NULL"""

ORACLES["secret_ledger"] = _with(CALLS) + """
SELECT DISTINCT value FROM (
  SELECT cookie AS value FROM calls UNION ALL SELECT contact FROM calls
  UNION ALL SELECT 'u' || user_id || '@example.com' FROM calls WHERE contains(request_body, '"email"')
) WHERE length(value) >= 6"""

LEAKS = f"""
secrets AS (
  SELECT DISTINCT value FROM (
    SELECT unnest(regexp_extract_all(text, '{fv.EMAIL_TEXT}')) AS value FROM documents
    UNION ALL SELECT unnest(regexp_extract_all(text, 'token = "([^"\\s]+)"', 1)) FROM documents)
  WHERE length(value) >= 6
),
leaves AS (
  SELECT 'documents' AS source, doc_id AS id, text AS leaf FROM documents UNION ALL SELECT 'pages', page_id, html FROM pages
),
hits AS (SELECT source, id FROM leaves WHERE EXISTS (SELECT 1 FROM secrets WHERE contains(leaf, value)))
"""
ORACLES["leak_scan"] = _with(LEAKS) + "SELECT source, id FROM hits"
ORACLES["leak_summary"] = _with(LEAKS) + """
SELECT source, count(*) AS total, array_to_string(list_sort(list(source || '.' || id))[1:8], '|') AS paths FROM hits GROUP BY source"""

# --- findings, resources, graph ------------------------------------------------

_ANON = (
    "category NOT IN ('analytics', 'third-party', 'authentication') "
    f"AND regexp_matches(url_pattern, '{fv.SENSITIVE_PATH}') AND list_has_any(statuses, [200, 201]) AND NOT last_cookie"
)
_FINDINGS = {
    "unauthenticated": f"""
SELECT scan_id, 'unauthenticated' AS kind, 'high' AS severity, id AS endpoint,
  id || ' — no Authorization or Cookie header; observed ' || array_to_string(statuses, ', ') AS detail
FROM endpoints WHERE {_ANON}""",
    "pii": f"""
SELECT scan_id, 'pii' AS kind, 'medium' AS severity, method || ' ' || url_pattern AS endpoint,
  method || ' ' || url_pattern || ' — ' || array_to_string(list_sort(list(DISTINCT path)), ', ') AS detail
FROM shape WHERE regexp_matches(split_part(path, '.', -1), '{fv.PII_FIELD}') GROUP BY {KEY}""",
    "verbose": f"""
SELECT scan_id, 'verbose-error' AS kind, 'medium' AS severity, method || ' ' || url_pattern AS endpoint,
  method || ' ' || url_pattern || ' — ' || status || ' body exposed internals ("stack trace")' AS detail
FROM errors WHERE contains(body_sample, 'stack trace')""",
    "headers": f"""
SELECT s.scan_id, 'missing-security-header' AS kind, 'low' AS severity, '' AS endpoint, name || ' was not present on any captured response' AS detail
FROM (SELECT scan_id, bool_or(nosniff) AS nosniff FROM endpoints GROUP BY scan_id) s
CROSS JOIN (SELECT unnest([{_list(fv.SECURITY_HEADERS)}]) AS name) WHERE NOT (nosniff AND name = 'x-content-type-options')""",
    "shape": f"""
SELECT scan_id, 'inconsistent-shape' AS kind, 'low' AS severity, method || ' ' || url_pattern AS endpoint,
  method || ' ' || url_pattern || ' — shape varied across samples (' || array_to_string(list(label || ats ORDER BY ord, label), '; ') || ')' AS detail
FROM (
  SELECT {KEY}, CASE side WHEN 'response' THEN 0 WHEN 'request' THEN 1 ELSE 2 END AS ord,
    CASE side WHEN 'response' THEN 'response at ' WHEN 'request' THEN 'request body at ' ELSE replace(side, ':', ' ') || ' at ' END AS label,
    array_to_string(list_sort(list(CASE path WHEN '' THEN '(root)' ELSE path END)), ', ') AS ats
  FROM shape WHERE len(types) > 1 GROUP BY {KEY}, side
) GROUP BY {KEY}""",
}
ORACLES["finding_unauthenticated"] = _with(CALLS, FIRST) + _FINDINGS["unauthenticated"]
ORACLES["finding_pii"] = _with(*SHAPES) + _FINDINGS["pii"]
ORACLES["finding_verbose_error"] = _with(CALLS, ERRORS) + _FINDINGS["verbose"]
ORACLES["finding_security_headers"] = _with(CALLS, FIRST) + _FINDINGS["headers"]
ORACLES["finding_inconsistent_shape"] = _with(*SHAPES) + _FINDINGS["shape"]
FINDINGS = "findings AS (" + "\nUNION ALL ".join(f"SELECT * FROM ({sql})" for sql in _FINDINGS.values()) + ")"
ORACLES["finding_summary"] = _with(*SHAPES, FIRST, ERRORS, FINDINGS) + """
SELECT scan_id, kind, severity, count(DISTINCT nullif(endpoint, '')) AS endpoints, count(*) AS details,
  CASE severity WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END AS severity_rank
FROM findings GROUP BY ALL"""

_ROOT = "regexp_replace(url_pattern, '/\\{id\\}.*$', '')"
RESOURCES = f"""
rooted AS (SELECT *, {_ROOT} AS resource FROM endpoints),
resources AS (
  SELECT scan_id, resource, url_pattern AS path, list_sort(list(DISTINCT method)) AS methods FROM rooted GROUP BY ALL
),
roots AS (
  SELECT scan_id, resource, bool_or(contains(url_pattern, '{{id}}')) AS crud, list_sort(list(DISTINCT category)) AS categories FROM rooted GROUP BY ALL
)
"""
ORACLES["resources"] = _with(CALLS, FIRST, RESOURCES) + f"""
SELECT scan_id, resource, array_to_string(categories, '|') AS categories, path, array_to_string(methods, '|') AS methods,
  CASE WHEN crud THEN array_to_string(list_filter(CASE WHEN regexp_matches(path, '\\}}$') THEN [{_list(fv.ITEM_VERBS)}] ELSE [{_list(fv.COLLECTION_VERBS)}] END,
    lambda verb: NOT list_contains(methods, verb)), '|') ELSE '' END AS missing
FROM resources JOIN roots USING (scan_id, resource)"""
ORACLES["resource_lookup"] = _with(CALLS) + f"SELECT DISTINCT {KEY}, {_ROOT} AS resource FROM api"

GRAPH = f"""
triggered AS (
  SELECT scan_id, triggered_by AS url, id AS label, t.calls
  FROM (SELECT DISTINCT {KEY}, id, triggered_by FROM api) JOIN (SELECT {KEY}, count(*) AS calls FROM api GROUP BY ALL) t USING ({KEY})
),
gpages AS (
  SELECT scan_id, url, count(*) AS requests, regexp_replace(regexp_replace(url, '#.*$', ''), '^[a-z]+://', '') AS label
  FROM triggered GROUP BY ALL
),
kept_pages AS (
  SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY requests DESC, label, url) - 1 AS n FROM gpages
  QUALIFY n < {fv.GRAPH_MAX_PAGES}
),
on_kept AS (SELECT t.*, p.n AS page_n FROM triggered t JOIN kept_pages p USING (scan_id, url)),
greq AS (SELECT scan_id, label, max(calls) AS calls FROM on_kept GROUP BY ALL),
kept_requests AS (
  SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY calls DESC, label) - 1 AS n FROM greq
  QUALIFY n < {fv.GRAPH_MAX_REQUESTS}
),
edges AS (SELECT o.scan_id, page_n, r.n AS request_n, o.calls FROM on_kept o JOIN kept_requests r USING (scan_id, label))
"""
ORACLES["request_graph_pages"] = _with(CALLS, GRAPH) + "SELECT scan_id, 'p' || n AS node, label, requests FROM kept_pages"
ORACLES["request_graph_requests"] = _with(CALLS, GRAPH) + "SELECT scan_id, 'e' || n AS node, label, calls FROM kept_requests"
ORACLES["request_graph_edges"] = _with(CALLS, GRAPH) + (
    "SELECT scan_id, 'p' || page_n AS page_node, 'e' || request_n AS request_node, calls FROM edges"
)
ORACLES["request_graph_omitted"] = _with(CALLS, GRAPH) + f"""
SELECT scan_id, greatest(p.n - {fv.GRAPH_MAX_PAGES}, 0) AS omitted_pages, greatest(r.n - {fv.GRAPH_MAX_REQUESTS}, 0) AS omitted_requests
FROM (SELECT scan_id, count(*) AS n FROM gpages GROUP BY ALL) p JOIN (SELECT scan_id, count(*) AS n FROM greq GROUP BY ALL) r USING (scan_id)"""
ORACLES["request_graph_mermaid"] = _with(CALLS, GRAPH) + """
SELECT DISTINCT scan_id, 'flowchart LR' AS line FROM kept_pages
UNION ALL SELECT scan_id, '  p' || n || '["' || label || '"]' FROM kept_pages
UNION ALL SELECT scan_id, '  e' || n || '["' || label || '"]' FROM kept_requests
UNION ALL SELECT scan_id, '  p' || page_n || ' --> e' || request_n FROM edges"""

# --- comparison ----------------------------------------------------------------

PRESENCE = """
bside AS (SELECT * FROM endpoints WHERE scan_id = 'before'),
aside AS (SELECT * FROM endpoints WHERE scan_id = 'after'),
presence AS (
  SELECT coalesce(a.id, b.id) AS id, CASE WHEN b.id IS NULL THEN 'added' ELSE 'removed' END AS kind, a.id IS NULL AS breaking,
    CASE WHEN b.id IS NULL THEN 'new endpoint (observed ' || array_to_string(a.statuses, ', ') || ')'
      ELSE 'not observed in this scan (was ' || array_to_string(b.statuses, ', ') || ')' END AS text
  FROM aside a FULL JOIN bside b ON a.id = b.id WHERE a.id IS NULL OR b.id IS NULL
)
"""
def _one_decimal(x: str) -> str:
    """One decimal; exact quarters round up."""
    return f"CASE WHEN {x} * 4 = floor({x} * 4) AND {x} * 2 <> floor({x} * 2) THEN format('{{:.1f}}', ceil({x} * 10) / 10) ELSE format('{{:.1f}}', {x}) END"


def _bytes(n: str) -> str:
    return (
        f"CASE WHEN {n} < 1024 THEN {n} || ' B' WHEN {n} / 1024 < 10 THEN {_one_decimal(f'({n} / 1024)')} || ' KB' "
        f"WHEN {n} / 1048576 < 1 THEN CAST(round({n} / 1024) AS BIGINT) || ' KB' "
        f"WHEN {n} / 1048576 < 10 THEN {_one_decimal(f'({n} / 1048576)')} || ' MB' ELSE CAST(round({n} / 1048576) AS BIGINT) || ' MB' END"
    )



DETAILS = f"""
pair AS (SELECT b.id, b.statuses AS bs, a.statuses AS s, b.category AS bc, a.category AS c, b.p95_bytes AS bp, a.p95_bytes AS p FROM bside b JOIN aside a ON a.id = b.id),
d_status AS (
  SELECT id, 'status codes ' || array_to_string(bs, ', ') || ' → ' || array_to_string(s, ', ') AS text, FALSE AS breaking FROM pair WHERE bs <> s
  UNION ALL SELECT id, 'category ' || bc || ' → ' || c, FALSE FROM pair WHERE bc <> c
),
d_growth AS (
  SELECT id, 'response payload grew sharply: p95 ' || {_bytes('bp')} || ' → ' || {_bytes('p')} || ' (+' || CAST(floor((p - bp) * 100 / bp + 0.5) AS BIGINT) || '%)' AS text, FALSE AS breaking
  FROM pair WHERE bp > 0 AND p - bp >= {fv.GROWTH_MIN_BYTES} AND p >= bp * {fv.GROWTH_RATIO}
),
side_gaps AS (
  SELECT scan_id, id, 'response' AS side, response_rank AS reason FROM gaps
  UNION ALL SELECT scan_id, id, 'request', request_rank FROM gaps
  UNION ALL SELECT DISTINCT scan_id, id, 'error:' || status, NULL FROM api WHERE status >= 400
),
side_state AS (
  SELECT g.*, s.path IS NOT NULL AS shaped FROM side_gaps g
  LEFT JOIN (SELECT DISTINCT scan_id, method || ' ' || url_pattern AS id, side, path FROM shape WHERE path = '') s USING (scan_id, id, side)
),
sides AS (
  SELECT b.id, b.side, coalesce(a.reason, b.reason) AS reason, CASE WHEN NOT b.shaped AND NOT a.shaped THEN 'none' WHEN NOT b.shaped THEN 'new'
    WHEN NOT a.shaped THEN 'gone' WHEN coalesce(a.reason, b.reason) IS NOT NULL THEN 'partial' ELSE 'compare' END AS verdict,
    CASE b.side WHEN 'response' THEN 'response' WHEN 'request' THEN 'request body' ELSE replace(b.side, 'error:', 'error response ') END AS label
  FROM (SELECT * FROM side_state WHERE scan_id = 'before') b JOIN (SELECT * FROM side_state WHERE scan_id = 'after') a USING (id, side)
),
d_gaps AS (
  SELECT id, label || CASE verdict WHEN 'new' THEN ' schema newly inferred'
    WHEN 'gone' THEN ' schema no longer inferred' || coalesce(CASE reason WHEN 0 THEN ' (no body captured)' WHEN 1 THEN ' (body was not JSON)' END, '')
    ELSE ' not fully observed (' || CASE reason WHEN 0 THEN 'no body captured' ELSE 'body was not JSON' END || '); shape not compared' END AS text, FALSE AS breaking
  FROM sides WHERE verdict IN ('new', 'gone', 'partial')
),
cmp AS (
  SELECT id, side, label, path, b.types AS bt, a.types AS t, b.enum AS be, a.enum AS ae, b.minimum AS bmin, a.minimum AS amin, b.maximum AS bmax, a.maximum AS amax,
    CASE path WHEN '' THEN '(root)' ELSE path END AS spot
  FROM (SELECT *, method || ' ' || url_pattern AS id FROM shape WHERE scan_id = 'before') b
  FULL JOIN (SELECT *, method || ' ' || url_pattern AS id FROM shape WHERE scan_id = 'after') a USING (id, side, path)
  JOIN (SELECT * FROM sides WHERE verdict = 'compare') USING (id, side)
),
same AS (SELECT *, label || ' ' || spot || ': ' AS pre FROM cmp WHERE bt = t),
fields AS (
  SELECT * FROM cmp x WHERE (bt IS NULL OR t IS NULL) AND path <> '' AND NOT ends_with(path, '[]')
    AND EXISTS (SELECT 1 FROM cmp p WHERE p.id = x.id AND p.side = x.side AND p.path = regexp_replace(x.path, '(^|[.])[^.]*$', '') AND p.bt IS NOT NULL AND p.t IS NOT NULL)
),
d_schema AS (
  SELECT id, label || ' ' || spot || ': type ' || array_to_string(bt, '|') || ' → ' || array_to_string(t, '|') AS text, TRUE AS breaking FROM cmp WHERE bt <> t
  UNION ALL SELECT id, pre || 'enum added ("' || array_to_string(ae, '", "') || '")', TRUE FROM same WHERE be IS NULL AND ae IS NOT NULL
  UNION ALL SELECT id, pre || 'enum no longer inferred (was "' || array_to_string(be, '", "') || '")', FALSE FROM same WHERE ae IS NULL AND be IS NOT NULL
  UNION ALL SELECT id, pre || 'enum values removed: "' || array_to_string(list_filter(be, lambda v: NOT list_contains(ae, v)), '", "') || '"', TRUE
    FROM same WHERE len(list_filter(be, lambda v: NOT list_contains(ae, v))) > 0
  UNION ALL SELECT id, pre || 'enum values added: "' || array_to_string(list_filter(ae, lambda v: NOT list_contains(be, v)), '", "') || '"', FALSE
    FROM same WHERE len(list_filter(ae, lambda v: NOT list_contains(be, v))) > 0
  UNION ALL SELECT id, pre || 'minimum ' || coalesce('' || bmin, 'unbounded') || ' → ' || coalesce('' || amin, 'unbounded'), bmin IS NULL OR coalesce(amin > bmin, FALSE)
    FROM same WHERE bmin IS DISTINCT FROM amin
  UNION ALL SELECT id, pre || 'maximum ' || coalesce('' || bmax, 'unbounded') || ' → ' || coalesce('' || amax, 'unbounded'), bmax IS NULL OR coalesce(amax < bmax, FALSE)
    FROM same WHERE bmax IS DISTINCT FROM amax
  UNION ALL SELECT id, label || ' field removed: ' || path, TRUE FROM fields WHERE t IS NULL
  UNION ALL SELECT id, label || ' field added: ' || path, FALSE FROM fields WHERE bt IS NULL
)
"""
# The operations of the three sample documents.
GQL = f"""
gops AS (
  SELECT DISTINCT {KEY}, id, CASE WHEN k % 20 = 4 THEN 'query' WHEN aft THEN 'mutation' ELSE 'query' END AS type,
    CASE WHEN k % 20 = 4 THEN 'Product' WHEN aft THEN 'AddItem' ELSE '' END AS name,
    CASE WHEN k % 20 = 4 THEN 'product|reviews' WHEN aft THEN 'addItem' ELSE '__schema|viewer' END AS selections,
    CASE WHEN k % 20 = 4 THEN 'first|id' WHEN aft THEN 'qty|sku' ELSE '' END AS arguments
  FROM api WHERE gql
),
gintro AS (SELECT {KEY}, id, bool_or(k % 20 <> 4 AND NOT aft) AS introspection FROM api WHERE gql GROUP BY ALL),
gop AS (
  SELECT coalesce(b.id, a.id) AS id, coalesce(nullif(coalesce(a.name, b.name), ''), 'anonymous') || ' (' || coalesce(a.type, b.type) || ')' AS shown, a.id IS NULL AS gone
  FROM (SELECT * FROM gops WHERE scan_id = 'before') b FULL JOIN (SELECT * FROM gops WHERE scan_id = 'after') a ON a.id = b.id AND a.type = b.type AND a.name = b.name
  WHERE a.id IS NULL OR b.id IS NULL
),
d_graphql AS (
  SELECT id, CASE WHEN gone THEN 'GraphQL operations not observed this time: ' ELSE 'new GraphQL operations: ' END || array_to_string(list_sort(list(shown)), ', ') AS text, gone AS breaking
  FROM gop GROUP BY id, gone
  UNION ALL SELECT b.id, CASE WHEN a.introspection THEN 'GraphQL introspection newly observed' ELSE 'GraphQL introspection no longer observed' END, FALSE
    FROM (SELECT * FROM gintro WHERE scan_id = 'before') b JOIN (SELECT * FROM gintro WHERE scan_id = 'after') a ON a.id = b.id WHERE a.introspection <> b.introspection
)
"""
CHANGES = """
details AS (SELECT * FROM d_status UNION ALL SELECT * FROM d_growth UNION ALL SELECT * FROM d_gaps UNION ALL SELECT * FROM d_schema UNION ALL SELECT * FROM d_graphql),
changes AS (
  SELECT id, kind, breaking, 1 AS details FROM presence
  UNION ALL SELECT id, 'changed', bool_or(breaking), count(*) FROM details GROUP BY id
)
"""
_COMPARED = [*SHAPES, FIRST, PRESENCE, DETAILS]
ORACLES["diff_endpoints"] = _with(CALLS, FIRST, PRESENCE) + "SELECT id, kind, breaking, text FROM presence"
for _name, _table in (("diff_statuses", "d_status"), ("diff_growth", "d_growth"), ("diff_schema", "d_schema"), ("diff_schema_gaps", "d_gaps")):
    ORACLES[_name] = _with(*_COMPARED) + f"SELECT id, text, breaking FROM {_table}"
ORACLES["diff_graphql"] = _with(CALLS, GQL) + "SELECT id, text, breaking FROM d_graphql"
# The query takes 'token' from the first scan but for orders, and 'page' from the second for users.
ORACLES["diff_params"] = _with(CALLS) + """,
shared AS (SELECT id FROM api GROUP BY id HAVING count(DISTINCT scan_id) = 2)
SELECT id, 'new query parameters: token' AS text, FALSE AS breaking FROM shared WHERE NOT contains(id, '/orders')
UNION ALL SELECT id, 'query parameters not observed this time: page', FALSE FROM shared WHERE contains(id, '/users')"""
ORACLES["diff_vendors"] = _with(CALLS) + f"""
SELECT id, CASE WHEN count(DISTINCT scan_id) FILTER (host = 'api.segment.io') = 1 AND max(scan_id) FILTER (host = 'api.segment.io') = 'before'
  THEN 'vendor Segment → unattributed' ELSE 'vendor unattributed → Segment' END AS text, FALSE AS breaking
FROM api GROUP BY id HAVING count(DISTINCT scan_id) = 2 AND count(DISTINCT scan_id) FILTER (host = 'api.segment.io') = 1"""
ORACLES["change_counts"] = _with(*_COMPARED, GQL, CHANGES) + """
SELECT count(*) FILTER (kind = 'added') AS added, count(*) FILTER (kind = 'removed') AS removed, count(*) FILTER (kind = 'changed') AS changed,
  count(*) FILTER (breaking) AS breaking FROM changes"""
ORACLES["change_summary"] = _with(*_COMPARED, GQL, CHANGES) + f"""
SELECT id, CASE kind WHEN 'added' THEN '+' WHEN 'removed' THEN '-' ELSE '~' END || ' ' || id || CASE WHEN breaking THEN ' [breaking]' ELSE '' END AS line, details,
  (SELECT greatest(count(*) - {fv.SUMMARY_ITEMS}, 0) FROM changes) AS more
FROM changes ORDER BY id LIMIT {fv.SUMMARY_ITEMS}"""
ORACLES["change_gate"] = _with(*_COMPARED, GQL, CHANGES) + "SELECT count(*) > 0 AS has_changes, bool_or(breaking) AS breaking FROM changes"
ORACLES["changed_rows"] = _with(*_COMPARED, GQL, CHANGES) + """
SELECT id, category, coalesce(kind, 'unchanged') AS change, coalesce(breaking, FALSE) AS change_breaking
FROM (SELECT id, category FROM aside UNION ALL SELECT id, '__removed' FROM changes WHERE kind = 'removed') LEFT JOIN changes USING (id)"""

# --- views ---------------------------------------------------------------------

ORACLES["slowest_endpoints"] = _with(CALLS, FIRST) + """
SELECT scan_id, row_number() OVER (PARTITION BY scan_id ORDER BY p95_ms DESC, category, id) AS rank, id, p95_ms FROM endpoints QUALIFY rank <= 10"""
ORACLES["largest_responses"] = _with(CALLS, FIRST) + f"""
SELECT scan_id, row_number() OVER (PARTITION BY scan_id ORDER BY p95_bytes DESC, category, id) AS rank, id, p95_bytes, {_bytes('p95_bytes')} AS shown
FROM endpoints WHERE p95_bytes IS NOT NULL QUALIFY rank <= 10"""
ORACLES["category_summary"] = _with(CALLS, FIRST) + f"""
SELECT scan_id, category, count(*) AS endpoints, CAST(sum(calls) AS BIGINT) AS calls, list_position([{_list(fv.CATEGORIES)}], category) AS position
FROM endpoints GROUP BY ALL"""
ORACLES["auth_flows"] = _with(CALLS, FIRST) + """
SELECT scan_id, id, array_to_string(statuses, ', ') AS statuses, calls FROM endpoints WHERE category = 'authentication'"""
ORACLES["third_party_calls"] = _with(CALLS, FIRST) + "SELECT scan_id, id, '—' AS vendor, calls FROM endpoints WHERE category = 'third-party'"
ORACLES["endpoint_search"] = _with(CALLS) + """
SELECT DISTINCT 'segment' AS query, scan_id, id FROM api WHERE host = 'api.segment.io'
UNION ALL SELECT DISTINCT 'post /api', scan_id, id FROM api WHERE method = 'POST'"""
ORACLES["endpoint_filters"] = _with(CALLS, FIRST) + """
SELECT 'status 500' AS filter, scan_id, id FROM endpoints WHERE list_contains(statuses, 500)
UNION ALL SELECT 'post mutations', scan_id, id FROM endpoints WHERE category = 'mutations' AND method = 'POST'"""
ORACLES["group_counts"] = _with(CALLS, FIRST) + f"""
SELECT 'category' AS by, scan_id, category AS "group", count(*) AS rows, arg_min(id, (category, id)) AS first_id FROM endpoints GROUP BY scan_id, category
UNION ALL SELECT 'resource', scan_id, {_ROOT}, count(*), arg_min(id, (category, id)) FROM endpoints GROUP BY scan_id, {_ROOT}"""
ORACLES["signals"] = _with(CALLS, FIRST) + f"""
SELECT scan_id, category, heuristic, method, json FROM endpoints JOIN (SELECT {KEY}, bool_or(mime_type <> '') AS json FROM api GROUP BY ALL) USING ({KEY})"""
ORACLES["signal_boundary"] = """
SELECT event_id, unnest(['$: unexpected field "props"', '$.props: must be a scalar, not a nested value', '$.signals[0]: unexpected field "host"']) AS problem FROM events"""
ORACLES["share_view"] = _with(CALLS, FIRST) + """
SELECT scan_id, method, url_pattern, category, array_to_string(statuses, ', ') AS statuses, calls,
  CASE WHEN contains(url_pattern, '{id2}') THEN 'id|id2' WHEN contains(url_pattern, '{id}') THEN 'id' ELSE '' END AS path_params
FROM endpoints"""
ORACLES["has_contract"] = _with(CALLS) + "SELECT DISTINCT scan_id, id FROM api"
ORACLES["rendered_sizes"] = f"""
SELECT doc_id, {_bytes('(n_chars * 97)')} AS bytes,
  CASE WHEN n_chars * 13 < 1000 THEN (n_chars * 13) || 'ms' WHEN n_chars * 13 < 60000 THEN {_one_decimal('(n_chars * 13 / 1000)')} || 's'
    ELSE (n_chars * 13 // 60000) || 'm ' || CAST(round(n_chars * 13 / 1000 - (n_chars * 13 // 60000) * 60) AS BIGINT) || 's' END AS duration,
  CASE WHEN length(text) <= 40 THEN text ELSE text[1:39] || '…' END AS short
FROM documents"""

# --- stored pages --------------------------------------------------------------

_ORIGIN = "regexp_extract(url, '^([a-z]+://[^/?#]+)', 1)"
ORACLES["robots_rules"] = f"""
SELECT DISTINCT {_ORIGIN} AS origin, unnest([1, 2])::BIGINT AS group_id, unnest(['*', 'probe']) AS agents, unnest(['-/en/|+/en/1|-/th', '-/de/']) AS rules FROM pages"""
ORACLES["robots_settings"] = f"SELECT DISTINCT {_ORIGIN} AS origin, 2::BIGINT AS crawl_delay_seconds, '/map.xml' AS sitemaps FROM pages"


def _allowed(url: str) -> str:
    """The rules for every agent; other sites than the stored ones have none."""
    path = f"coalesce(nullif(regexp_extract({url}, '^[a-z]+://[^/?#]+([^?#]*)', 1), ''), '/')"
    return f"(starts_with({path}, '/en/1') OR NOT (starts_with({path}, '/en/') OR starts_with({path}, '/th')))"


ORACLES["robots_filter"] = _with(LINKS) + f"""
SELECT url, '*' AS agent, {_allowed('url')} AS allowed FROM (SELECT link AS url FROM links UNION SELECT url FROM pages)
UNION ALL SELECT url, 'probe', NOT starts_with({_PATH}, '/de/') FROM (SELECT link AS url FROM links UNION SELECT url FROM pages)"""

_SITE = "regexp_extract({0}, '^[a-z]+://(?:www[.])?([^/?#]+)', 1)"
ORACLES["reachable_pages"] = "WITH RECURSIVE " + LINKS.strip() + f""",
walk AS (
  SELECT '' || page_id AS scan_id, url AS seed, {_normalized('url')} AS url, 0 AS depth FROM pages
  UNION
  SELECT scan_id, seed, target, depth + 1 FROM walk JOIN link_table ON source = walk.url
  WHERE depth < 2 AND {_SITE.format('target')} = {_SITE.format('seed')} AND NOT regexp_matches(target, '^[a-z]+://[^/]+/En(/|[?]|$)')
)
SELECT scan_id, url, CAST(min(depth) AS BIGINT) AS depth FROM walk GROUP BY scan_id, url"""

CRAWL = LINKS.strip() + f""",
start AS (SELECT '' || page_id AS scan_id, {_normalized('url')} AS url, url AS link FROM pages),
queue AS (
  SELECT scan_id, url, 0 AS depth, -1 AS pos, {_allowed('link')} AS allowed FROM start
  UNION ALL SELECT s.scan_id, l.target, 1, l.pos, {_allowed('l.link')} FROM start s JOIN link_table l ON l.source = s.url
    WHERE {_allowed('s.link')} AND l.target <> s.url
),
ranked AS (SELECT *, count(*) FILTER (allowed) OVER (PARTITION BY scan_id ORDER BY depth, pos, url) AS visits FROM queue)
"""
ORACLES["crawl_limited"] = "WITH " + CRAWL + "SELECT scan_id, url, CAST(depth AS BIGINT) AS depth FROM ranked WHERE allowed AND visits <= 4"
ORACLES["crawl_blocked"] = "WITH " + CRAWL + "SELECT DISTINCT scan_id, url FROM ranked WHERE NOT allowed AND visits < 4"
ORACLES["unvisited_links"] = _with(LINKS) + f"""
SELECT DISTINCT target AS url FROM link_table WHERE target NOT IN (SELECT {_normalized('url')} FROM pages)"""

TECH = """
seen AS (
  SELECT CASE WHEN page_id % 2 = 0 THEN 'before' ELSE 'after' END AS scan_id, page_id, html FROM pages
),
tech AS (
  SELECT scan_id, 'Express' AS name, 'framework' AS category, page_id, CASE WHEN page_id % 5 = 0 THEN 'x-powered-by: Express' ELSE 'cookie: connect.sid' END AS evidence
    FROM seen WHERE page_id % 5 = 0 OR page_id % 7 = 0
  UNION ALL SELECT scan_id, CASE WHEN page_id % 3 = 0 THEN 'nginx' ELSE 'Apache' END, 'web-server', page_id, CASE WHEN page_id % 3 = 0 THEN 'server: nginx' ELSE 'server: Apache' END FROM seen
  UNION ALL SELECT scan_id, 'Segment', 'analytics', page_id, 'script: segment' FROM seen WHERE page_id % 11 = 0
  UNION ALL SELECT scan_id, 'WordPress', 'cms', page_id, 'html: wp-content' FROM seen WHERE contains(html, 'wp-content')
)
"""
ORACLES["technologies"] = _with(TECH) + """
SELECT scan_id, name, category, arg_min(evidence, page_id) AS evidence FROM tech GROUP BY ALL"""

ORACLES["scorecard"] = _with(*SHAPES, FIRST, ERRORS, FINDINGS, RESOURCES, TECH) + """
SELECT scan_id, (SELECT count(*) FROM endpoints x WHERE x.scan_id = s.scan_id) AS endpoints,
  (SELECT count(DISTINCT resource) FROM resources x WHERE x.scan_id = s.scan_id) AS resources,
  (SELECT count(DISTINCT name) FROM tech x WHERE x.scan_id = s.scan_id) AS technologies,
  (SELECT count(DISTINCT kind) FROM findings x WHERE x.scan_id = s.scan_id) AS findings,
  (SELECT count(DISTINCT kind) FROM findings x WHERE x.scan_id = s.scan_id AND severity = 'high') AS high,
  (SELECT count(DISTINCT kind) FROM findings x WHERE x.scan_id = s.scan_id AND severity = 'medium') AS medium,
  (SELECT count(DISTINCT kind) FROM findings x WHERE x.scan_id = s.scan_id AND severity = 'low') AS low,
  (SELECT count(DISTINCT triggered_by) FROM api x WHERE x.scan_id = s.scan_id) AS pages
FROM (SELECT DISTINCT scan_id FROM api) s"""

ORACLES["row_digests"] = "SELECT '' || doc_id AS file, sha256(text) AS digest FROM documents"
ORACLES["verify_manifest"] = """
SELECT '' || doc_id AS file, CASE WHEN lang = 'fr' THEN 'missing' WHEN doc_id % 5 = 1 THEN 'mismatch' ELSE 'ok' END AS status FROM documents"""

# --- GraphQL -------------------------------------------------------------------

ORACLES["graphql_operations"] = _with(CALLS, GQL) + f"SELECT {KEY}, type, name, selections, arguments FROM gops"
ORACLES["graphql_introspection"] = _with(CALLS, GQL) + f"SELECT {KEY}, introspection FROM gintro"

# --- streams -------------------------------------------------------------------

_LIVE = f"""
SELECT {KEY}, count(*) AS count, count(*) FILTER (status = 0) AS failed, count(*) FILTER (status >= 400) AS errors,
  min(call_seq) AS first_seq, max(call_seq) AS last_seq, CAST(sum(c) AS BIGINT) AS duration_ms
FROM api GROUP BY ALL"""
ORACLES["stream_endpoints"] = _with(CALLS) + _LIVE


def _binned(value: str) -> str:
    """The middle of the values that share the eight leading binary digits."""
    shift = f"greatest(length(bin({value})) - 8, 0)"
    return f"(({value} >> {shift}) << {shift}) + (1::BIGINT << {shift}) // 2"


ORACLES["stream_latency"] = _with(CALLS) + f"""
SELECT {KEY}, ({_binned('p50')})::BIGINT AS p50, ({_binned('p95')})::BIGINT AS p95, top AS max
FROM (SELECT {KEY}, {RANK.format(v='c', p=0.5)} AS p50, {RANK.format(v='c', p=0.95)} AS p95, max(c) AS top FROM api GROUP BY ALL)"""
ORACLES["stream_resumed"] = ORACLES["stream_endpoints"]
ORACLES["stream_progress"] = _with(CALLS) + f"""
SELECT '{{"event":"done","scan_id":"' || scan_id || '","calls":' || sum(count) || ',"endpoints":' || count(*) || '}}' AS value
FROM ({_LIVE}) GROUP BY scan_id"""
ORACLES["stream_capped_frames"] = ORACLES["cap_frames"]
ORACLES["stream_body_budget"] = f"SELECT * FROM ({ORACLES['body_budget']}) WHERE body <> '(dropped)'"
ORACLES["stream_pairs"] = """
SELECT event_id AS request_id, CAST(round(value * 100) AS BIGINT) AS duration_ms FROM events WHERE CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) % 2 = 0"""

ORACLES["stream_unpaired"] = """
WITH sent AS (
  SELECT event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) % 2 = 1 AS odd, CAST(round(value * 100) AS BIGINT) AS c FROM events)
SELECT event_id AS request_id, 'unanswered' AS outcome FROM sent WHERE odd OR c > 5000
UNION ALL SELECT event_id, 'late' FROM sent WHERE NOT odd AND c > 5000"""

# --- stored and masked captures ------------------------------------------------

_MASK = """regexp_replace(request_body, '"email":"[^"]*"', '"email":"[REDACTED]"')"""
#: The sample capture with what a capture masks.
MASKED = CALLS.replace("calls AS (", "unmasked AS (", 1).replace(
    "api AS (",
    f"calls AS (SELECT * REPLACE ({_MASK} AS request_body, CASE WHEN cookie IS NOT NULL THEN '[REDACTED]' END AS cookie) FROM unmasked),\napi AS (",
    1,
)
CAPTURED = f"""
met AS (
  SELECT *, least(coalesce(length(request_body), 0), 60) AS rq,
    least(coalesce(length(CASE WHEN mime_type = 'application/json' THEN response_body END), 0), 60) AS rs
  FROM api WHERE {_SCOPED}
),
charged AS (
  SELECT *, row_number() OVER w AS nth, sum(rq + rs) OVER (w ROWS UNBOUNDED PRECEDING) AS total FROM met WINDOW w AS (PARTITION BY scan_id ORDER BY call_seq)
)
"""
ORACLES["captured_calls"] = _with(CALLS, CAPTURED) + f"""
SELECT scan_id, call_seq,
  CASE WHEN total - rs <= 60000 THEN ({_MASK})[1:60] END AS request_body,
  CASE WHEN total <= 60000 THEN response_body[1:60] END AS response_body,
  total <= 60000 AND coalesce(length(response_body) > 60, FALSE) AS response_body_truncated,
  CASE WHEN cookie IS NOT NULL THEN '[REDACTED]' END AS cookie,
  ((cookie IS NOT NULL)::INT + (contact IS NOT NULL)::INT
    + (total - rs <= 60000 AND coalesce(contains(request_body, '"email"'), FALSE))::INT)::INT AS secrets
FROM charged WHERE nth <= 1500"""
ORACLES["masked_endpoint_samples"] = _with(MASKED) + f"""
SELECT {KEY}, arg_min(request_body, call_seq) FILTER (request_body IS NOT NULL) AS request_body_sample,
  arg_min(response_body, call_seq) FILTER (response_body IS NOT NULL) AS response_body_sample
FROM api GROUP BY ALL"""
ORACLES["masked_sizes"] = _with(MASKED) + f"SELECT {KEY}, {_sizes('request')}, {_sizes('response')} FROM api GROUP BY ALL"
ORACLES["masked_schema_paths"] = ORACLES["schema_paths"].replace("'u' || user_id || '@example.com', NULL FROM kinds", "'[REDACTED]', NULL FROM kinds")

# --- cases the sample capture lacks ----------------------------------------------

ORACLES["target_verdicts"] = """
SELECT page_id, CASE page_id % 12 WHEN 6 THEN 'only http and https can be scanned' WHEN 7 THEN 'invalid URL'
  WHEN 1 THEN 'private or local address' WHEN 2 THEN 'private or local address' WHEN 3 THEN 'private or local address'
  WHEN 5 THEN 'private or local address' WHEN 8 THEN 'private or local address' WHEN 9 THEN 'private or local address'
  WHEN 10 THEN 'private or local address' ELSE 'accepted' END AS verdict
FROM pages"""
ORACLES["private_targets"] = "SELECT page_id, page_id % 12 IN (1, 2, 3, 5, 8, 9, 10) AS private_host FROM pages"
ORACLES["body_gap_kinds"] = """
SELECT event_id, event_id % 7 IN (1, 2, 6) AS "binary",
  CASE WHEN event_id % 5 = 1 THEN CASE WHEN event_id % 7 IN (1, 2, 6) THEN 'binary' WHEN event_id % 7 IN (0, 4, 5) THEN 'no-body' ELSE 'not-json' END
    WHEN event_id % 11 = 0 THEN 'truncated' WHEN event_id % 5 IN (2, 4) THEN 'not-json' ELSE '' END AS reason
FROM events"""
ORACLES["masked_keys"] = f"""
SELECT event_id, CASE event_id % 3
    WHEN 0 THEN '{{"Pass-Word":"{fv.REDACTED}","note":"x' || user_id || '","n":1}}'
    WHEN 1 THEN '{{"user":{{"api_key":["{fv.REDACTED}",7,{{"deep":"{fv.REDACTED}"}}],"id":"i' || user_id || '"}}}}'
    ELSE '[{{"clientSecret":null,"list":["a' || user_id || '"]}},{{"token":"{fv.REDACTED}"}}]' END AS body,
  CASE event_id % 3 WHEN 1 THEN 2 ELSE 1 END::INT AS secrets
FROM events"""
ORACLES["endpoints_with_contract"] = _with(CALLS, GAPS) + """
SELECT DISTINCT a.scan_id, a.id FROM api a JOIN gaps g USING (scan_id, method, url_pattern)
WHERE a.noun NOT IN ('login', 'users', 'products') AND (a.request_body IS NOT NULL OR a.response_body IS NOT NULL)
  OR g.request_rank IS NOT NULL OR g.response_rank IS NOT NULL OR a.ids > 0 OR a.gql"""
ORACLES["drifted_statuses"] = _with(*_COMPARED) + """
SELECT id, 'status codes ' || array_to_string(bs, ', ') || ' → ' || array_to_string(n, ', ')
    || CASE WHEN contains(id, '/api/users') AND len(list_filter(bs, lambda x: x BETWEEN 200 AND 299)) > 0 THEN ' (no longer returns 2xx)' ELSE '' END AS text,
  contains(id, '/api/users') AND len(list_filter(bs, lambda x: x BETWEEN 200 AND 299)) > 0 AS breaking
FROM (SELECT *, CASE WHEN contains(id, '/api/users') THEN [500, 503] WHEN contains(id, '/api/products') THEN [200, 304] ELSE s END AS n FROM pair) WHERE bs <> n"""
ORACLES["drifted_categories"] = _with(*_COMPARED) + """
SELECT id, 'category ' || bc || ' → ' || n AS text, FALSE AS breaking
FROM (SELECT *, CASE WHEN contains(id, '/api/login') THEN 'payments' ELSE c END AS n FROM pair) WHERE bc <> n"""
ORACLES["drifted_vendors"] = _with(CALLS, FIRST) + f"""
, named AS (SELECT DISTINCT scan_id, api.id FROM api JOIN endpoints USING ({KEY}) WHERE category IN ('analytics', 'third-party') AND api.host = 'api.segment.io'),
kept AS (SELECT id, length(id) % 3 AS kind FROM named GROUP BY id HAVING count(DISTINCT scan_id) = 2)
SELECT id, CASE kind WHEN 0 THEN 'vendor Segment → Other' ELSE 'vendor category analytics → ads' END AS text, FALSE AS breaking FROM kept WHERE kind < 2
UNION ALL SELECT id, 'vendor payload keys added: user', FALSE FROM kept WHERE kind = 2
UNION ALL SELECT id, 'vendor payload keys not observed this time: token', FALSE FROM kept WHERE kind = 2"""

ORACLES["contract_breaches"] = _with(CALLS) + """,
known AS (SELECT DISTINCT scan_id, id FROM api),
broken AS (
  SELECT * FROM known JOIN (VALUES ('orders', 'category', 'is not one of the known values'),
    ('users', 'status_codes', 'repeats an element'), ('users', 'status_codes', 'is not in order'), ('users', 'status_codes[1]', 'is more than 599'),
    ('login', 'count', 'is less than 1'), ('track', 'timing', 'has p50 above p95'), ('track', 'timing.max', 'is missing')) b(noun, path, problem)
  ON contains(id, '/api/' || noun))
SELECT 'endpoints' AS "table", scan_id, id, path, problem FROM broken"""

ORACLES["sorted_endpoints"] = _with(CALLS, FIRST) + """
SELECT scan_id, id, row_number() OVER (ORDER BY scan_id, category, id) AS position FROM endpoints"""
_BY = """
SELECT e.id, row_number() OVER (ORDER BY {order}, e.category, e.id) AS position
FROM endpoints e JOIN (SELECT scan_id, id, count(*) AS n, count(DISTINCT triggered_by) AS pages FROM api GROUP BY ALL) c
  ON c.scan_id = e.scan_id AND c.id = e.id
WHERE e.scan_id = '{scan}'"""
ORACLES["endpoints_by_count"] = _with(CALLS, FIRST) + _BY.format(order="n DESC", scan="after")
ORACLES["endpoints_by_pages"] = _with(CALLS, FIRST) + _BY.format(order="pages", scan="before")

# --- what is written is read back ------------------------------------------------

ORACLES["read_calls"] = _with(CALLS) + f"""
SELECT scan_id, call_seq, method, mime_type, status, {_normalized('page_url')} AS triggered_by, request_body FROM calls"""
ORACLES["read_failures"] = _with(CALLS) + """
SELECT scan_id, call_seq, method, 0 AS status, '' AS mime_type, c AS duration_ms, 0 AS headers FROM calls WHERE status = 0"""
ORACLES["read_frames"] = _with(FRAMES) + """
SELECT conn_seq, frame_seq, CASE WHEN frame_seq % 3 = 1 THEN 'binary' ELSE 'text' END AS type,
  CASE WHEN frame_seq % 3 = 1 THEN base64(encode(payload)) ELSE payload END AS payload, octet_length(encode(payload))::BIGINT AS size FROM frames"""
ORACLES["report_read_back"] = f"SELECT {KEY}, calls, statuses FROM ({ORACLES['endpoint_rollup']})"
ORACLES["snapshot_read_back"] = f"SELECT {KEY}, calls FROM ({ORACLES['endpoint_rollup']})"
ORACLES["signals_read_back"] = ORACLES["signals"]
ORACLES["payloads_read_back"] = ORACLES["spill_budget"]
