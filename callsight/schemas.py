"""Table schemas the readers apply; nothing is inferred on read."""

CALLS = """
  scan_id STRING, call_seq BIGINT, method STRING, url STRING, status INT, mime_type STRING,
  resource_type STRING, request_headers MAP<STRING,STRING>, request_body STRING,
  response_headers MAP<STRING,STRING>, response_body STRING, response_body_truncated BOOLEAN,
  request_body_file STRING, response_body_file STRING, started_at BIGINT, duration_ms BIGINT,
  triggered_by STRING
"""

FAILED_CALLS = """
  scan_id STRING, call_seq BIGINT, method STRING, url STRING, resource_type STRING,
  request_headers MAP<STRING,STRING>, started_at BIGINT, duration_ms BIGINT, triggered_by STRING
"""

SOCKETS = """
  scan_id STRING, conn_seq BIGINT, url STRING, triggered_by STRING, opened_at BIGINT, closed_at BIGINT
"""

FRAMES = """
  scan_id STRING, conn_seq BIGINT, frame_seq BIGINT, direction STRING, type STRING, payload STRING,
  size BIGINT, truncated BOOLEAN, at BIGINT
"""

RAW_FRAMES = """
  scan_id STRING, conn_seq BIGINT, frame_seq BIGINT, direction STRING, text STRING, data BINARY, at BIGINT
"""

PAGES = """
  scan_id STRING, page_seq BIGINT, url STRING, normalized_url STRING, depth INT, title STRING, visited_at BIGINT
"""

PAGE_EVIDENCE = """
  scan_id STRING, page_seq BIGINT, url STRING, headers MAP<STRING,STRING>, html STRING,
  cookies ARRAY<STRING>, scripts ARRAY<STRING>
"""

ROBOTS = "origin STRING, raw STRING"

SCOPE = """
  scan_id STRING, seed_url STRING, include_hosts ARRAY<STRING>, exclude_paths ARRAY<STRING>,
  include_third_party BOOLEAN
"""

PERCENTILES = "STRUCT<p50:BIGINT,p95:BIGINT,max:BIGINT>"

# The part of a stored report document the comparison reads.
SNAPSHOT = """
  schemaVersion INT,
  meta STRUCT<seedUrl:STRING,startedAt:STRING,engine:STRING,pagesVisited:BIGINT,durationMs:BIGINT>,
  endpoints ARRAY<STRUCT<
    id:STRING, method:STRING, urlPattern:STRING, origins:ARRAY<STRING>, category:STRING, count:BIGINT,
    statusCodes:ARRAY<INT>, requestHeaders:MAP<STRING,STRING>, responseHeaders:MAP<STRING,STRING>,
    pathParams:ARRAY<STRING>, queryParams:ARRAY<STRUCT<name:STRING,sampleValues:ARRAY<STRING>>>,
    requestBodySchema:VARIANT, requestBodySchemaReason:STRING,
    responseSchema:VARIANT, responseSchemaReason:STRING,
    errorResponses:ARRAY<STRUCT<status:INT,count:BIGINT,bodySample:STRING,schema:VARIANT,schemaReason:STRING>>,
    mimeTypes:ARRAY<STRING>, triggeredBy:ARRAY<STRING>,
    timing:STRUCT<p50:BIGINT,p95:BIGINT,max:BIGINT>,
    responseBytes:STRUCT<p50:BIGINT,p95:BIGINT,max:BIGINT>,
    vendor:STRUCT<name:STRING,category:STRING,payloadKeys:ARRAY<STRING>>,
    graphql:STRUCT<introspection:BOOLEAN,operations:ARRAY<STRUCT<
      name:STRING,type:STRING,selections:ARRAY<STRING>,arguments:ARRAY<STRING>>>>>>,
  webSockets ARRAY<STRUCT<url:STRING,frameCount:BIGINT,sentCount:BIGINT,receivedCount:BIGINT>>
"""
