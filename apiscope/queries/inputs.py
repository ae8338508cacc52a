"""Tables derived from the given ones, as SQL both engines run.

Each entry is (tables read, SELECT text).  Braces are doubled because the text
is formatted with the table names.
"""

from __future__ import annotations

_NL = " || chr(10) || "

_PAGE_PARTS = """
SELECT page_id, url, html,
  split_part(url, '/', 3) AS host,
  split_part(url, '/', 4) AS lang,
  regexp_replace(split_part(url, '/', 5), '[^0-9].*$', '') AS num,
  CAST(page_id % 5 + 1 AS STRING) AS v
FROM {pages}
"""

_INVENTORY = """
SELECT page_id AS ord,
  CASE page_id % 10
    WHEN 0 THEN '/api/v' || v || '/users/{{' || lang || '_id}}/'
    WHEN 1 THEN '/api/v2/orders/:' || lang || 'Order/items'
    WHEN 2 THEN 'https://' || host || '/api/v1/products/' || num
    WHEN 3 THEN '/rest/items/<' || lang || '>'
    WHEN 4 THEN '/graphql'
    WHEN 5 THEN '/admin/settings/' || lang || '?debug=1&role=' || lang || '&x'
    WHEN 6 THEN '/static/' || lang || '/app.js'
    WHEN 7 THEN url
    WHEN 8 THEN '/api/v3/payment_methods/' || num || '?trace=on'
    ELSE '/v' || CAST(page_id % 7 AS STRING) || '/auth/' || lang || '-tokens/'
  END AS url,
  CASE page_id % 4 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' WHEN 2 THEN 'PUT' ELSE 'DELETE' END
    AS method,
  CASE page_id % 6 WHEN 0 THEN 'discovered' WHEN 1 THEN 'verified' WHEN 2 THEN 'zombie'
    WHEN 3 THEN 'shadow' WHEN 4 THEN 'unprotected' ELSE 'documented' END AS status,
  CASE WHEN page_id % 3 = 0 THEN CAST(NULL AS INT)
    ELSE CAST(200 + 100 * (page_id % 4) AS INT) END AS http_status,
  page_id % 9 = 0 AS deprecated,
  host || '/' || lang || '/bundle.js' AS file,
  CAST(length(html) % 997 AS INT) AS line,
  CAST(page_id % 80 AS INT) AS col,
  'https://' || host || '/' || lang || '/x/' AS base_url,
  'scan-' || lang AS scan_id
FROM {page_parts}
"""

_SPEC = """
SELECT page_id AS ord,
  CASE page_id % 7
    WHEN 0 THEN '/api/v' || v || '/users/{{userId}}'
    WHEN 1 THEN '/api/v2/orders/{{order}}/items'
    WHEN 2 THEN '/rest/items/{{item}}'
    WHEN 3 THEN '/graphql'
    WHEN 4 THEN '/api/v1/products/' || num
    WHEN 5 THEN '/' || lang || '/' || num
    ELSE '/v' || CAST(page_id % 7 AS STRING) || '/auth/' || lang || '-tokens'
  END AS path,
  CASE WHEN page_id % 7 = 5 OR page_id % 4 = 0 THEN 'GET' WHEN page_id % 4 = 1 THEN 'POST'
    WHEN page_id % 4 = 2 THEN 'PUT' ELSE 'DELETE' END AS method,
  length(html) % 3 = 0 AS deprecated
FROM {page_parts}
"""

_SOURCE_LINES = [
    "'// see \"/api/v9/comment\" here'",
    "'const API_BASE = \"https://' || host || '/api/v' || v || '\";'",
    "'let USERS = ''/users/' || num || ''';'",
    "'const TPL = `/api/v1/' || lang || '/tpl`;'",
    "'const cfg = {{ list: \"/api/v2/list/' || num || '\", baseUrl: ''https://' || host || ''' }};'",
    "'/* ' || html || ' */'",
    "'fetch(API_BASE + USERS);'",
    "'fetch(\"/api/v' || v || '/items/' || num || '\");'",
    "'fetch(`/rest/' || lang || chr(36) || '{{USERS}}/x/' || chr(36) || '{{nope}}/' || chr(36) || '{{cfg.list}}`);'",
    "'axios.post(''/api/v1/orders/' || num || ''', body);'",
    "'axios({{ method: \"get\", url: \"/api/v1/conf/' || lang || '\" }});'",
    "'xhr.open(\"PUT\", \"/api/v4/x/' || num || '\");'",
    "'$.ajax({{ type: \"POST\", url: ''/api/v1/ajax/' || num || ''' }});'",
    "'axios({{ headers: {{ a: \"b}}\", url: \"/api/v1/no/' || num || '\" }}, method: \"post\", url: \"/api/v1/nested/' || num || '\" }});'",
    "'$.ajax({{ url: ''/api/v1/first/' || num || ''', data: {{ x: [1, {{ url: ''/api/v1/inner'' }}] }} }}).done(() => axios({{ data: {{ q: f({{ y: 1 }}) }}, /* url: \"/api/v1/note\" */ url: \"/api/v1/late/' || lang || '\" }}));'",
    "'wrap({{ url: \"/api/v1/bare/' || num || '\" }}); axios(pick({{ url: \"/api/v1/deep\" }}), {{ url: ''/api/v1/second/' || num || ''' }});'",
    "'router.delete(\"/api/v1/route/' || num || '\", handler);'",
    "'  request(TPL); api.get(cfg.list); load().put(\"/ws/' || num || '\");'",
    "'fetch(MISSING + \"/api/tail/' || num || '\" + USERS);'",
    "'fetch(\"/api/a' || chr(92) || '/b/' || num || '\");'",
    "'axios.get(\"/api/it' || chr(92) || '\"s/' || num || '\"); httpClient(\"/api/one/' || num || '\");'",
    "'fetch(\"/api/p0/' || num || '\" + ' || repeat('USERS + \"/k\" + ', 9) || 'USERS);'",
    "'//# sourceMappingURL=../maps/' || lang || '.js.map'",
]
_PYTHON_LINES = [
    "'# see \"/api/v9/comment\" here'",
    "'API_HOST = \"https://' || host || '\"'",
    "'USERS = ''/api/v1/users/' || num || ''''",
    "'doc = \"\"\"' || html || '\"\"\"'",
    "'requests.get(\"/api/v' || v || '/items/' || num || '\")'",
    "'requests.post(USERS)'",
    "'httpx.put(f''/rest/' || lang || '/' || num || ''')'",
    "'session.delete(\"/api/v1/orders/' || num || '\")'",
    "'urllib.request.urlopen(\"https://' || host || '/api/v3/' || num || '\")'",
    "'@app.route(\"/api/v1/route/' || num || '\")'",
    "'@app.post(''/graphql/' || lang || ''')'",
    "'    path(r\"/api/v5/django/' || num || '\", view),'",
    "'    re_path(r\"^api/v1/users/(' || chr(92) || 'd+)/' || num || '/$\", view),'",
    "'requests.get(\"/api/it' || chr(92) || '\"s/' || num || '\")'",
]

_SOURCES = f"""
SELECT page_id,
  'src/' || host || '/' || CAST(page_id AS STRING)
    || CASE page_id % 5 WHEN 0 THEN '.py' WHEN 1 THEN '.ts' WHEN 2 THEN '.jsx'
       WHEN 3 THEN '.JS' ELSE '.mjs' END AS file,
  CASE page_id % 5 WHEN 0 THEN 'python' WHEN 1 THEN 'typescript' ELSE 'javascript' END
    AS language,
  CASE WHEN page_id % 5 = 0 THEN {_NL.join(_PYTHON_LINES)}
       ELSE {_NL.join(_SOURCE_LINES)} END || chr(10) AS text
FROM {{page_parts}}
"""

# names given to names: a chain, its order mixed, and a cycle; the end is a name of the source, or none
_ALIASED = """
SELECT page_id, file, language, text || 'const L3 = L2;' || chr(10) || 'let L1 = API_BASE' || chr(10)
  || CASE WHEN page_id % 3 = 0 THEN '' ELSE 'var L2 = L1;L4 = L3' || chr(10) END
  || 'const L5 = L4; const U = API_HOST;' || chr(10) || 'const P' || v || ' = Q; const Q = P2; var M = NONE;' || chr(10)
  || 'fetch(L5 + "/deep/' || num || '"); requests.get(U); axios.get(P2 + "/cyclic"); fetch(M)' || chr(10) AS text
FROM (SELECT s.*, num, v FROM {sources} s JOIN {page_parts} p ON p.page_id = s.page_id)
"""

_MARKUPS = """
SELECT page_id, 'site/' || host || '/' || CAST(page_id AS STRING) || '.html' AS file, 'html' AS language,
  '<!-- "/api/v9/hidden" -->' || chr(10) || '<a href="/api/v' || v || '/items/' || num || '">t</a>'
  || chr(10) || '<form action=' || chr(39) || '/auth/' || lang || chr(39) || '><b data-u="/static/'
  || lang || '">' || chr(10) || html || chr(10)
  || '<i data-q="/graphql?p=' || num || '"></i>' AS text
FROM {page_parts}
"""

_PATHS = """
SELECT page_id,
  CASE page_id % 3 WHEN 0 THEN 'app/' WHEN 1 THEN 'app/node_modules/' ELSE 'lib/__pycache__/' END
    || host || '/' || num || CASE page_id % 8 WHEN 0 THEN '.js' WHEN 1 THEN '.JSX'
    WHEN 2 THEN '.ts' WHEN 3 THEN '.py' WHEN 4 THEN '.pyw' WHEN 5 THEN '.css'
    WHEN 6 THEN '.tsx' ELSE '' END AS file
FROM {page_parts}
"""

_RESPONSES = """
SELECT page_id AS ord, 'GET' AS method, url,
  CASE page_id % 13 WHEN 0 THEN 200 WHEN 1 THEN 201 WHEN 2 THEN 204 WHEN 3 THEN 301
    WHEN 4 THEN 302 WHEN 5 THEN 400 WHEN 6 THEN 401 WHEN 7 THEN 403 WHEN 8 THEN 404
    WHEN 9 THEN 405 WHEN 10 THEN 429 WHEN 11 THEN 500 ELSE 418 END AS status_code,
  page_id % 11 <> 3 AS success,
  html || CASE page_id % 12
    WHEN 0 THEN 'Traceback (most recent call last)'
    WHEN 1 THEN ' at com.acme.Main.run(Main.java:' || num || ')'
    WHEN 2 THEN 'MySQL syntax ERROR near ' || num
    WHEN 3 THEN 'Access denied for ' || lang
    WHEN 4 THEN '<p>This API is Deprecated. Use v2 instead.</p>'
    WHEN 5 THEN '<p>Legacy service</p>'
    WHEN 6 THEN 'Copyright (c) ' || CAST(2010 + page_id % 17 AS STRING) || ' X'
    WHEN 7 THEN 'goroutine 7 [running]'
    WHEN 8 THEN '"role": "admin", "plan": "Premium"'
    ELSE '' END AS body,
  CASE page_id % 3 WHEN 0 THEN 'application/json; charset=utf-8' WHEN 1 THEN 'text/XML'
    ELSE 'text/html' END AS content_type,
  CASE WHEN page_id % 7 = 0 THEN '*' ELSE 'https://' || host END AS cors,
  CASE page_id % 8 WHEN 0 THEN 'true' WHEN 1 THEN '2024-01-' || CAST(10 + page_id % 15 AS STRING)
    WHEN 2 THEN '2023-11-05T10:20:30Z' WHEN 3 THEN 'Wed, 21 Oct 2015 07:28:00 GMT'
    WHEN 4 THEN '2024-02-03T04:05:06+0200' WHEN 5 THEN 'soon' ELSE '' END AS deprecation,
  CASE page_id % 10 WHEN 0 THEN '2026-06-30' WHEN 1 THEN 'never' ELSE '' END AS sunset,
  CASE page_id % 9 WHEN 0 THEN '<https://' || host || '>; rel="sunset"'
    WHEN 1 THEN '<https://' || host || '>; rel="next"' ELSE '' END AS link,
  CASE page_id % 14 WHEN 0 THEN '1' ELSE '' END AS x_deprecated,
  CASE page_id % 15 WHEN 0 THEN '299 - "Deprecated API"' WHEN 1 THEN '199 - misc' ELSE '' END
    AS warning,
  CASE page_id % 6 WHEN 0 THEN 'Apache/1.3.' || v WHEN 1 THEN 'nginx/0.8' WHEN 2 THEN 'nginx/1.25'
    WHEN 3 THEN 'x PHP/5.3.3' WHEN 4 THEN 'Python/2.7' ELSE '' END AS server
FROM {page_parts}
"""

_PROBES = """
SELECT ord, method, url, success,
  CASE WHEN success THEN status_code END AS http_status,
  success AND (deprecation <> '' OR sunset <> '') AS has_deprecation_header
FROM {responses}
"""

_SPEC_DOCS = """
SELECT page_id AS spec_id, 'json' AS format,
  CASE page_id % 3
  WHEN 0 THEN '{{"openapi":"3.0.3","servers":[{{"url":"https://' || host || '/' || v || '"}}],'
  WHEN 1 THEN '{{"swagger":"2.0","basePath":"/' || lang || '","host":"' || host
    || CASE WHEN page_id % 2 = 0 THEN '","schemes":["http","https"],' ELSE '",' END
  ELSE '{{"title":"' || lang || '",' END
  || '"paths":{{"/users/{{id}}":{{"get":{{"summary":"List ' || lang || '","tags":["' || lang
  || '","u"]}},"post":{{"summary":"Create","deprecated":true}},"x-note":"n"}},"/items/' || num
  || '":{{"delete":{{"deprecated":' || CASE WHEN page_id % 2 = 0 THEN 'true' ELSE 'false' END
  || ',"responses":{{"200":{{"description":"' || num || '"}}}}}}}},"/note":"text"}}}}' AS text
FROM {page_parts}
"""

_CAPTURE_INDEX = """
SELECT page_id, host,
  '[["timestamp","original","mimetype","statuscode"],["2024' || lpad(CAST(page_id % 12 + 1 AS STRING), 2, '0')
  || '15103000","' || url || '","application/javascript","200"],["20230101000000","'
  || replace(replace(url, 'https://', 'http://'), 'www.', '') || '","text/html","'
  || CASE WHEN page_id % 4 = 0 THEN '404' ELSE '200' END || '"],["20240101","short"],["bad","x","y","oops"]]'
  AS json
FROM {page_parts}
"""

_CERTIFICATES = """
SELECT split_part(host, '.', -2) || '.' || split_part(host, '.', -1) AS domain,
  '[{{"name_value":"' || upper(host) || chr(92) || 'n*.' || lang || '.' || host || '"}},{{"name_value":" '
  || 'not' || split_part(host, '.', -2) || '.' || split_part(host, '.', -1) || ' ' || chr(92) || 'n'
  || split_part(host, '.', -2) || '.' || split_part(host, '.', -1) || '"}}]' AS json,
  host, lang
FROM {page_parts}
"""

_CERT_NAMES = """
SELECT split_part(host, '.', -2) || '.' || split_part(host, '.', -1) AS domain,
  upper(host) || chr(10) || '*.' || lang || '.' || host || chr(10) || ' not'
  || split_part(host, '.', -2) || '.' || split_part(host, '.', -1) || ' ' || chr(10)
  || split_part(host, '.', -2) || '.' || split_part(host, '.', -1) AS name_value
FROM {page_parts}
"""

_FINDING_LINES = """
SELECT page_id, CASE page_id % 5
  WHEN 0 THEN '{{"template-id":"t-' || num || '","info":{{"name":"N ' || lang
    || '","severity":"high","description":"d"}},"host":"' || host || '","matched-at":"' || host
    || '/x","extracted-results":["a","' || num || '"],"curl-command":"curl"}}'
  WHEN 1 THEN '{{"template-id":"t-' || num || '","info":{{"severity":"info"}}}}'
  WHEN 2 THEN '{{"template-id": broken'
  WHEN 3 THEN '  {{"info":{{"name":"L","severity":"low"}},"host":"' || host || '"}}  '
  ELSE '{{"template-id":"m","info":{{"name":"M","severity":"medium"}}}}' END AS value
FROM {page_parts}
"""

_REPORTS = """
SELECT page_id, '{{"scan_id":"s' || CAST(page_id AS STRING) || '","target":"' || host
  || '","duration_seconds":' || num || '.5,"total_files_scanned":' || v
  || ',"endpoints":[{{"url":"/api/v1/' || num || '","method":"POST","source":{{"file":"a.js","line":'
  || v || ',"column":2,"context":"c"}},"path_params":["id"],"query_params":["q"],"headers":{{"A":"' || lang
  || '"}},"status":"verified","http_status":200}},{{"url":"/api/' || lang
  || '"}}],"secrets":[{{"type":"k","value":"' || num || 'abcdefghijklm","source":{{"file":"b.js","line":7}}}}],'
  || '"errors":["e1","' || lang || '"],"warnings":[]}}' AS text
FROM {page_parts}
"""

_INTROSPECTION = """
SELECT page_id, url, CASE page_id % 3
  WHEN 0 THEN '{{"queryType":{{"name":"Root"}},"types":[{{"name":"Root","kind":"OBJECT","fields":['
  WHEN 1 THEN '{{"queryType":{{"name":"Q"}},"mutationType":{{"name":"Root"}},"types":[{{"name":"Root","fields":['
  ELSE '{{"types":[{{"name":"Query","fields":[' END
  || '{{"name":"get' || lang || '","args":[{{"name":"id","type":{{"name":"ID"}}}},{{"name":"n' || num
  || '","type":{{"name":null,"kind":"LIST"}}}}],"type":{{"name":"T' || num || '"}}}},{{"name":"all' || v
  || '","args":[],"type":{{"name":null}}}}]}},{{"name":"Other","fields":null}},{{"name":"Mutation","fields":['
  || '{{"name":"set' || lang || '","args":null,"type":{{"name":"Boolean"}}}}]}}]}}' AS schema_json
FROM {page_parts}
"""

_REQUEST_LOG = """
SELECT event_id AS ord, ts, CAST(user_id AS STRING) AS key,
  CASE WHEN event_type = 'error' THEN 429 ELSE 200 END AS status_code,
  CASE WHEN value < 20 THEN CAST(floor(value * 3600) AS INT) ELSE 0 END AS retry_after
FROM {events}
"""

_TARGET_RESULTS = """
SELECT 'user-' || CAST(user_id AS STRING) AS target,
  CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'skipped' ELSE 'success' END
    AS status,
  CAST(floor(value) AS BIGINT) AS endpoints_found, event_id % 3 AS secrets_found,
  CAST(floor(value * 100) AS BIGINT) AS duration_seconds
FROM {events}
"""

_TARGET_LINES = """
SELECT page_id, CASE page_id % 6 WHEN 0 THEN '  ' || host || '  ' WHEN 1 THEN '# ' || host
  WHEN 2 THEN ' #' || host WHEN 3 THEN '   ' WHEN 4 THEN url ELSE 'HTTP://' || host END AS value
FROM {page_parts}
"""

_URL_CASES = """
SELECT page_id, CASE page_id % 18
  WHEN 0 THEN url
  WHEN 1 THEN ''
  WHEN 2 THEN host || '/' || num
  WHEN 3 THEN 'ftp://' || host || '/' || num
  WHEN 4 THEN 'https:///' || num
  WHEN 5 THEN 'https://user:pw' || num || '@' || host || '/x'
  WHEN 6 THEN 'http://10.0.' || v || '.' || CAST(page_id % 200 AS STRING) || '/a'
  WHEN 7 THEN 'http://localhost:' || num || '/api'
  WHEN 8 THEN 'https://metadata.google.internal/' || num
  WHEN 9 THEN 'https://10.' || host || '/x'
  WHEN 10 THEN 'https://' || upper(host) || ':8443/x'
  WHEN 11 THEN 'file:///etc/' || lang
  WHEN 12 THEN 'https://100.64.' || host || '/y'
  WHEN 13 THEN 'http://192.168.' || host
  WHEN 14 THEN host || ':80/' || num
  WHEN 15 THEN 'https://admin.' || host || '?q=' || num
  WHEN 16 THEN 'https://172.' || CAST(page_id % 40 AS STRING) || '.' || host
  ELSE 'HTTPS://' || host || '#top' END AS url
FROM {page_parts}
"""

_REFERENCES = """
SELECT page_id, url AS base, CASE page_id % 14
  WHEN 0 THEN '/api/' || num
  WHEN 1 THEN '../' || lang || '/' || num
  WHEN 2 THEN './a/./b/../' || num
  WHEN 3 THEN '//' || host || '/x?y=' || num
  WHEN 4 THEN '?page=' || num
  WHEN 5 THEN '#s' || num
  WHEN 6 THEN ''
  WHEN 7 THEN 'mailto:' || lang || '@' || host
  WHEN 8 THEN '../../../../' || num || '#z'
  WHEN 9 THEN num || '/'
  WHEN 10 THEN '..'
  WHEN 11 THEN 'https://' || host || '/abs/../' || num
  WHEN 12 THEN '/a//b/' || num || '/.'
  ELSE 'data:text/plain,' || num END AS ref
FROM {page_parts}
"""

_ASSETS = """
SELECT page_id AS ord, 'https://' || host || '/assets/' || lang || CASE page_id % 5
    WHEN 0 THEN '.js' WHEN 1 THEN '.js?v=' || num WHEN 2 THEN '.map' WHEN 3 THEN '.css'
    ELSE '/data' END AS url,
  CASE page_id % 4 WHEN 0 THEN 'Application/JavaScript; charset=utf-8' WHEN 1 THEN 'text/css'
    WHEN 2 THEN 'text/ecmascript' ELSE CAST(NULL AS STRING) END AS content_type,
  CASE WHEN page_id % 3 = 0 THEN CAST(NULL AS BIGINT)
    ELSE CAST(length(html) AS BIGINT) * 3000 END AS content_length,
  CASE page_id % 4 WHEN 0 THEN 'script' WHEN 1 THEN 'source_map' WHEN 2 THEN 'archived'
    ELSE 'host' END AS kind
FROM {page_parts}
"""

DERIVED: dict[str, tuple[tuple[str, ...], str]] = {
    "page_parts": (("pages",), _PAGE_PARTS),
    "inventory": (("page_parts",), _INVENTORY),
    "spec": (("page_parts",), _SPEC),
    "sources": (("page_parts",), _SOURCES),
    "markups": (("page_parts",), _MARKUPS),
    "paths": (("page_parts",), _PATHS),
    "responses": (("page_parts",), _RESPONSES),
    "probes": (("responses",), _PROBES),
    "spec_docs": (("page_parts",), _SPEC_DOCS),
    "capture_index": (("page_parts",), _CAPTURE_INDEX),
    "certificates": (("page_parts",), _CERTIFICATES),
    "cert_names": (("page_parts",), _CERT_NAMES),
    "finding_lines": (("page_parts",), _FINDING_LINES),
    "reports": (("page_parts",), _REPORTS),
    "introspection": (("page_parts",), _INTROSPECTION),
    "aliased": (("sources", "page_parts"), _ALIASED),
    "request_log": (("events",), _REQUEST_LOG),
    "target_results": (("events",), _TARGET_RESULTS),
    "target_lines": (("page_parts",), _TARGET_LINES),
    "url_cases": (("page_parts",), _URL_CASES),
    "refs": (("page_parts",), _REFERENCES),
    "assets": (("page_parts",), _ASSETS),
}
