"""The same results as :mod:`table_queries`, said in DuckDB SQL over the same tables."""

from __future__ import annotations

PATHS = r"""
paths AS (
  SELECT page_id, url, regexp_extract(url, '^([a-z]+)://', 1) AS scheme,
         regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host,
         regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path
  FROM pages)"""

# Prefixes of the whole path, of its first folder and of the root, less one trailing slash; the bare pattern gives none.
PREFIXES = PATHS + r""",
prefixes AS (
  SELECT DISTINCT scheme AS descriptor_set, host AS service, regexp_replace(literal, '/$', '') AS prefix
  FROM (SELECT scheme, host, path AS literal FROM paths
        UNION ALL SELECT scheme, host, regexp_extract(path, '^(/[^/]+/)', 1) FROM paths
        UNION ALL SELECT scheme, host, '/' FROM paths WHERE page_id % 2 = 0
        UNION ALL SELECT scheme, host, '//' FROM paths WHERE page_id % 4 = 0)
  WHERE starts_with(literal, '/'))"""

SERVICE_RULES = PREFIXES + r""",
rules AS (
  SELECT DISTINCT descriptor_set, service, '^' || CASE WHEN prefix = '' THEN '/' ELSE prefix END AS rule FROM prefixes)"""

SERVICE_URIS = PREFIXES + r""",
uris AS (
  SELECT descriptor_set, service, 'http://:9000' || prefix || '?preservePath' AS uri FROM prefixes
  UNION SELECT scheme, host, 'http://:9000/' || host FROM paths)"""

CUSTOMER_RULES = r"""
raw AS (
  SELECT c_name AS bundle, c_mktsegment AS label, 0 AS acl_pos, 0 AS request_pos, 'http' AS family, 'GET' AS method,
         '/c/' || c_custkey AS path, false AS is_regex, NULL AS rewrite, NULL::INTEGER AS port FROM customer
  UNION ALL SELECT c_name, c_mktsegment, 0, 1, 'http', NULL, '^/n/' || c_nationkey, true, '/all', NULL FROM customer
  UNION ALL SELECT c_name, c_mktsegment, 0, 2, 'http', CASE WHEN c_acctbal < 0 THEN 'PATCH' ELSE 'PUT' END,
         '/[0-9]+/' || c_custkey, true, NULL, NULL FROM customer
  UNION ALL SELECT c_name, c_mktsegment, 1, 0, 'tcp', NULL, NULL, NULL, NULL, 9000 FROM customer
  UNION ALL SELECT c_name, c_mktsegment, 1, 1, 'tcp', NULL, NULL, NULL, NULL, 9000 + c_nationkey FROM customer
            WHERE c_nationkey <> 0
  UNION ALL SELECT c_name, c_mktsegment, 2, 0, 'udp', NULL, NULL, NULL, NULL, 19000 + c_nationkey FROM customer)"""

REPORT = r"""
gate AS (
  SELECT p_partkey::VARCHAR AS bundle, 'version' AS rule, NULL::VARCHAR AS label,
         'access rules are enabled, but target version 1.1 has none' AS message
  FROM part WHERE p_retailprice < 950 AND p_type = 'STANDARD'),
low AS (
  SELECT p_partkey::VARCHAR, 'memory', NULL::VARCHAR, 'memory of ' || p_size || ' MiB is below the minimum of 24 MiB'
  FROM part WHERE p_size < 24),
both_kinds AS (
  SELECT l_partkey::VARCHAR, 'endpoint', l_orderkey || '-' || l_linenumber || '-' || l_suppkey,
         'endpoint ''' || l_orderkey || '-' || l_linenumber || '-' || l_suppkey || ''' declares both rules and services'
  FROM lineitem WHERE l_returnflag <> 'R' AND l_tax >= 0.08 AND l_discount >= 0.1),
report AS (SELECT * FROM gate UNION ALL SELECT * FROM low UNION ALL SELECT * FROM both_kinds)"""

# A nation may define memory, a region defines four settings; both are targets too.
RESOLVED = r"""
nations AS (
  SELECT 'n' || n_nationkey AS target, n_nationkey, r_name,
         CASE WHEN n_regionkey < 3 THEN (n_nationkey + 100)::VARCHAR ELSE '64' END AS memory,
         CASE WHEN n_regionkey < 3 THEN 'n' || n_nationkey END AS memory_scope
  FROM nation JOIN region ON n_regionkey = r_regionkey),
customers AS (
  SELECT 'c' || c_custkey AS target, c.*, memory, memory_scope, r_name
  FROM customer c JOIN nations ON c_nationkey = n_nationkey),
places AS (
  SELECT target, r_name, '1' AS cpus, NULL AS cpus_scope, memory, memory_scope, r_name AS role, NULL AS role_scope,
         NULL AS checks FROM nations
  UNION ALL SELECT 'r' || r_regionkey, r_name, '1', NULL, '64', NULL, r_name, NULL, NULL FROM region
  UNION ALL SELECT target, r_name, CASE WHEN c_acctbal < 0 THEN '2' ELSE '1' END,
         CASE WHEN c_acctbal < 0 THEN target END, memory, memory_scope,
         CASE WHEN c_mktsegment = 'BUILDING' THEN c_mktsegment ELSE r_name END,
         CASE WHEN c_mktsegment = 'BUILDING' THEN target END,
         CASE WHEN c_mktsegment = 'MACHINERY' THEN c_name END FROM customers),
resolved AS (
  SELECT target, 'name' AS key, lower(r_name) AS value, NULL AS scope FROM places
  UNION ALL SELECT target, 'nrOfCpus', cpus, cpus_scope FROM places
  UNION ALL SELECT target, 'memory', memory, memory_scope FROM places
  UNION ALL SELECT target, 'roles', '["' || role || '"]', role_scope FROM places
  UNION ALL SELECT target, 'checks', '["' || checks || '"]', target FROM places WHERE checks IS NOT NULL)"""

OVERRIDES = r"""
base AS (SELECT s_nationkey AS entity, s_name AS label, s_suppkey + 9000 AS port FROM supplier),
defined AS (SELECT n_nationkey AS entity FROM nation WHERE n_regionkey < 2),
over AS (
  SELECT c_nationkey AS entity, c_name AS label, c_custkey + 8000 AS port FROM customer
  WHERE c_nationkey IN (SELECT entity FROM defined))"""

URIS = r"""
uris AS (
  SELECT 'http://:' || (s_suppkey + 9000) || '/' || s_suppkey AS uri, (s_suppkey + 9000)::INTEGER AS port FROM supplier
  UNION ALL SELECT 'tcp://host-' || s_suppkey || ':' || (s_nationkey + 7000), s_nationkey + 7000 FROM supplier
  UNION ALL SELECT 'http://host-' || s_suppkey || '/x', -1 FROM supplier
  UNION ALL SELECT 'http://:port' || s_suppkey, NULL FROM supplier
  UNION ALL SELECT url, CASE WHEN regexp_matches(url, '^[a-z]+://[^/?#]+:[0-9]+([/?#]|$)')
                             THEN regexp_extract(url, '^[a-z]+://[^/?#]+:([0-9]+)', 1)::INTEGER ELSE -1 END FROM pages)"""

EVENT_FOLD = r"""
e AS (SELECT user_id, ts, event_id, event_type AS kind, value, json_extract_string(props, '$.k') AS k FROM events),
folded AS (
  SELECT user_id, 'log_level' AS field, 'last' AS rule, NULL::BIGINT AS pos, NULL::VARCHAR AS key,
         arg_max(kind, (ts, event_id)) AS value FROM e GROUP BY user_id
  UNION ALL SELECT user_id, 'args', 'append', row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id), NULL,
         kind || '-' || k FROM e
  UNION ALL SELECT DISTINCT user_id, 'ports', 'add', NULL::BIGINT, floor(value)::INTEGER::VARCHAR,
         floor(value)::INTEGER::VARCHAR FROM e
  UNION ALL SELECT user_id, 'envs', 'put', NULL, kind, arg_max(k, (ts, event_id)) FROM e WHERE kind <> 'signup'
            GROUP BY user_id, kind
  UNION ALL SELECT user_id, 'no_default_features', 'set', NULL, NULL, 'true' FROM e WHERE kind = 'error'
            GROUP BY user_id)"""

PAGE_RULES = PATHS + r""",
firsts AS (SELECT path, regexp_extract(path, '^(/[^/]+)/', 1) AS f FROM paths),
rules AS (
  SELECT DISTINCT kind || ' ' || value AS rule_id, * FROM (
    SELECT 1 AS position, 'path' AS kind, path AS value, 'GET' AS method, NULL AS rewrite FROM firsts WHERE f <> ''
    UNION ALL SELECT 2, 'path-regex', '^' || f || '/[0-9]*5', NULL, '/five' FROM firsts WHERE f <> ''
    UNION ALL SELECT 3, 'path-beg', f, NULL, '/all' FROM firsts WHERE f <> ''
    UNION ALL SELECT 3, 'path-beg', '/', 'POST', NULL FROM firsts WHERE f <> ''
    UNION ALL SELECT 4, 'path-regex', '/(xx|' || substr(f, 2) || ')/1', NULL, NULL FROM firsts WHERE f <> '')),
requests AS (
  SELECT page_id AS request_id, path, CASE WHEN scheme = 'https' THEN 'GET' ELSE 'POST' END AS method FROM paths),
hits AS (
  SELECT q.request_id, q.path, q.method, r.rule_id, r.position, r.kind, r.value, r.rewrite
  FROM requests q JOIN rules r
    ON (r.method IS NULL OR r.method = q.method)
   AND CASE r.kind WHEN 'path' THEN q.path = r.value WHEN 'path-beg' THEN starts_with(q.path, r.value)
            ELSE regexp_matches(q.path, '^(?:' || r.value || ')') END)"""

PLACED = r"""
demand AS (
  SELECT p_partkey, p_size::DOUBLE AS cpus, p_retailprice AS memory,
         CASE WHEN p_type <> 'SMALL' THEN [p_type, 'ANY'] ELSE [] END AS roles FROM part),
nodes AS (
  SELECT s_suppkey, s_nationkey * 2.5 AS cpus, s_acctbal / 8 AS memory,
         CASE WHEN s_nationkey < 8 THEN ['PROMO', 'ANY'] WHEN s_nationkey < 16 THEN ['LARGE', 'PROMO'] ELSE [] END AS roles
  FROM supplier),
placed AS (
  SELECT p_partkey, count(s_suppkey) AS candidates
  FROM demand d LEFT JOIN nodes n
    ON n.cpus >= d.cpus AND n.memory >= d.memory AND (len(d.roles) = 0 OR list_has_any(n.roles, d.roles))
  GROUP BY p_partkey)"""

MANIFESTS = r"""
WITH entries AS (
  SELECT 'order-' || l_orderkey AS bundle, l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || l_shipdate::DATE AS label,
    '{"bind-protocol":"http","bind-port":0'
    || CASE WHEN l_linestatus = 'O' THEN ',"service-name":"svc"' ELSE '' END
    || CASE WHEN l_returnflag <> 'R' THEN ',"services":["http://:' || l_suppkey || '"]'
       ELSE ',"acls":[{"http":{"requests":[{"path-beg":"/p/' || l_partkey || '","method":"GET"}]}},{"tcp":{"requests":['
            || l_linenumber || ']}}]' END || '}' AS document
  FROM lineitem),
headers AS (SELECT *, length(o_orderpriority) AS p FROM orders)
SELECT 'order-' || o_orderkey AS bundle, NULL AS label,
  '{"version":"1","name":"order-' || o_orderkey || '","compatibilityVersion":"' || p || '","tags":["' || p || '.' || o_custkey
  || '"],"system":"order-' || o_orderkey || '","systemVersion":"' || p || '","nrOfCpus":0.5,"memory":' || (p * 1048576)
  || ',"diskSpace":200000000,"roles":["' || o_orderstatus || '"],"components":{"order-' || o_orderkey
  || '":{"description":"' || o_orderpriority || '","file-system-type":"universal","start-command":["bin/run"]}'
  || CASE WHEN o_orderstatus = 'F' THEN
       ',"bundle-status":{"description":"Status check for the bundle component","file-system-type":"universal",'
       || '"start-command":["check","--initial-delay","' || greatest(1, o_custkey // 1000) || '","$HOST?' || o_custkey
       || '"]}' ELSE '' END || '}}' AS document
FROM headers
UNION ALL
SELECT bundle, label, document FROM entries WHERE bundle IN (SELECT 'order-' || o_orderkey FROM orders)"""


def _tree(manifests: str, deepest: int = 4) -> str:
    """Queries for the hash tree of the rows (bundle, label, document) of a named query: ``tree``."""
    depth = " + ".join(f"(n > {16 ** (k + 1)})::INTEGER" for k in range(deepest))
    levels = "".join(
        f"""
level{k} AS (
  SELECT bundle, node, sum(n)::BIGINT AS endpoints, sha256(string_agg(part, ',' ORDER BY part)) AS hash FROM (
    SELECT bundle, left(place, {k}) AS node, place || own AS part, 1 AS n FROM leaves WHERE level = {k}
    {f"UNION ALL SELECT bundle, left(node, {k}), node || ':' || hash, endpoints FROM level{k + 1}" if k < deepest else ""}) GROUP BY ALL),"""
        for k in range(deepest, -1, -1)
    )
    union = " UNION ALL ".join(f"SELECT bundle, {k} AS level, node, endpoints, hash FROM level{k}" for k in range(deepest + 1))
    return f"""
named AS (SELECT bundle, sha256(label) AS place, sha256(label || ':' || document) AS own, count(*) OVER (PARTITION BY bundle) AS n FROM {manifests} WHERE label IS NOT NULL),
leaves AS MATERIALIZED (SELECT *, {depth} AS level FROM named),{levels}
tree AS ({union})"""


def _digests(manifests: str) -> str:
    """Queries for the digests of the rows (bundle, label, document) of a named query: ``digests``."""
    return f"""{_tree(manifests)},
digests AS (
  SELECT m.bundle, coalesce(t.endpoints, 0) AS endpoints, sha256(document || ':' || coalesce(t.endpoints, 0) || ':' || coalesce(t.hash, '')) AS digest
  FROM {manifests} m LEFT JOIN tree t ON t.bundle = m.bundle AND t.level = 0 WHERE m.label IS NULL)"""


def _supplier_manifests(moved: bool) -> str:
    port = "l_linenumber + CASE WHEN l_partkey % 19 = 3 THEN 1000 ELSE 0 END" if moved else "l_linenumber"
    tail = "CASE WHEN l_orderkey % 101 = 5 THEN '-new' ELSE '' END" if moved else "''"
    return f"""
  SELECT l_suppkey::VARCHAR AS bundle, l_orderkey || '-' || l_linenumber || '-' || l_partkey || {tail} AS label,
         '{{"bind-protocol":"tcp","bind-port":' || max({port}) || ',"services":[]}}' AS document
  FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier){" AND l_quantity <> 7" if moved else ""} GROUP BY ALL"""


DETECTED = PATHS + r""",
hosts AS (
  SELECT scheme, host, length(host) % 5 = 0 AS bare,
         string_agg(DISTINCT '{"path-beg":"' || CASE WHEN p = '' THEN '/' ELSE p END || '"}', ',' ORDER BY '{"path-beg":"' || CASE WHEN p = '' THEN '/' ELSE p END || '"}') AS rules
  FROM (SELECT scheme, host, regexp_replace(path, '/$', '') AS p FROM paths) GROUP BY ALL),
manifests AS (
  SELECT scheme AS bundle, host AS label, '{"bind-protocol":"http","bind-port":0,"service-name":"' || host || '",'
    || CASE WHEN bare THEN '"services":[]' ELSE '"acls":[{"http":{"requests":[' || rules || ']}}]' END || '}' AS document FROM hosts
  UNION ALL SELECT DISTINCT scheme, 'akka-remote', '{"bind-protocol":"tcp","bind-port":0,"services":[]}' FROM paths
  UNION ALL SELECT scheme, NULL, '{"version":"1","name":"' || scheme || '","compatibilityVersion":"1","tags":["1.2"],"system":"' || scheme
    || '","systemVersion":"1","nrOfCpus":0.1,"memory":' || ((SELECT count(*) FROM pages) + 402653184)
    || ',"diskSpace":200000000,"roles":["pages","web"],"components":{"' || scheme || '":{"description":"' || scheme
    || '","file-system-type":"universal","start-command":["bin/run"]}}}' FROM (SELECT DISTINCT scheme FROM paths))"""

ORACLE: dict[str, str] = {
    "service_catalog": f"WITH {SERVICE_RULES} SELECT * FROM rules",
    "service_uris": f"WITH {SERVICE_URIS} SELECT * FROM uris",
    "service_endpoints": f"""
WITH {SERVICE_RULES}
SELECT scheme AS descriptor_set, host AS label, NULL AS rule, 'http' AS bind_protocol, 0 AS bind_port,
       CASE WHEN bool_or(NOT starts_with(path, '/') AND page_id % 2 <> 0) THEN '' END AS services, host AS service_name
FROM paths GROUP BY scheme, host
UNION ALL SELECT descriptor_set, service, rule, NULL, NULL, NULL, NULL FROM rules
UNION ALL SELECT DISTINCT scheme, 'akka-remote', NULL, 'tcp', 0, '', NULL FROM paths""",
    "service_uri_endpoints": f"""
WITH {SERVICE_URIS}
SELECT DISTINCT descriptor_set, service AS label, NULL AS uri, 'http' AS bind_protocol, NULL AS services FROM uris
UNION ALL SELECT descriptor_set, service, uri, NULL, NULL FROM uris
UNION ALL SELECT DISTINCT scheme, 'akka-remote', NULL, 'tcp', '' FROM paths""",
    "descriptor_errors": """
SELECT 'documents' AS origin, doc_id AS seq FROM documents
UNION ALL SELECT 'pages', page_id FROM pages WHERE page_id % 10 IN (1, 2, 3)""",
    "descriptor_types": r"""
WITH v AS (SELECT ['"a"', '7', '1.5', 'true', 'null', '["a"]', '{"a":"b"}', '"7"', '""', '"a\"b"'] AS values),
p AS (SELECT page_id, values[page_id % 10 + 1]::JSON AS name, values[page_id // 10 % 10 + 1]::JSON AS deep FROM pages, v)
SELECT page_id FROM p WHERE json_type(name) <> 'VARCHAR' OR json_type(deep) <> 'VARCHAR' OR page_id % 3 = 0""",
    "content_catalog": """
SELECT sha256(text) AS digest, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY sha256(text)""",
    "content_names": """
SELECT doc_id AS id, sha256(text) AS digest, source || '-' || sha256(text) || '.txt' AS artifact FROM documents""",
    "incremental_load": """
SELECT sha256(text) AS digest, min(doc_id) AS first_id FROM documents
WHERE sha256(text) NOT IN (SELECT sha256(d.text) FROM documents d WHERE d.doc_id IN (SELECT doc_id FROM labels))
GROUP BY sha256(text)""",
    "catalog_load": """
WITH d AS (SELECT doc_id, sha256(text) AS digest, doc_id IN (SELECT doc_id FROM labels) AS labelled FROM documents)
SELECT digest, min(doc_id) AS first_id, 'labelled' AS load FROM d WHERE labelled GROUP BY digest
UNION ALL SELECT digest, min(doc_id), 'all' FROM d WHERE NOT EXISTS (SELECT 1 FROM d x WHERE x.labelled AND x.digest = d.digest) GROUP BY digest""",
    "path_rules": f"""
WITH {PATHS},
raw AS (
  SELECT page_id, 'plain' AS form, path, false AS is_regex FROM paths
  UNION ALL SELECT page_id, 'prefix', '^' || path, true FROM paths
  UNION ALL SELECT page_id, 'whole', '^' || path || '$', true FROM paths
  UNION ALL SELECT page_id, 'double', '^/' || path, true FROM paths),
flagged AS (
  SELECT *, is_regex AND starts_with(path, '^/') AND NOT ends_with(path, '$') AS begins,
         NOT contains(path, '//')
         AND regexp_full_match(substr(path, 2), '[/a-zA-Z0-9._-]*') AS plain
  FROM raw)
SELECT page_id, form,
       CASE WHEN NOT is_regex THEN 'path' WHEN NOT begins THEN 'path-regex' WHEN plain THEN 'path-beg' END AS kind,
       CASE WHEN NOT begins THEN path WHEN plain THEN substr(path, 2) END AS value,
       CASE WHEN begins AND NOT plain THEN path || ' is not a plain path prefix' END AS error
FROM flagged""",
    "pair_requests": f"""
WITH {PATHS}
SELECT page_id, CASE WHEN scheme = 'https' THEN 'GET' END AS method, path,
       CASE WHEN scheme <> 'https' THEN host END AS rewrite FROM paths""",
    "tuple_requests": f"""
WITH {PATHS},
p AS (SELECT *, '^' || path AS regex, CASE WHEN scheme = 'https' THEN 'GET' ELSE 'PUT' END AS m FROM paths)
SELECT page_id, 'path' AS form, NULL AS method, path, false AS is_regex, NULL AS rewrite FROM p
UNION ALL SELECT page_id, 'regex', NULL, regex, true, NULL FROM p
UNION ALL SELECT page_id, 'method path', m, path, false, NULL FROM p
UNION ALL SELECT page_id, 'path rewrite', NULL, path, false, host FROM p
UNION ALL SELECT page_id, 'method regex', m, regex, true, NULL FROM p
UNION ALL SELECT page_id, 'regex rewrite', NULL, regex, true, host FROM p
UNION ALL SELECT page_id, 'three', m, path, false, host FROM p
UNION ALL SELECT page_id, 'three regex', m, regex, true, host FROM p""",
    "route_rules": f"""
WITH {CUSTOMER_RULES}
SELECT bundle, label, acl_pos, request_pos, family, method,
       CASE WHEN port IS NOT NULL THEN 'port' WHEN NOT is_regex THEN 'path'
            WHEN starts_with(path, '^/') THEN 'path-beg' ELSE 'path-regex' END AS kind,
       CASE WHEN starts_with(path, '^/') THEN substr(path, 2) ELSE path END AS value, rewrite, port,
       CASE WHEN method = 'PATCH' THEN 'PATCH is not a known method' END AS error
FROM raw""",
    "acl_listing": f"WITH {CUSTOMER_RULES} SELECT bundle, label, family, port FROM raw WHERE family = 'tcp'",
    "acl_listing_udp": f"WITH {CUSTOMER_RULES} SELECT bundle, label, family, port FROM raw WHERE family = 'udp'",
    "acl_listing_http": f"""
WITH {CUSTOMER_RULES}
SELECT bundle, label, method, CASE WHEN NOT is_regex THEN 'path' WHEN starts_with(path, '^/') THEN 'path-beg' ELSE 'path-regex' END AS kind,
       CASE WHEN starts_with(path, '^/') THEN substr(path, 2) ELSE path END AS value, rewrite,
       CASE WHEN method = 'PATCH' THEN 'PATCH is not a known method' END AS error
FROM raw WHERE family = 'http'""",
    "validation_report": f"WITH {REPORT} SELECT * FROM report",
    "valid_bundles": f"""
WITH {REPORT} SELECT p_partkey::VARCHAR AS name FROM part
WHERE p_partkey::VARCHAR NOT IN (SELECT bundle FROM report)""",
    "overlay_resolve": f"WITH {RESOLVED} SELECT * FROM resolved",
    "overlay_delta": f"""
WITH {RESOLVED} SELECT * FROM resolved r WHERE scope IS NOT NULL
AND EXISTS (SELECT 1 FROM resolved o WHERE o.target = r.target AND o.scope IS NOT NULL AND o.key <> 'checks')""",
    "overlay_chain": """
WITH e AS (
  SELECT *, event_id::VARCHAR AS scope, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) > 1 AS is_config FROM events),
defined AS (
  SELECT *, unnest(['status', 'level', 'place']) AS key,
         unnest([CASE WHEN event_type = 'error' THEN value::VARCHAR END, CASE WHEN value > 20 THEN value::VARCHAR END, CASE WHEN value < 1 THEN event_type END]) AS own
  FROM e),
nearest AS (
  SELECT scope AS target, key, last_value(CASE WHEN own IS NOT NULL THEN {'value': own, 'scope': CASE WHEN is_config THEN scope END} END IGNORE NULLS)
         OVER (PARTITION BY user_id, key ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM defined)
SELECT target, key, s.value AS value, s.scope AS scope FROM nearest WHERE s IS NOT NULL""",
    "settings_manifest": f"""
WITH {RESOLVED},
modes AS (
  SELECT *, 'full' AS mode, true AS whole FROM places
  UNION ALL SELECT *, 'delta', false FROM places
  WHERE coalesce(cpus_scope, memory_scope, role_scope) IS NOT NULL)
SELECT target, mode, '{{"version":"1"' || CASE WHEN whole THEN ',"name":"' || lower(r_name) || '"' ELSE '' END
  || CASE WHEN whole OR cpus_scope IS NOT NULL THEN ',"nrOfCpus":' || cpus || '.0' ELSE '' END
  || CASE WHEN whole OR memory_scope IS NOT NULL THEN ',"memory":' || memory ELSE '' END
  || CASE WHEN whole OR role_scope IS NOT NULL THEN ',"roles":["' || role || '"]' ELSE '' END
  || ',"components":{{"' || lower(r_name) || '":{{}}'
  || CASE WHEN checks IS NOT NULL THEN ',"bundle-status":{{"description":"Status check for the bundle component",'
          || '"file-system-type":"universal","start-command":["check","--initial-delay","3","' || checks
          || '"],"endpoints":{{}}}}' ELSE '' END || '}}}}' AS manifest
FROM modes""",
    "default_endpoints": """
WITH b AS (
  SELECT p_partkey::VARCHAR AS bundle, p_type <> 'STANDARD' AND p_size >= 5 AS acls FROM part)
SELECT bundle, 'web' AS label, 'plain' AS kind,
       '{"bind-protocol":"http","bind-port":0' || CASE WHEN acls THEN ',"service-name":"web"' ELSE '' END
       || ',"services":[]}' AS endpoint FROM b
UNION ALL
SELECT bundle, 'web', 'web', '{"bind-protocol":"http","bind-port":0'
       || CASE WHEN acls THEN ',"service-name":"web","acls":[{"http":{"requests":[{"path-beg":"/"}]}}]}'
               ELSE ',"services":["http://:9000"]}' END FROM b""",
    "override_per_entity": f"""
WITH {OVERRIDES} SELECT * FROM base WHERE entity NOT IN (SELECT entity FROM defined)
UNION ALL SELECT * FROM over""",
    "override_global": f"""
WITH {OVERRIDES}
SELECT *, 'some' AS "case" FROM over
UNION ALL SELECT *, 'some' FROM base WHERE NOT EXISTS (SELECT 1 FROM over)
UNION ALL SELECT *, 'none' FROM base""",
    "manual_or_derived": """
WITH changed AS (
  SELECT c_custkey, c_name || ',' || CASE WHEN c_nationkey = 0 THEN 'b' ELSE 'a' END || ',' || c_name AS services,
         CASE WHEN c_acctbal < 0 THEN c_custkey ELSE 0 END AS port
  FROM customer WHERE c_nationkey = 0 OR (c_acctbal < 0 AND c_custkey <> 0))
SELECT c_custkey AS entity, 'web' AS label, port, services FROM changed
UNION ALL
SELECT o_custkey, o_orderkey::VARCHAR, o_orderkey, o_orderstatus FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM changed)""",
    "uri_ports": f"""
WITH {URIS} SELECT uri, port, CASE WHEN port IS NULL THEN 'no port in ' || uri END AS error FROM uris""",
    "exposed_ports": f"WITH {URIS} SELECT port FROM uris WHERE port >= 0 UNION SELECT p_size FROM part",
    "settings_fold": f"WITH {EVENT_FOLD} SELECT * FROM folded",
    "settings_record": f"""
WITH {EVENT_FOLD},
placed AS (
  SELECT user_id, field, key, value,
         CASE WHEN field IN ('ports', 'envs') THEN row_number() OVER (PARTITION BY user_id, field ORDER BY key)
              ELSE pos END AS pos FROM folded)
SELECT user_id, field, pos, key, value, NULL AS log_level, NULL::BOOLEAN AS no_default_features
FROM placed WHERE field IN ('args', 'ports', 'envs')
UNION ALL
SELECT user_id, NULL, NULL, NULL, NULL, max(value) FILTER (field = 'log_level'), bool_or(field = 'no_default_features')
FROM folded GROUP BY user_id""",
    "install_plan": """
SELECT 0 AS phase, r_regionkey::BIGINT AS ord, r_name AS name, lower(r_name) AS source, NULL AS config_file,
       regexp_replace(upper(r_name), '[^A-Z0-9_]', '_', 'g') || '_BUNDLE_ID' AS id_env FROM region
UNION ALL
SELECT 1, c_custkey, c_name, 'bundles/' || c_name || '.zip',
       CASE WHEN c_mktsegment = 'BUILDING' OR c_nationkey < 5 THEN 'configs/' || c_name || '.zip' END,
       upper(replace(c_name, '#', '_')) || '_BUNDLE_ID'
FROM customer WHERE c_acctbal >= 0 AND c_mktsegment <> 'MACHINERY'""",
    "report_names": r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split_regex(text, '\r\n|\r|\n')[2:11]) AS line FROM documents),
words AS (SELECT doc_id, string_split_regex(line, '[ \t\n\x0B\f\r]+')[2] AS name FROM lines)
SELECT DISTINCT doc_id, name FROM words WHERE name <> ''""",
    "report_counts": """
SELECT c_custkey // 50 AS report, c_custkey::VARCHAR AS id, c_name AS name, c_nationkey AS replicated,
       length(c_mktsegment)::INTEGER AS starting, NULL::INTEGER AS running FROM customer""",
    "manifest_emit": MANIFESTS,
    "manifest_artifacts": f"WITH m AS ({MANIFESTS}), {_digests('m')} SELECT * FROM digests",
    "manifest_files": """
SELECT l_suppkey::VARCHAR AS bundle, l_orderkey || '-' || l_linenumber || '-' || l_partkey AS label, max(l_linenumber)::INTEGER AS port
FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier) GROUP BY ALL""",
    "manifest_tree": f"WITH m AS ({_supplier_manifests(False)}), {_tree('m')} SELECT * FROM tree",
    "manifest_changes": f"""
WITH o AS ({_supplier_manifests(False)}), n AS ({_supplier_manifests(True)})
SELECT bundle, label, CASE WHEN o.document IS NULL THEN 'added' WHEN n.document IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM o FULL JOIN n USING (bundle, label) WHERE o.document IS DISTINCT FROM n.document""",
    "detected_manifests": f"""
WITH {DETECTED}, {_digests("manifests")}
SELECT bundle, label, document, bundle || '-1.2-' || digest || '.json' AS artifact FROM manifests JOIN digests USING (bundle)""",
    "run_settings": """
WITH views AS (
  SELECT user_id, (floor(value) + 1000)::INTEGER AS port FROM events e
  WHERE event_type = 'view' AND EXISTS (SELECT 1 FROM events x WHERE x.user_id = e.user_id AND x.event_type = 'error')),
others AS (
  SELECT user_id, (floor(value) + 1000)::INTEGER AS port FROM events WHERE user_id NOT IN (SELECT user_id FROM views)),
given AS (SELECT user_id, floor(value)::INTEGER AS port FROM events)
SELECT user_id::VARCHAR AS entity, 'ports' AS field, port::VARCHAR AS key
FROM (SELECT * FROM views UNION SELECT * FROM others UNION SELECT * FROM given)""",
    "resource_units": """
WITH p AS (SELECT *, round(p_retailprice * 100)::BIGINT AS cents, p_size::BIGINT AS size FROM part)
SELECT p_partkey, size * 1000 AS kb, size * 1000000 AS mb, size * 1000000000 AS gb, size * 1000000000000 AS tb,
       size * 1024 AS kib, size * 1048576 AS mib, size * 1073741824 AS gib, size * 1099511627776 AS tib,
       (greatest(cents - 1, 0) // 1024 + 1) * 1024 AS rounded,
       greatest(1, trunc((cents * size - 90000) / 1000.0)::BIGINT) AS seconds
FROM p""",
    "resource_normalize": """
SELECT p_partkey::VARCHAR AS name, CASE WHEN p_size < 10 THEN p_size / 4 ELSE 0.1 END AS nr_of_cpus,
       CASE WHEN p_size >= 10 THEN p_size::BIGINT * 1048576 ELSE 402653184 END AS memory, 402653184::BIGINT AS min_memory,
       CASE WHEN p_type = 'PROMO' THEN p_size::BIGINT * 1000000 ELSE 200000000 END AS disk_space,
       CASE WHEN p_type = 'LARGE' THEN p_brand ELSE 'web' END AS roles,
       CASE WHEN p_size < 10 THEN p_partkey ELSE 3000 END AS check_delay_ms,
       CASE WHEN p_size < 10 THEN (greatest(p_partkey - 1, 0) // 1024 + 1) * 1024 ELSE 134217728 END AS heap,
       CASE WHEN p_size < 10 THEN greatest(1, p_partkey // 1000) ELSE 3 END AS check_delay_s
FROM part""",
    "route_match": f"""
WITH {PAGE_RULES},
best AS (
  SELECT *, count(*) OVER (PARTITION BY request_id) AS matches FROM hits
  QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY position, length(value) DESC, rule_id) = 1)
SELECT q.request_id, q.path, q.method, b.rule_id, coalesce(b.matches, 0) AS matches,
       CASE WHEN b.rule_id IS NULL THEN NULL WHEN b.rewrite IS NULL THEN q.path
            WHEN b.kind = 'path-regex' THEN b.rewrite || substr(q.path, length(regexp_extract(q.path, '^(?:' || b.value || ')')) + 1)
            ELSE b.rewrite || substr(q.path, length(b.value) + 1) END AS target
FROM requests q LEFT JOIN best b USING (request_id)""",
    "route_matches": f"WITH {PAGE_RULES} SELECT DISTINCT path, method, rule_id FROM hits",
    "regex_matches": r"""
WITH rules AS (
  SELECT DISTINCT unnest([
    '(/[a-z]+)+/[A-Z]+/.*[#-]0*' || p_partkey || '/[0-9]+$', '.*0/' || p_size || '/?$',
    '.*/[A-Z]*' || left(p_type, 3) || '|.*' || left(p_type, 3) || '[A-Z]+/|/(st|b)ore/' || lower(p_brand),
    '/\w+/[A-Z]*[A-M]{2}/.*' || p_size || '$']) AS rule_id FROM part),
requests AS (SELECT DISTINCT concat_ws('/', '', 'store', c_mktsegment, c_name, c_nationkey) AS path, 'GET' AS method FROM customer)
SELECT path, method, rule_id FROM requests JOIN rules ON regexp_matches(path, '^(?:' || rule_id || ')')""",
    "port_match": f"""
WITH {CUSTOMER_RULES},
requests AS (
  SELECT event_id AS request_id, CASE WHEN event_type = 'click' THEN 'tcp' ELSE 'udp' END AS family,
         floor(value)::INTEGER + 9000 AS port FROM events)
SELECT q.request_id, q.family, q.port, min(r.bundle || '/' || r.family || '/' || r.port) AS rule_id,
       count(r.bundle) AS matches
FROM requests q LEFT JOIN raw r ON r.family = q.family AND r.port = q.port GROUP BY ALL""",
    "name_resolve": """
WITH asked AS (
  SELECT DISTINCT unnest([short, short || ':' || c_mktsegment, 'No ' || c_name]) AS query
  FROM (SELECT *, left(c_name, length(c_mktsegment) + 8) AS short FROM customer)),
parts AS (
  SELECT query, split_part(query, ':', 1) AS prefix,
         CASE WHEN contains(query, ':') THEN split_part(query, ':', 2) END AS tag FROM asked),
counted AS (
  SELECT query, any_value(prefix) AS prefix, count(DISTINCT c_name) AS n, min(c_name) AS one,
         coalesce(bool_or(c_name = prefix), false) AS exact
  FROM parts LEFT JOIN customer ON starts_with(c_name, prefix) AND (tag IS NULL OR tag = c_mktsegment) GROUP BY query)
SELECT query, CASE WHEN n = 0 THEN 'missing' WHEN exact OR n = 1 THEN 'resolved' ELSE 'ambiguous' END AS status,
       CASE WHEN exact THEN prefix WHEN n = 1 THEN one END AS name, n AS candidates FROM counted""",
    "placement_candidates": f"WITH {PLACED} SELECT * FROM placed",
    "placement_by_disk": """
WITH demand AS (
  SELECT p_partkey, p_size AS cpus, round(p_retailprice * 100)::BIGINT AS memory, p_partkey % 997 * 50 AS disk,
         CASE p_type WHEN 'PROMO' THEN ['R', 'A'] WHEN 'LARGE' THEN ['N'] ELSE [] END AS roles FROM part),
nodes AS (
  SELECT l_returnflag AS role, max(l_quantity) AS cpus, round(max(l_extendedprice) * 2)::BIGINT AS memory, max(l_orderkey) AS disk
  FROM lineitem GROUP BY l_suppkey, l_returnflag),
fitting AS (
  SELECT p_partkey, count(*) AS n FROM demand d JOIN nodes n
  ON n.cpus >= d.cpus AND n.memory >= d.memory AND n.disk >= d.disk AND (len(roles) = 0 OR list_contains(roles, role)) GROUP BY p_partkey)
SELECT p_partkey, coalesce(n, 0) AS candidates FROM part LEFT JOIN fitting USING (p_partkey)""",
    "unplaceable": f"WITH {PLACED} SELECT p_partkey FROM placed WHERE candidates = 0",
    "compat_history": """
WITH h AS (
  SELECT o_custkey, o_orderdate, o_orderkey, left(o_orderpriority, 1) AS compat,
         lag(left(o_orderpriority, 1)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS previous FROM orders)
SELECT *, coalesce(previous <> compat, false) AS changed FROM h""",
    "event_tail": """
WITH r AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC)::INTEGER AS rank FROM events)
SELECT user_id, event_id, event_type, rank, strftime(ts, '%H:%M:%S') AS time,
       strftime(ts, '%Y-%m-%d %H:%M:%S') AS date_time, strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%d %H:%M:%S') AS zoned
FROM r WHERE rank <= 3""",
    "status_rollup": """
SELECT user_id, count(*) FILTER (event_type = 'view') AS "view", count(*) FILTER (event_type = 'click') AS click,
       count(*) FILTER (event_type = 'purchase') AS purchase, count(*) FILTER (event_type = 'error') AS error,
       count(*) FILTER (event_type = 'signup') AS signup, count(*) FILTER (event_type = 'replicated') AS replicated
FROM events GROUP BY user_id""",
    "text_scalars": """
WITH c AS (
  SELECT *, length(c_mktsegment) || '.' || c_nationkey || '.' || c_custkey AS version FROM customer)
SELECT c_custkey, lower(hex(c_name || 'é')) AS hex, upper(replace(c_name, '#', '_')) || '___X' AS env,
       split_part(version, '.', 1) AS compat, left(replace(version, '.', ''), 2) AS minor,
       c_name || '-' || CASE WHEN c_acctbal >= 0 THEN version ELSE 'v' || split_part(version, '.', 1) END AS package,
       CASE WHEN c_acctbal >= 0 THEN '["' || version || '", "' || c_mktsegment || '"]' ELSE '[]' END AS listed,
       CASE WHEN c_acctbal > 5000 THEN c_mktsegment ELSE '/p/' || c_name END AS source,
       c_acctbal > 5000 OR c_nationkey < 3 AS configured,
       c_name || '.tar-' || lower(hex(c_mktsegment)) || '.gz' AS artifact
FROM c""",
    "pair_arguments": """
SELECT event_id, event_type NOT IN ('view', 'purchase') AS valid,
       CASE WHEN event_type IN ('click', 'signup') THEN event_type WHEN event_type = 'error' THEN '' END AS key,
       CASE WHEN event_type IN ('click', 'signup', 'error') THEN json_extract_string(props, '$.k') END AS value,
       '--arg ' || event_type || ' --arg=-D' || event_type || '=' || json_extract_string(props, '$.k') AS flags
FROM events""",
}
