"""DuckDB SQL for the registered queries of the log pipeline, put together from common table expressions."""

from __future__ import annotations

from .functions.fixed import APACHE, CLOUD, CONTAINER, DATABASE, JSON_SHAPE, LEVELS, MASKS, NGINX, RULES
from .sources.synth import AGENTS, PAYLOADS, TENANTS
from .sources.synth import LEVELS as LOG_LEVELS

DAY = 86_400_000_000


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def pick(values: tuple[str, ...], n: str) -> str:
    return f"list_extract([{', '.join(map(q, values))}], (({n}) % {len(values)})::INT + 1)"


LINES = f"""
seeds AS (SELECT event_id AS i, ts, user_id AS u, event_type AS kind,
  CASE WHEN event_id % 10 = 0 THEN {pick(PAYLOADS, 'event_id // 10')} ELSE 'item-' || (event_id % 50) END AS payload,
  '203.0.' || (user_id % 256) || '.' || (event_id % 7 + 1) AS ip,
  strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso, strftime(ts, '%d/%b/%Y:%H:%M:%S') AS web,
  {pick(LOG_LEVELS, 'event_id')} AS level, {pick(AGENTS, 'user_id')} AS agent, {pick(TENANTS, 'user_id')} AS tenant FROM events),
lines AS (SELECT i AS event_id, ts AS event_ts,
  CASE i % 6
    WHEN 0 THEN ip || ' - u' || u || ' [' || web || ' +0000] "GET /app//' || kind || '/?q=' || payload || '&p=2 HTTP/1.1" ' || (200 + i % 4 * 100) || ' ' || (i % 5000) || ' "-" "' || agent || '"'
    WHEN 1 THEN ip || ' - u' || u || ' [' || web || ' +0000] "GET /app//' || kind || '/?q=' || payload || '&p=2 HTTP/1.1" ' || (200 + i % 4 * 100) || ' ' || (i % 5000)
    WHEN 2 THEN '{{"@timestamp": "' || iso || '", "severity": "' || level || '", "msg": "' || payload || '", "client_ip": "' || ip || '", "user_agent": "' || agent || '", "method": "post", "url": "/api/' || kind || '", "status": ' || (200 + i % 5 * 100) || ', "tenant": "' || tenant || '"}}'
    WHEN 3 THEN iso || ' u' || u || ' admin bucket/' || payload || ' ' || kind || ' success'
    WHEN 4 THEN iso || ' ' || level || ' pod-1 ' || kind || ' ' || payload || '@' || ip
    ELSE iso || ' svc-1 production SELECT ' || payload END AS value FROM seeds)"""

RAW = f"""{LINES},
formats AS (SELECT *, CASE WHEN trim(value) = '' THEN 'empty'
  WHEN regexp_matches(value, {q(JSON_SHAPE)}) AND json_valid(value) THEN 'json'
  WHEN regexp_matches(value, {q(NGINX)}) THEN 'nginx_combined' WHEN regexp_matches(value, {q(APACHE)}) THEN 'apache_common'
  WHEN regexp_matches(value, {q(CLOUD)}) THEN 'cloud_audit' WHEN regexp_matches(value, {q(CONTAINER)}) THEN 'container'
  WHEN regexp_matches(value, {q(DATABASE)}) THEN 'database_audit' ELSE 'raw' END AS format FROM lines),
web_rows AS (SELECT event_id, format, epoch_us(strptime(substr(regexp_extract(value, {q(APACHE)}, 3), 1, 20), '%d/%b/%Y:%H:%M:%S')) AS ts_us,
  regexp_extract(value, {q(APACHE)}, 1) AS source_ip, regexp_extract(value, {q(APACHE)}, 2) AS "user", split_part(regexp_extract(value, {q(APACHE)}, 4), ' ', 1) AS method,
  split_part(regexp_extract(value, {q(APACHE)}, 4), ' ', 2) AS target, regexp_extract(value, {q(APACHE)}, 5)::INT AS status_code, regexp_extract(value, {q(APACHE)}, 6)::BIGINT AS bytes_sent,
  CASE WHEN format = 'nginx_combined' THEN regexp_extract(value, {q(NGINX)}, 8) END AS user_agent FROM formats WHERE format IN ('nginx_combined', 'apache_common')),
json_rows AS (SELECT event_id, format, epoch_us(strptime(value->>'$."@timestamp"', '%Y-%m-%dT%H:%M:%SZ')) AS ts_us, value->>'$.severity' AS level, value->>'$.msg' AS message, value->>'$.client_ip' AS source_ip,
  value->>'$.user_agent' AS user_agent, upper(value->>'$.method') AS method, value->>'$.url' AS path, (value->>'$.status')::INT AS status_code, value->>'$.tenant' AS tenant FROM formats WHERE format = 'json'),
token_rows AS (SELECT event_id, format, value, string_split(value, ' ') AS w, epoch_us(strptime(split_part(value, ' ', 1), '%Y-%m-%dT%H:%M:%SZ')) AS ts_us FROM formats WHERE format IN ('cloud_audit', 'container', 'database_audit')),
tokens AS (SELECT event_id, format, ts_us, value,
  CASE WHEN format IN ('cloud_audit', 'database_audit') THEN w[2] END AS "user", CASE WHEN format = 'cloud_audit' THEN w[3] END AS role, CASE WHEN format = 'cloud_audit' THEN w[4] END AS resource,
  CASE WHEN format = 'cloud_audit' THEN w[5] END AS action, CASE WHEN format = 'cloud_audit' THEN w[6] END AS result, CASE WHEN format = 'container' THEN w[2] END AS level, CASE WHEN format = 'container' THEN w[3] END AS pod,
  CASE WHEN format = 'container' THEN w[4] END AS container, CASE WHEN format = 'container' THEN nullif(regexp_extract(w[5], '\\b(?:\\d{{1,3}}\\.){{3}}\\d{{1,3}}\\b', 0), '') END AS source_ip,
  CASE WHEN format = 'container' THEN w[5] END AS message, CASE WHEN format = 'database_audit' THEN w[3] END AS "database", CASE WHEN format = 'database_audit' THEN w[4] END AS operation,
  CASE WHEN format = 'database_audit' THEN w[5] END AS query FROM token_rows)"""


def level_case(x: str) -> str:
    return f"""CASE WHEN coalesce({x}, '') = '' THEN 'medium' WHEN lower({x}) IN ('critical', 'crit', 'fatal', 'emerg') THEN 'critical' WHEN lower({x}) IN ('high', 'error', 'err', 'alert') THEN 'high'
  WHEN lower({x}) IN ('medium', 'warning', 'warn') THEN 'medium' ELSE 'low' END"""


NORMAL = f"""{RAW},
normal AS (
  SELECT event_id, format, ts_us, 'default' AS tenant, source_ip, 'medium' AS severity, coalesce(string_split(target, '?')[2], '') AS message, method AS http_method,
    regexp_replace(regexp_replace(split_part(target, '?', 1), '/+', '/', 'g'), '/$', '') AS http_path, user_agent, "user" AS remote_user,
    array_to_string(list_transform(string_split(coalesce(substr(target, instr(target, '?') + 1), ''), '&'), lambda p: url_decode(replace(p, '+', ' '))), ' ') AS pairs, NULL AS cloud_action, NULL AS level FROM web_rows
  UNION ALL BY NAME
  SELECT event_id, format, ts_us, tenant, source_ip, {level_case('level')} AS severity, message, method AS http_method, path AS http_path, user_agent, NULL AS remote_user, '' AS pairs, NULL AS cloud_action, level FROM json_rows
  UNION ALL BY NAME
  SELECT event_id, format, ts_us, 'default' AS tenant, source_ip, {level_case('level')} AS severity,
    CASE format WHEN 'container' THEN message WHEN 'cloud_audit' THEN value ELSE url_decode(CASE WHEN contains(query, '%') THEN replace(query, '+', ' ') ELSE query END) END AS message,
    NULL AS http_method, NULL AS http_path, NULL AS user_agent, "user" AS remote_user, '' AS pairs, action AS cloud_action, level FROM tokens),
texts AS (SELECT *, concat_ws(' ', nullif(message, ''), nullif(http_path, ''), nullif(pairs, ''), nullif(cloud_action, '')) AS t FROM normal)"""


def hits_of(text: str) -> str:
    each = ", ".join(f"CASE WHEN regexp_matches({text}, {q(p)}) THEN {i + 1} END" for i, (_, _, p) in enumerate(RULES))
    return f"list_filter([{each}], lambda x: x IS NOT NULL)"


CATEGORIES = f"[{', '.join(q(c) for c, _, _ in RULES)}]"
RULE_LEVELS = f"[{', '.join(str(LEVELS[s]) for _, s, _ in RULES)}]"
ORDER = list(dict.fromkeys(c for c, _, _ in RULES))
NAMES = "CASE WHEN {x} >= 4 THEN 'critical' WHEN {x} >= 3 THEN 'high' WHEN {x} >= 2 THEN 'medium' ELSE 'low' END"


def types_of(categories: str) -> str:
    each = ", ".join(f"CASE WHEN list_contains({categories}, {q(c)}) THEN {q(c)} END" for c in ORDER)
    return f"list_filter([{each}], lambda x: x IS NOT NULL)"


DETECTED = f"""{NORMAL},
hit AS (SELECT *, {hits_of('t')} AS hits FROM texts),
named AS (SELECT *, list_transform(hits, lambda i: ({CATEGORIES})[i]) AS cats, coalesce(list_max(list_transform(hits, lambda i: ({RULE_LEVELS})[i])), 0) AS lvl FROM hit),
detected AS (SELECT *, {types_of('cats')} AS types, {NAMES.format(x='lvl')} AS detected_severity FROM named)"""

CORRELATED = f"""{DETECTED},
threat AS (SELECT *, CASE detected_severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END AS level_no,
  list_filter([CASE WHEN source_ip IS NOT NULL THEN 'ip:' || source_ip END, 'tenant:' || tenant, CASE WHEN nullif(remote_user, '-') IS NOT NULL THEN 'user:' || remote_user END,
    CASE WHEN coalesce(user_agent, '') <> '' THEN 'ua:' || substr(md5(user_agent), 1, 8) END], lambda x: x IS NOT NULL) AS keys FROM detected WHERE len(types) > 0),
keyed AS (SELECT event_id, ts_us, level_no, types, unnest(keys) AS key, generate_subscripts(keys, 1) - 1 AS k FROM threat),
newest AS (SELECT event_id, key, k, level_no, types, ts_us, coalesce(list({{'t': ts_us, 'l': level_no, 'c': types}}) OVER (PARTITION BY key ORDER BY ts_us, event_id ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING), []) AS h FROM keyed),
held AS (SELECT *, list_filter(h, lambda x: x.t >= ts_us - {DAY}) AS p FROM newest),
windowed AS (SELECT event_id, key, k, level_no, len(p) AS prior, greatest(level_no, coalesce(list_max(list_transform(p, lambda x: x.l)), 0)) AS top, list_distinct(list_concat(types, flatten(list_transform(p, lambda x: x.c)))) AS u,
  len(list_filter(p, lambda x: x.l = 1)) AS p1, len(list_filter(p, lambda x: x.l = 3)) AS p3, len(list_filter(p, lambda x: x.l = 4)) AS p4,
  len(list_filter(p, lambda x: x.l >= 3)) + (level_no >= 3)::INT AS n34 FROM held),
judged AS (SELECT *, (len(u) >= 2 OR prior >= 5 OR n34 >= 2 OR (prior >= 3 AND ((p1 > 0 AND p3 > 0) OR p4 > 0))) AS go FROM windowed),
best AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY prior DESC, go DESC, CASE WHEN go THEN k ELSE -k END DESC) AS r FROM judged),
correlated AS (SELECT t.*, prior + 1 AS window_hits, {types_of('u')} AS wtypes, go, least(top + go::INT, 4) AS final_no, {NAMES.format(x='least(top + go::INT, 4)')} AS final_severity, key AS best_key,
  CASE WHEN go THEN 'corr_' || substr(md5(key), 1, 12) ELSE 'single_' || substr(t.event_id::VARCHAR, 1, 8) END AS correlation_id FROM threat t JOIN best b ON t.event_id = b.event_id AND r = 1)"""

ACTIONS = f"""{CORRELATED},
users AS (SELECT *, nullif(nullif(remote_user, '-'), '') AS usr, 'ip:' || source_ip AS ip_part, 'tenant:' || tenant AS tenant_part FROM correlated),
listed AS (SELECT *, list_filter([
  CASE WHEN final_severity = 'critical' AND source_ip IS NOT NULL THEN {{'kind': 'block_ip', 'ttl': 3600, 'key': 'block_ip|' || ip_part}} END,
  CASE WHEN final_severity = 'critical' THEN {{'kind': 'redact_log', 'ttl': NULL, 'key': 'redact_log|' || tenant_part}} END,
  CASE WHEN final_severity = 'high' AND source_ip IS NOT NULL THEN {{'kind': 'throttle_ip', 'ttl': 1800, 'key': 'throttle_ip|' || ip_part}} END,
  CASE WHEN list_contains(wtypes, 'sqli') AND usr IS NOT NULL THEN {{'kind': 'revoke_token', 'ttl': NULL, 'key': 'revoke_token|user:' || usr || '|' || tenant_part}} END,
  CASE WHEN list_contains(wtypes, 'xss') THEN {{'kind': 'notify', 'ttl': NULL, 'key': concat_ws('|', 'notify', 'user:' || usr, tenant_part)}} END,
  CASE WHEN window_hits > 3 AND len(wtypes) > 1 AND source_ip IS NOT NULL THEN {{'kind': 'block_ip', 'ttl': 7200, 'key': 'block_ip|' || ip_part}} END], lambda x: x IS NOT NULL) AS acts FROM users),
acted AS (SELECT event_id, ts_us, correlation_id, unnest(acts) AS a, (generate_subscripts(acts, 1) - 1)::INT AS position FROM listed),
planned AS (SELECT event_id, ts_us, correlation_id, position, a.kind AS kind, a.ttl::INT AS ttl_sec, a.key AS idempotent_key FROM acted)"""

KEYED = "keyed_events AS (SELECT event_id, md5(user_id || '|' || event_type) AS fingerprint, epoch_us(ts) AS ts_us FROM events)"


def mask_sql() -> str:
    email, rest = MASKS["email"], {"phone": (r"\b(1[3-9]\d)\d{4}(\d{4})\b", r"\1****\2"), "id_card": (r"\b(\d{6})\d{10}\d([\dXx])\b", r"\1********\2"), "credit_card": (r"\b\d{4}[- ]?\d{4}[- ]?\d{4}[- ]?(\d{4})\b", r"************\1"), "api_key": (MASKS["api_key"], "********")}
    stars = lambda n: f"repeat('*', length({n})::INT)"
    one = f"substr(m, 1, 1) || {stars("split_part(m, '@', 1)")} || '@' || {stars("split_part(split_part(m, '@', 2), '.', 1)")} || '.' || string_split(split_part(m, '@', 2), '.')[-1]"
    ctes = [f"""s0 AS (SELECT doc_id, text AS t, CASE WHEN regexp_matches(text, {q(email)}) THEN 'email' END AS k0, string_split_regex(text, {q(email)}) AS between,
      list_transform(regexp_extract_all(text, {q(email)}), lambda m: {one}) AS found FROM documents)""",
      "s1 AS (SELECT doc_id, [k0] AS ks, CASE WHEN k0 IS NULL THEN t ELSE array_to_string(list_transform(between, lambda b, i: b || coalesce(found[i], '')), '') END AS t FROM s0)"]
    for n, (kind, (pattern, by)) in enumerate(rest.items(), 2):
        ctes.append(f"s{n} AS (SELECT doc_id, list_append(ks, CASE WHEN regexp_matches(t, {q(MASKS[kind])}) THEN {q(kind)} END) AS ks, CASE WHEN regexp_matches(t, {q(MASKS[kind])}) THEN regexp_replace(t, {q(pattern)}, {q(by)}, 'g') ELSE t END AS t FROM s{n - 1})")
    return "WITH " + ",\n".join(ctes) + " SELECT doc_id, md5(t) AS masked_md5, coalesce(array_to_string(list_filter(ks, lambda x: x IS NOT NULL), ','), '') AS kinds FROM s5"


DOC_HITS = f"doc_hits AS (SELECT doc_id, list_transform({hits_of('text')}, lambda i: ({CATEGORIES})[i]) AS types FROM documents)"
WANTED = "wanted AS (SELECT doc_id, toxic, CASE WHEN toxic = 1 THEN ['command_injection', 'sqli'] ELSE ['ssrf', 'command_injection'] END AS types FROM labels)"
F1 = "CASE WHEN {p} + {r} = 0 THEN 0 ELSE 2 * {p} * {r} / ({p} + {r}) END"
PLAIN = r"trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def occurrences(x: str, part: str) -> str:
    return f"(length({x}) - length(replace({x}, '{part}', ''))) // {len(part)}"


ORACLES = {
    "rule_summary": f"WITH {DETECTED}, one AS (SELECT unnest(hits) AS i FROM detected) SELECT ({CATEGORIES})[i] AS category, ([{', '.join(q(s) for _, s, _ in RULES)}])[i] AS severity, count(*) AS hits FROM one GROUP BY ALL",
    "parse_formats": f"WITH {RAW} SELECT format, count(*) AS n FROM formats GROUP BY format",
    "parse_web": f"""WITH {RAW} SELECT event_id, format, ts_us, source_ip, "user", method, regexp_replace(regexp_replace(split_part(target, '?', 1), '/+', '/', 'g'), '/$', '') AS path, substr(target, instr(target, '?') + 1) AS query, status_code, bytes_sent, user_agent FROM web_rows""",
    "parse_json": f"WITH {RAW} SELECT event_id, ts_us, level, message, source_ip, user_agent, method, path, status_code, tenant FROM json_rows",
    "parse_tokens": f"""WITH {RAW} SELECT event_id, format, ts_us, "user", role, resource, action, result, level, pod, container, source_ip, "database", operation, query FROM tokens""",
    "url_parts": r"""WITH p AS (SELECT page_id, regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '\?([^#]*)', 1) AS query FROM pages),
      n AS (SELECT *, regexp_replace(coalesce(nullif(path, ''), '/'), '/+', '/', 'g') AS one FROM p)
      SELECT page_id, CASE WHEN length(one) > 1 THEN regexp_replace(one, '/$', '') ELSE one END AS path, coalesce(array_to_string(list_transform(list_filter(string_split(query, '&'), lambda x: regexp_matches(x, '=.')), lambda x: url_decode(replace(x, '+', ' '))), ' '), '') AS pairs FROM n""",
    "mask_pii": mask_sql(),
    "severity_and_agent": f"""WITH {NORMAL}, agents AS (SELECT {level_case('level')} AS level, lower(user_agent) AS a, source_ip FROM normal)
      SELECT level, CASE WHEN contains(a, 'chrome') AND NOT contains(a, 'edg') THEN 'Chrome' WHEN contains(a, 'firefox') THEN 'Firefox' WHEN contains(a, 'safari') THEN 'Safari' END AS browser,
        CASE WHEN contains(a, 'windows') THEN 'Windows' WHEN contains(a, 'mac') THEN 'macOS' WHEN contains(a, 'linux') THEN 'Linux' WHEN contains(a, 'iphone') THEN 'iOS' END AS os,
        CASE WHEN source_ip IS NOT NULL THEN 'Unknown' END AS country, count(*) AS n FROM agents GROUP BY ALL""",
    "rule_hits": f"""WITH t AS (SELECT text FROM documents UNION ALL SELECT text FROM conversations), h AS (SELECT unnest({hits_of('text')}) AS rule FROM t)
      SELECT rule::INT AS rule, ({CATEGORIES})[rule] AS category, ([{', '.join(q(s) for _, s, _ in RULES)}])[rule] AS severity, count(*) AS hits FROM h GROUP BY ALL""",
    "detect_threats": f"""WITH {DETECTED} SELECT event_id, format AS original_format, coalesce(array_to_string(types, ','), '') AS threat_types, coalesce(array_to_string(hits, ','), '') AS rules, detected_severity, CASE WHEN len(hits) > 0 THEN 0.8 ELSE 0.0 END::DOUBLE AS confidence,
      CASE WHEN len(hits) > 0 THEN 'matched rules: ' || array_to_string(list_transform(cats, lambda c, i: c || '_' || (i - 1)), ', ') ELSE 'no significant threats detected' END AS reason, CASE WHEN length(t) > 200 THEN substr(t, 1, 200) || '...' ELSE t END AS sanitized_excerpt FROM detected""",
    "tenant_threats": f"WITH {DETECTED} SELECT event_id, array_to_string(types, ',') AS threat_types FROM detected WHERE tenant = 'acme' AND len(types) > 0",
    "session_statistics": f"""WITH e AS (SELECT *, epoch_us(ts) AS us FROM events), x AS (SELECT event_id, count(*) OVER w AS n, len(list_distinct(list(event_type) OVER w)) AS unique_types, len(list_distinct(list(props) OVER w)) AS unique_props,
      sum((event_type = 'error')::INT) OVER w AS errors, avg(length(props)) OVER w AS al, (max(us) OVER w - min(us) OVER w) / 1000000.0::DOUBLE AS span FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us RANGE BETWEEN {DAY - 1} PRECEDING AND CURRENT ROW))
      SELECT event_id, n AS event_count, unique_types, unique_props, errors::BIGINT AS error_count, round(al, 6) AS avg_length, round(span, 6) AS time_span, CASE WHEN span > 0 THEN round(n / span, 9) ELSE 0 END::DOUBLE AS requests_per_second FROM x""",
    "session_history": """SELECT event_id, count(*) OVER w AS history_size, CASE WHEN count(*) OVER w >= 10 THEN round(avg(floor(value)) OVER w, 6) END AS history_mean, CASE WHEN count(*) OVER w >= 10 THEN round(stddev_pop(floor(value)) OVER w, 3) END AS history_std
      FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 999 PRECEDING AND CURRENT ROW)""",
    "fingerprints": f"WITH {NORMAL} SELECT event_id, md5(concat_ws('|', nullif(source_ip, ''), nullif(http_method, ''), nullif(http_path, ''), tenant, severity)) AS fingerprint FROM normal",
    "ttl_dedup": f"""WITH RECURSIVE {KEYED}, kept AS (SELECT fingerprint, min(ts_us) AS ts_us FROM keyed_events GROUP BY fingerprint
      UNION ALL SELECT k.fingerprint, min(e.ts_us) FROM kept k JOIN keyed_events e ON e.fingerprint = k.fingerprint AND e.ts_us >= k.ts_us + {2 * DAY} GROUP BY k.fingerprint)
      SELECT e.event_id, e.fingerprint, e.ts_us FROM kept k JOIN keyed_events e USING (fingerprint, ts_us)""",
    "suppressed_events": f"WITH {NORMAL} SELECT tenant, count(*) AS n FROM normal WHERE coalesce(source_ip, '') <> '203.0.7.1' AND tenant <> 'acme' GROUP BY tenant",
    "correlate_stateless": f"WITH {CORRELATED} SELECT event_id, window_hits, array_to_string(list_sort(wtypes), ',') AS window_types, go AS correlated, final_severity, best_key, correlation_id FROM correlated",
    "stream_correlation": f"WITH {CORRELATED} SELECT event_id, window_hits, array_to_string(list_sort(wtypes), ',') AS window_types, go AS correlated, final_severity, best_key, correlation_id FROM correlated",
    "active_correlations": f"WITH {CORRELATED} SELECT best_key, count(*) AS event_count, max(ts_us) AS latest_us, array_to_string(list_sort(list_distinct(flatten(list(types)))), ',') AS types, {NAMES.format(x='max(final_no)')} AS max_severity FROM correlated GROUP BY best_key",
    "correlation_totals": f"WITH {CORRELATED} SELECT count(*) AS total_events, count(*) FILTER (WHERE go) AS correlated_events, round(count(*) FILTER (WHERE go) / count(*), 6) AS correlation_rate FROM correlated",
    "plan_actions": f"WITH {ACTIONS} SELECT event_id, position, kind, ttl_sec, idempotent_key, correlation_id FROM planned",
    "executed_actions": f"WITH {ACTIONS} SELECT kind, CASE WHEN kind = 'revoke_token' THEN 'failed' ELSE 'executed' END AS status, count(*) AS n FROM planned GROUP BY ALL",
    "action_totals": f"WITH {ACTIONS} SELECT count(*) AS total_actions, count(*) FILTER (WHERE kind <> 'revoke_token') AS executed, count(*) FILTER (WHERE kind = 'revoke_token') AS failed, round(count(*) FILTER (WHERE kind <> 'revoke_token') / count(*), 6) AS success_rate FROM planned",
    "top_actions": f"WITH {ACTIONS} SELECT event_id, position, kind, ts_us FROM planned ORDER BY ts_us DESC, sha256(event_id || '|' || position) DESC LIMIT 100",
    "label_semi": f"WITH {DOC_HITS}, {WANTED} SELECT doc_id FROM wanted w WHERE EXISTS (SELECT 1 FROM doc_hits h WHERE h.doc_id = w.doc_id AND list_has_any(h.types, w.types))",
    "label_anti": f"WITH {DOC_HITS}, {WANTED} SELECT doc_id FROM wanted w WHERE NOT EXISTS (SELECT 1 FROM doc_hits h WHERE h.doc_id = w.doc_id AND list_has_any(h.types, w.types))",
    "confusion_metrics": f"""WITH {DOC_HITS}, j AS (SELECT toxic = 1 AS a, coalesce(len(h.types) > 0, false) AS p FROM labels l LEFT JOIN doc_hits h USING (doc_id)),
      c AS (SELECT count(*) FILTER (WHERE a AND p) AS tp, count(*) FILTER (WHERE NOT a AND p) AS fp, count(*) FILTER (WHERE a AND NOT p) AS fn, count(*) FILTER (WHERE NOT a AND NOT p) AS tn FROM j),
      r AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS p1, coalesce(tp / nullif(tp + fn, 0), 0) AS r1, coalesce(tn / nullif(tn + fn, 0), 0) AS p0, coalesce(tn / nullif(tn + fp, 0), 0) AS r0, tp + fn AS pos, tn + fp AS neg FROM c)
      SELECT tp, fp, fn, tn, round((p1 * pos + p0 * neg) / (pos + neg), 6) AS precision, round((r1 * pos + r0 * neg) / (pos + neg), 6) AS recall, round(({F1.format(p='p1', r='r1')} * pos + {F1.format(p='p0', r='r0')} * neg) / (pos + neg), 6) AS f1, round(r1, 6) AS detection_rate, round(coalesce(fp / nullif(neg, 0), 0), 6) AS false_positive_rate FROM r""",
    "grades": """WITH s AS (SELECT quality, avg(toxic) AS f FROM labels GROUP BY quality), t AS (SELECT quality, round(least(f / 0.85::DOUBLE, 1) * 40 + least(f * 20000 / 5000, 1) * 30 + least(15.0::DOUBLE / 20, 1) * 20 + 10, 6) AS total FROM s)
      SELECT quality, total, CASE WHEN total >= 90 THEN 'A' WHEN total >= 80 THEN 'B' WHEN total >= 70 THEN 'C' WHEN total >= 60 THEN 'D' ELSE 'F' END AS grade FROM t""",
    "run_metrics": f"WITH {ACTIONS}, d AS (SELECT count(*) AS n, count(*) FILTER (WHERE len(types) > 0) AS th, sum(len(hits))::BIGINT AS rh FROM detected), a AS (SELECT count(*) AS n FROM planned) SELECT d.n AS total_lines, th AS threat_events, rh AS rule_hits, a.n AS actions_taken, round(d.n / 2.0::DOUBLE, 2) AS throughput_lps FROM d, a",
    "latency_percentiles": "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type",
    "config_diff": """WITH o AS (SELECT 'account.' || s_suppkey AS key, s_nationkey::VARCHAR AS value FROM supplier), n AS (SELECT 'account.' || c_custkey AS key, c_nationkey::VARCHAR AS value FROM customer)
      SELECT coalesce(o.key, n.key) AS key, CASE WHEN o.key IS NULL THEN 'added' WHEN n.key IS NULL THEN 'removed' ELSE 'modified' END AS change, o.value AS old_value, n.value AS new_value FROM o FULL JOIN n ON o.key = n.key WHERE o.value IS DISTINCT FROM n.value""",
    "ml_features": f"""WITH p AS (SELECT doc_id, coalesce({PLAIN}, '') AS t FROM documents)
      SELECT doc_id, length(t) AS length, CASE WHEN t = '' THEN 0 ELSE len(string_split(t, ' ')) END::BIGINT AS words, round(coalesce((length(t) - length(replace(t, '_', ''))) / nullif(length(t), 0), 0), 9) AS special_ratio,
        {occurrences('t', 'select')} AS kw_0_select, {occurrences('t', 'or')} AS kw_6_or, {occurrences('t', 'and')} AS kw_7_and, {occurrences('t', 'nc')} AS kw_19_nc FROM p""",
    "idempotent_actions": f"""WITH RECURSIVE {ACTIONS}, acts_made AS MATERIALIZED (SELECT event_id, position, idempotent_key, ts_us FROM planned), kept AS (SELECT idempotent_key, min(ts_us) AS ts_us FROM acts_made GROUP BY idempotent_key
      UNION ALL SELECT k.idempotent_key, min(p.ts_us) FROM kept k JOIN acts_made p ON p.idempotent_key = k.idempotent_key AND p.ts_us > k.ts_us + {DAY} GROUP BY k.idempotent_key)
      SELECT event_id, position, idempotent_key FROM (SELECT p.*, row_number() OVER (PARTITION BY idempotent_key, ts_us ORDER BY event_id::VARCHAR || '|' || lpad(position::VARCHAR, 3, '0')) AS r FROM kept k JOIN acts_made p USING (idempotent_key, ts_us)) WHERE r = 1""",
    "evasion_free": rf"""WITH {LINES}, a AS (SELECT event_id, lower('A/* x */ &#x3C;B  ' || value) AS v FROM lines), b AS (SELECT event_id, regexp_replace(regexp_replace(v, '(?s)/\*.*?\*/', '', 'g'), '(?m)--.*$', '', 'g') AS v FROM a)
      SELECT event_id, trim(regexp_replace(replace(v, '&#x3c;', '<'), '\s+', ' ', 'g')) AS value FROM b""",
    "cleaned_lines": f"WITH {LINES} SELECT event_id, md5(value) AS value_md5 FROM lines WHERE event_id % 9 <> 0",
    "category_rules": f"SELECT c AS category, count(*) AS rules FROM (SELECT unnest({CATEGORIES}) AS c UNION ALL SELECT 'passage' FROM benchmark) GROUP BY c",
    "rule_table_hits": f"""WITH passages AS (SELECT (item_id + 1000)::INT AS rule, '(?i)' || array_to_string(list_transform(regexp_extract_all(text, '[A-Za-z]+')[1:3], lambda w: lower(w)), '[^A-Za-z]+') AS pattern FROM benchmark),
      h AS (SELECT unnest({hits_of('text')}) AS rule FROM documents)
      SELECT rule::INT AS rule, ({CATEGORIES})[rule] AS category, count(*) AS hits FROM h GROUP BY ALL
      UNION ALL SELECT p.rule, 'passage', count(*) FROM passages p JOIN documents d ON regexp_matches(d.text, p.pattern) GROUP BY ALL""",
    "network_owners": """WITH n AS (SELECT DISTINCT s_suppkey % 256 AS c, s_suppkey % 7 + 1 AS d, [8, 16, 24, 30, 32][s_suppkey % 5 + 1] AS len FROM supplier),
      nets AS (SELECT '203.0.' || c || '.' || d || '/' || len AS network, len, ((203 * 256 + 0) * 256 + c) * 256 + d AS num FROM n),
      e AS (SELECT event_id, '203.0.' || (user_id % 256) || '.' || (event_id % 7 + 1) AS ip, ((203 * 256 + 0) * 256 + user_id % 256) * 256 + event_id % 7 + 1 AS num FROM events)
      SELECT e.event_id, e.ip, nets.network, nets.len AS prefix_length FROM e LEFT JOIN nets ON e.num >> (32 - nets.len) = nets.num >> (32 - nets.len)
      QUALIFY row_number() OVER (PARTITION BY e.event_id ORDER BY nets.len DESC NULLS LAST, nets.network) = 1""",
    "numbered_file": "SELECT event_id, row_number() OVER (ORDER BY event_id) AS position FROM events",
    "json_objects": """SELECT event_id, epoch_us(date_trunc('second', ts)) AS ts_us, '203.0.113.' || (user_id % 256) AS source_ip, 'GET' AS http_method, '/' || event_type AS http_path,
      'q=' || user_id AS message, (props->>'$.k')::INT AS k, NULL::VARCHAR AS missing FROM events""",
    "refused_texts": r"""SELECT CASE WHEN length(coalesce(text, '')) > 600 THEN 'too long' WHEN trim(coalesce(text, ''), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) = '' THEN 'empty'
        WHEN regexp_matches(regexp_replace(text, ' ', '', 'g'), '[\p{C}\p{Z}]') THEN 'unprintable' END AS refused, count(*) AS n FROM documents GROUP BY 1""",
    "gbk_decode": f"WITH {LINES} SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '你好' ELSE '' END || value AS value FROM lines",
    "rate_limited": f"""WITH RECURSIVE e AS MATERIALIZED (SELECT event_id, user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
      r AS (SELECT event_id, user_id, n, true AS admitted, t AS last, NULL::BIGINT AS before FROM e WHERE n = 1
        UNION ALL SELECT e.event_id, e.user_id, e.n, x.ok, CASE WHEN x.ok THEN e.t ELSE r.last END, CASE WHEN x.ok THEN r.last ELSE r.before END
        FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1, LATERAL (SELECT r.before IS NULL OR e.t - r.before > {DAY} AS ok) x)
      SELECT event_id, admitted FROM r""",
}
