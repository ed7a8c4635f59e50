"""Lines to raw events: format cascade and one parser for each format, all Column expressions."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import APACHE, CLOUD, CONTAINER, DATABASE, JSON_SHAPE, NGINX, TIME_FORMATS
from ..functions.text import deobfuscated
from .windows import settled

JSON_FIELDS = (
    "timestamp string, `@timestamp` string, time string, level string, severity string, message string, msg string, src_ip string, client_ip string, remote_addr string, source_ip string, "
    "user_agent string, agent string, method string, path string, url string, query string, status string, status_code string, tenant string, organization string, session_id string, user string, "
    "request struct<method:string,path:string,query_string:string>"
)


def parse_time(text: Column) -> Column:
    """Timestamp of the first format that fits; times without a zone are UTC (the session's zone).

    A format is only tried on texts that have its marks: a failure costs as much as many successes.
    """
    marks = lambda f: [m for m in ("/", "-", " ", "t") if m in re.sub(r"\[.*?\]", "", f).lower()]
    may = lambda f: reduce(lambda x, y: x & y, (F.lower(text).contains(m) for m in marks(f)))
    return F.coalesce(*(F.when(may(f), F.try_to_timestamp(text, F.lit(f))) for f in TIME_FORMATS))


def line_format(line: Column) -> Column:
    """Name of the first format of the cascade that fits."""
    return (
        F.when(F.trim(line) == "", "empty")
        .when(line.rlike(JSON_SHAPE) & F.try_parse_json(line).isNotNull(), "json")
        .when(line.rlike(NGINX), "nginx_combined")
        .when(line.rlike(APACHE), "apache_common")
        .when(line.rlike(CLOUD), "cloud_audit")
        .when(line.rlike(CONTAINER), "container")
        .when(line.rlike(DATABASE), "database_audit")
        .otherwise("raw")
    )


def _first(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns))


def json_field(path: str, kind: str = "string", fields: str = "fields") -> Column:
    """A value of the whole JSON object by its path, like ``$.request.headers.host``; null if it is not there or of no such type."""
    return F.try_variant_get(fields, path, kind)


def parse_lines(lines: DataFrame, strict_formats: bool = False, json_paths: Mapping[str, Sequence[str]] | None = None, whole_json: bool = False) -> DataFrame:
    """Raw events: all columns of ``lines`` and format, event_id and the parsed fields (null where a format has none).

    ``strict_formats`` tells container and database lines by their second token before cloud audit.
    ``json_paths`` names further places of a field in JSON lines, tried in order after
    the usual ones (``{"source_ip": ["$.network.client.ip"]}``).  ``whole_json`` adds
    ``fields``, a VARIANT of the whole object (null for other formats; see json_field),
    so that fields which no parser knows reach the event.
    """
    v = F.col("value")
    fmt = line_format(v)
    if strict_formats:
        fmt = F.when((fmt == "cloud_audit") & v.rlike(r"^\S+\s+(INFO|WARN|WARNING|ERROR|DEBUG|CRITICAL)\s"), "container").when((fmt == "cloud_audit") & v.rlike(r"(?i)^\S+\s+\S+\s+\S+\s+(SELECT|INSERT|UPDATE|DELETE|DROP|CREATE|ALTER)\s"), "database_audit").otherwise(fmt)
    df = lines.withColumn("_format", fmt)
    f = F.col("_format")
    web = f.isin("nginx_combined", "apache_common")
    # One array of groups for each line, made by the pattern of its format only.
    part = lambda pattern, i: F.regexp_extract(v, pattern, i)
    df = df.withColumn(
        "_groups",
        F.when(f == "nginx_combined", F.array(*(part(NGINX, i) for i in range(1, 9))))
        .when(f == "apache_common", F.array(*(part(APACHE, i) for i in range(1, 7))))
        .when(f == "cloud_audit", F.array(*(part(CLOUD, i) for i in range(1, 7))))
        .when(f == "container", F.array(*(part(CONTAINER, i) for i in range(1, 6))))
        .when(f == "database_audit", F.array(*(part(DATABASE, i) for i in range(1, 6)))),
    ).withColumn("_json", F.when(f == "json", F.from_json(v, JSON_FIELDS)))
    g = lambda i: F.try_element_at("_groups", F.lit(i))
    j = lambda name: F.col(f"_json.`{name}`")
    words = F.split(g(4), " ")
    target = F.try_element_at(words, F.lit(2))
    is_ = lambda *names: f.isin(*names)
    request = j("request").isNotNull()
    dotted = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"
    stamp = F.when(f == "json", _first(j("timestamp"), j("@timestamp"), j("time"))).when(web, g(3)).when(is_("cloud_audit", "container", "database_audit"), g(1))
    columns = {
        "timestamp": parse_time(stamp),
        "level": F.when(f == "json", _first(j("level"), j("severity"))).when(f == "container", g(2)),
        "message": F.when(f == "json", _first(j("message"), j("msg"))).when(f == "container", g(5)).when(is_("cloud_audit", "raw"), v),
        "source_ip": F.when(f == "json", _first(j("src_ip"), j("client_ip"), j("remote_addr"), j("source_ip"))).when(web, g(1)).when(f == "container", F.nullif(F.regexp_extract(g(5), dotted, 0), F.lit(""))),
        "user_agent": F.when(f == "json", _first(j("user_agent"), j("agent"))).when(f == "nginx_combined", g(8)),
        "method": F.when(f == "json", F.when(request, j("request").getField("method")).otherwise(j("method"))).when(web, F.try_element_at(words, F.lit(1))),
        "path": F.when(f == "json", F.when(request, j("request").getField("path")).otherwise(_first(j("path"), j("url")))).when(web, F.substring_index(target, "?", 1)),
        "query": F.when(f == "json", F.when(request, j("request").getField("query_string")).otherwise(j("query"))).when(web, F.coalesce(F.when(target.contains("?"), F.substr(target, F.locate("?", target) + 1)), F.lit(""))).when(f == "database_audit", g(5)),
        "status_code": F.when(f == "json", _first(j("status"), j("status_code"))).when(web, g(5)).try_cast("int"),
        "bytes_sent": F.when(web, g(6)).try_cast("long"),
        "referer": F.when(f == "nginx_combined", g(7)),
        "user": F.when(f == "json", j("user")).when(web | is_("cloud_audit", "database_audit"), F.when(web, g(2)).otherwise(g(2))),
        "role": F.when(f == "cloud_audit", g(3)),
        "resource": F.when(f == "cloud_audit", g(4)),
        "action": F.when(f == "cloud_audit", g(5)),
        "result": F.when(f == "cloud_audit", g(6)),
        "pod": F.when(f == "container", g(3)),
        "container": F.when(f == "container", g(4)),
        "database": F.when(f == "database_audit", g(3)),
        "operation": F.when(f == "database_audit", g(4)),
        "session_id": F.when(f == "json", j("session_id")),
        "tenant": F.when(f == "json", F.coalesce(_first(j("tenant"), j("organization")), F.lit("default"))).when(f != "raw", "default"),
        "parse_error": F.when(v.rlike(JSON_SHAPE) & (f != "json"), "invalid JSON"),
    }
    if json_paths or whole_json:
        df = df.withColumn("_whole", F.when(f == "json", F.try_parse_json(v)))
    for name, paths in (json_paths or {}).items():
        if name not in columns:
            raise ValueError(f"no field {name}")
        texts = [F.nullif(F.try_variant_get("_whole", path, "string"), F.lit("")) for path in paths]
        kind = {"status_code": "int", "bytes_sent": "long"}.get(name)
        if name == "timestamp":
            stamp = F.when(f == "json", F.coalesce(_first(j("timestamp"), j("@timestamp"), j("time")), *texts)).otherwise(stamp)
            columns[name] = parse_time(stamp)
        elif name == "tenant":
            columns[name] = F.when(f == "json", F.coalesce(_first(j("tenant"), j("organization")), *texts, F.lit("default"))).otherwise(columns[name])
        else:
            columns[name] = F.coalesce(columns[name], *(t.try_cast(kind) if kind else t for t in texts))
    whole = [F.col("_whole").alias("fields")] if whole_json else []
    source = F.col("source") if "source" in lines.columns else F.lit("")
    number = F.col("line_number").cast("string") if "line_number" in lines.columns else F.lit("")
    event_id = [F.sha2(F.concat_ws("|", source, number, v), 256).alias("event_id")] if "event_id" not in lines.columns else []
    kept = [c for c in lines.columns if c not in columns and c != "format" and not (whole_json and c == "fields")]
    tenant_given = {"tenant": F.coalesce(F.col("tenant"), columns["tenant"])} if "tenant" in lines.columns else {}
    parsed = df.select(*kept, f.alias("format"), *event_id, *((columns | tenant_given)[n].alias(n) for n in columns), *whole)
    return parsed


def with_decoded_query(events: DataFrame) -> DataFrame:
    """decoded_query of database events, after up to five rounds of decoding."""
    return events.withColumn("decoded_query", F.when(F.col("format") == "database_audit", deobfuscated(F.when(F.col("format") == "database_audit", F.col("query")))))


def for_tenant(events: DataFrame, tenant: str | None) -> DataFrame:
    return events if tenant is None else settled(events).where(F.col("tenant") == tenant)
