"""Planning, deduplicating, limiting and carrying out response actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .correlate import leading_edge
from .folds import RUN_ROWS, limited

TARGET = "struct<ip:string,token:string,session_id:string,user:string,tenant:string,ttl_sec:int>"


def _target(**fields: Column) -> Column:
    names = ("ip", "token", "session_id", "user", "tenant")
    return F.struct(*(fields.get(n, F.lit(None)).cast("string").alias(n) for n in names), fields.get("ttl_sec", F.lit(None)).cast("int").alias("ttl_sec"))


def idempotency_key(kind: Column, target: Column, hashed: bool = False) -> Column:
    """kind and the target's parts; ``hashed`` hides address and token behind the first 16 digits of a SHA-256."""
    hide = lambda c: F.substring(F.sha2(c, 256), 1, 16) if hashed else c
    part = lambda label, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{label}:"), hide(c) if label in ("ip", "token") else c))
    return F.concat_ws("|", kind, part("ip", target["ip"]), part("token", target["token"]), part("session", target["session_id"]), part("user", target["user"]), part("tenant", target["tenant"]))


def plan_actions(correlated: DataFrame, ts_us: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """A row for each planned action, in order (position): event_id, ts_us, correlation_id, kind, target, reason, idempotent_key, action_id (and ``keep``)."""
    severity, types = F.col("final_severity"), F.col("window_types")
    ip, tenant, user = F.col("source_ip"), F.col("tenant"), F.nullif("remote_user", F.lit(""))
    listed = F.array_join(types, ", ")
    has_ip = F.coalesce(ip, F.lit("")) != ""

    def action(when: Column, kind: str, target: Column, reason: Column) -> Column:
        return F.when(when, F.struct(F.lit(kind).alias("kind"), target.alias("target"), reason.alias("reason")))

    planned = F.array_compact(
        F.array(
            action((severity == "critical") & has_ip, "block_ip", _target(ip=ip, ttl_sec=F.lit(3600)), F.concat(F.lit("Critical severity threat: "), listed)),
            action(severity == "critical", "redact_log", _target(tenant=tenant), F.concat(F.lit("Critical threat detected for tenant "), tenant)),
            action((severity == "high") & has_ip, "throttle_ip", _target(ip=ip, ttl_sec=F.lit(1800)), F.concat(F.lit("High severity threat: "), listed)),
            action(F.array_contains(types, "sqli") & user.isNotNull(), "revoke_token", _target(user=user, tenant=tenant), F.lit("SQL injection attempt detected")),
            action(F.array_contains(types, "xss"), "notify", _target(tenant=tenant, user=user), F.lit("XSS attempt detected")),
            action((F.col("window_hits") > 3) & (F.size(types) > 1) & has_ip, "block_ip", _target(ip=ip, ttl_sec=F.lit(7200)), F.concat(F.lit("Multiple threat types detected: "), listed)),
        )
    )
    rows = correlated.select(*keep, "event_id", F.col(ts_us).alias("ts_us"), "correlation_id", F.posexplode(planned).alias("position", "a"))
    rows = rows.select(*keep, "event_id", "ts_us", "correlation_id", "position", "a.*")
    return rows.withColumn("idempotent_key", idempotency_key(F.col("kind"), F.col("target"))).withColumn("action_id", F.sha2(F.concat_ws("|", F.col("event_id").cast("string"), F.col("position").cast("string")), 256))


def idempotent_actions(actions: DataFrame, ttl_seconds: int = 300) -> DataFrame:
    """Actions whose key was not admitted in the last ``ttl_seconds`` (far end included)."""
    ordered = actions.withColumn("_tie", F.concat_ws("|", F.col("event_id").cast("string"), F.lpad(F.col("position").cast("string"), 3, "0")))
    return leading_edge(ordered, "idempotent_key", "ts_us", "_tie", ttl_seconds, inclusive=True).where("kept").drop("kept", "_tie")


def rate_limited(actions: DataFrame, keys: list[str], ts_us: str, tie: str, most: int = 100, seconds: float = 1.0, run_rows: int = RUN_ROWS) -> DataFrame:
    """Adds ``admitted``: at most ``most`` admitted rows of a key in any ``seconds``; rejected rows don't count.

    A key is as many tasks as it has pauses of that length, and blocks of
    ``run_rows`` rows where it has none (see ``folds``).
    """
    return limited(actions, keys, ts_us, tie, most, int(seconds * 1_000_000), run_rows)


def execute(actions: DataFrame, fail_limited: bool = False) -> DataFrame:
    """Status, times and result of each action (handlers are simulated: they validate their target).

    With ``fail_limited``, actions with a false ``admitted`` fail; without it, hand in admitted ones only.
    """
    t, kind = F.col("target"), F.col("kind")
    missing = F.when(kind.isin("block_ip", "throttle_ip") & t["ip"].isNull(), "no ip").when((kind == "revoke_token") & t["token"].isNull() & t["session_id"].isNull(), "no token or session").when((kind == "redact_log") & t["tenant"].isNull(), "no tenant")
    if fail_limited and "admitted" in actions.columns:
        missing = F.coalesce(F.when(~F.col("admitted"), F.lit("Rate limit exceeded")), missing)
    at = F.timestamp_micros(F.col("ts_us"))
    result = F.create_map(F.lit("action"), kind, F.lit("target"), F.coalesce(t["ip"], t["token"], t["session_id"], t["user"], t["tenant"], F.lit("")))
    return actions.withColumn("error", missing).withColumn("status", F.when(missing.isNull(), "executed").otherwise("failed")).withColumn("created_at", at).withColumn("executed_at", F.when(missing.isNull(), at)).withColumn("result", F.when(missing.isNull(), result))


def action_statistics(actions: DataFrame) -> DataFrame:
    done, failed = (F.sum((F.col("status") == s).cast("long")) for s in ("executed", "failed"))
    return actions.agg(F.count("*").alias("total_actions"), F.coalesce(done, F.lit(0)).alias("executed"), F.coalesce(failed, F.lit(0)).alias("failed"), F.coalesce(F.try_divide(done, done + failed), F.lit(1.0)).alias("success_rate"))


def latest_actions(actions: DataFrame, n: int = 100) -> DataFrame:
    """The last n by time, in ascending order."""
    return actions.orderBy(F.desc("ts_us"), F.desc("action_id")).limit(n).orderBy("ts_us", "action_id")
