"""Addresses, user agents, methods, status codes, paths and query strings."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from .fixed import LEVEL_WORDS, METHODS, PRIVATE_NETWORKS

OCTET = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
IPV4 = rf"^{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}$"


@pandas_udf(StringType())
def _ipv6(text: pd.Series) -> pd.Series:
    def one(s: str) -> str | None:
        try:
            return str(ipaddress.ip_address(s))
        except ValueError:
            return None

    return text.map(one, na_action="ignore")


def normal_ip(ip: Column) -> Column:
    """Canonical address or null; with both ``:`` and ``.`` the part before the first ``:`` counts."""
    host = F.when(ip.contains(":") & ip.contains("."), F.substring_index(ip, ":", 1)).otherwise(ip)
    v6 = host.contains(":")
    return F.when(host.rlike(IPV4), host).when(v6, _ipv6(F.when(v6, host)))


def ip_number(ip: Column) -> Column:
    """A dotted quad as a bigint."""
    parts = F.split(ip, r"\.")
    return sum((F.try_element_at(parts, F.lit(i + 1)).try_cast("long") * (256 ** (3 - i)) for i in range(4)), F.lit(0).cast("long"))


def in_network(ip: Column, network: str) -> Column:
    net = ipaddress.ip_network(network)
    return ip.rlike(IPV4) & ip_number(ip).between(int(net.network_address), int(net.broadcast_address))


def network_pattern(network: str) -> str:
    """A pattern of the dotted quads of a network."""
    net = ipaddress.ip_network(network)
    whole, rest = divmod(net.prefixlen, 8)
    octets = net.network_address.packed
    parts = [str(x) for x in octets[:whole]]
    if rest:
        parts.append(f"(?:{'|'.join(str(x) for x in range(octets[whole], octets[whole] + (1 << (8 - rest))))})")
    return r"\.".join([*parts, *[OCTET] * (4 - len(parts))])


def location(ip: Column) -> Column:
    """Struct country, region, city: private networks are known, others are not; null without an address."""
    private = ip.rlike(f"^(?:{'|'.join(network_pattern(n) for n in PRIVATE_NETWORKS)})$")  # one look at the address, whatever the networks
    place = lambda names: F.struct(*(F.lit(v).alias(k) for k, v in zip(("country", "region", "city"), names, strict=True)))
    return F.when(ip.isNotNull(), F.when(private, place(("Private", "Internal Network", "Local"))).otherwise(place(("Unknown",) * 3)))


def severity_level(text: Column) -> Column:
    low = F.lower(text)
    out = F.when(F.coalesce(text, F.lit("")) == "", "medium")
    for level, words in LEVEL_WORDS.items():
        out = out.when(low.isin(*words), level)
    for level, parts in (("critical", ("crit", "fatal", "emerg")), ("high", ("err",)), ("medium", ("warn",))):
        for part in parts:
            out = out.when(low.contains(part), level)
    return out.otherwise("low")


def user_agent(agent: Column) -> Column:
    """Struct browser, os."""
    a = F.lower(agent)
    has = lambda *parts: F.exists(F.array(*(F.lit(p) for p in parts)), lambda p: F.contains(a, p))
    browser = F.when(has("chrome") & ~has("edg"), "Chrome").when(has("firefox"), "Firefox").when(has("safari") & ~has("chrome"), "Safari").when(has("edg"), "Edge").when(has("opera"), "Opera")
    system = F.when(has("windows"), "Windows").when(has("mac", "osx"), "macOS").when(has("linux"), "Linux").when(has("android"), "Android").when(has("ios", "iphone", "ipad"), "iOS")
    return F.struct(browser.alias("browser"), system.alias("os"))


def http_method(method: Column) -> Column:
    m = F.upper(method)
    return F.when(m.isin(*METHODS), m).otherwise("UNKNOWN")


def http_status(status: Column) -> Column:
    code = status.try_cast("int")
    return F.when(code.between(100, 599), code)


def http_path(path: Column) -> Column:
    """``/`` if missing; runs of slashes as one; no slash at the end."""
    one = F.regexp_replace(F.coalesce(F.nullif(path, F.lit("")), F.lit("/")), "/+", "/")
    return F.when(F.length(one) > 1, F.regexp_replace(one, "/$", "")).otherwise(one)


def query_pairs(query: Column) -> Column:
    """Decoded (key, value) structs in order: blank values dropped, the first of each key."""
    decode = lambda x: F.coalesce(F.try_url_decode(x), x)
    parts = F.filter(F.split(F.coalesce(query, F.lit("")), "&"), lambda p: p.contains("="))
    pairs = F.transform(parts, lambda p: F.struct(decode(F.substring_index(p, "=", 1)).alias("key"), decode(F.substr(p, F.locate("=", p) + 1)).alias("value")))
    pairs = F.filter(pairs, lambda p: p["value"] != "")
    return F.aggregate(pairs, F.slice(pairs, 1, 0), lambda acc, p: F.when(F.exists(acc, lambda q: q["key"] == p["key"]), acc).otherwise(F.concat(acc, F.array(p))))
