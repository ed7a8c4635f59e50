"""Longest-prefix joins against the ipaddress module."""

import ipaddress
import random

from palisade.operators.networks import with_network


def generated(seed=7):
    rng = random.Random(seed)
    v4 = lambda: str(ipaddress.IPv4Address(rng.choice([0x0A000000, 0xCB007100]) + rng.randrange(1 << 16)))
    v6 = lambda: str(ipaddress.IPv6Address((0x20010DB8 << 96) + rng.randrange(1 << 20) + (rng.randrange(4) << 64)))
    networks = [f"{v4()}/{rng.choice([0, 7, 8, 16, 23, 24, 27, 30, 32])}" for _ in range(150)] + [f"{v6()}/{rng.choice([32, 61, 63, 64, 110, 127, 128])}" for _ in range(150)]
    networks += [v4(), v6(), "10.0.0.0/33", "10.0.0.0/x", "nothing", "", None, "::/0" if seed % 2 else "fe80::/10"]
    addresses = [v4() for _ in range(300)] + [v6() for _ in range(300)] + ["10.0.0.1:8080", "8.8.8.8", "fe80::1", "300.1.1.1", "x", "", None, "2001:DB8::5"]
    return networks, addresses


def test_longest_prefix(spark):
    networks, addresses = generated()
    table = spark.createDataFrame([(n, f"owner{i}", "clash") for i, n in enumerate(networks)], "network string, owner string, ip string")
    df = spark.createDataFrame([(i, a) for i, a in enumerate(addresses)], "id int, ip string").repartition(3)
    got = with_network(df, "ip", table)
    assert got.columns == ["id", "ip", "network", "prefix_length", "owner"]
    parsed = []
    for n in networks:
        try:
            parsed.append((n, ipaddress.ip_network(n, strict=False)))
        except ValueError:
            continue
    rows = {r.id: r for r in got.collect()}
    assert len(rows) == len(addresses)
    for i, a in enumerate(addresses):
        try:
            ip = ipaddress.ip_address(a.split(":")[0] if a and ":" in a and "." in a else a)
        except ValueError:
            ip = None
        inside = [(n.prefixlen, t) for t, n in parsed if ip is not None and ip.version == n.version and ip in n]
        if not inside:
            assert rows[i].network is None and rows[i].prefix_length is None and rows[i].owner is None
        else:
            longest = max(x for x, _ in inside)
            assert rows[i].prefix_length == longest and rows[i].network == min(t for x, t in inside if x == longest)
            assert rows[i].owner in {f"owner{k}" for k, n in enumerate(networks) if n == rows[i].network}
    assert sum(r.network is not None for r in rows.values()) > 300


def test_no_nested_loop_and_nothing(spark):
    networks, addresses = generated(8)
    table = spark.createDataFrame([(n,) for n in networks], "network string")
    df = spark.createDataFrame([(a,) for a in addresses], "ip string")
    plan = with_network(df, "ip", table)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert with_network(df, "ip", table.limit(0)).where("network is not null").count() == 0
    assert with_network(df.limit(0), "ip", table).count() == 0
