"""Addresses joined with a table of networks: the longest prefix that holds them.

Networks of one length are equal to the addresses cut to it, so the range
join is an equi-join on (length, cut address): an address becomes one row for
each length that occurs in the table (33 and 129 at most, and few in practice),
and the longest that meets is kept.  The table may be of any size; Spark chooses
how to join, and no row is compared with more than the networks that hold it.
"""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from ..functions.net import IPV4, ip_number, normal_ip
from .windows import settled


@pandas_udf(StringType())
def _bits6(ip: pd.Series) -> pd.Series:
    return ip.map(lambda s: ipaddress.IPv6Address(s).packed.hex(), na_action="ignore")


def address_hex(ip: Column) -> Column:
    """A canonical address as hexadecimal digits, 8 for IPv4 and 32 for IPv6."""
    four = ip.rlike(IPV4)
    six = ~four & ip.isNotNull()
    return F.when(four, F.lpad(F.hex(F.when(four, ip_number(ip))), 8, "0")).otherwise(_bits6(F.when(six, ip)))


def cut_hex(digits: Column, length: Column) -> Column:
    """The first ``length`` bits of hexadecimal digits: whole digits, and what is left of the next one."""
    whole = F.floor(length / 4).cast("int")
    rest = (length % 4).cast("int")
    next_one = F.conv(F.substr(digits, whole + 1, F.lit(1)), 16, 10).cast("int")
    # what is below the prefix is taken off
    kept = F.hex((next_one - F.pmod(next_one, F.pow(F.lit(2), 4 - rest).cast("int"))).cast("long"))
    return F.concat(F.substr(digits, F.lit(1), whole), F.when(rest > 0, kept).otherwise(""))


def network_rows(networks: DataFrame, column: str = "network") -> DataFrame:
    """The table with ``_family`` (4, 6), ``_length`` and ``_bits`` of each network; those that are none go.

    Bits beyond the prefix are ignored (10.1.2.3/8 is 10.0.0.0/8); without a slash it is one address.
    """
    text = F.trim(F.col(column))
    rows = settled(networks.withColumn("_ip", normal_ip(F.split_part(text, F.lit("/"), F.lit(1)))))
    family = F.when(F.col("_ip").rlike(IPV4), 4).when(F.col("_ip").isNotNull(), 6)
    most = F.when(F.col("_family") == 4, 32).otherwise(128)
    length = F.when(text.contains("/"), F.split_part(text, F.lit("/"), F.lit(-1)).try_cast("int")).otherwise(most)
    rows = rows.withColumn("_family", family).withColumn("_length", length).withColumn("_digits", F.upper(address_hex(F.col("_ip"))))
    fine = settled(rows).where(F.col("_family").isNotNull() & F.col("_length").between(0, most))
    return fine.withColumn("_bits", cut_hex(F.col("_digits"), F.col("_length"))).drop("_digits", "_ip")


def with_network(df: DataFrame, ip_col: str, networks: DataFrame, network_col: str = "network") -> DataFrame:
    """Every row with ``network``, ``prefix_length`` and the other columns of the longest network that holds its address (null if none).

    Of networks that are the same the one that is written smaller counts.  An address
    that is null or none has no network.  Columns of the table that clash with those
    of ``df`` are left out.
    """
    more = [c for c in networks.columns if c != network_col and c not in df.columns]
    table = network_rows(networks, network_col)
    facts = F.struct(F.col("_length").alias("prefix_length"), F.col(network_col).alias("network"), *more)
    one = table.groupBy("_family", "_length", "_bits").agg(F.min_by(facts, F.struct(F.col(network_col), *more)).alias("_facts"))
    lengths = one.groupBy("_family").agg(F.collect_set("_length").alias("_lengths"))  # two rows, 33 and 129 lengths at most
    # each distinct address once, whatever number of rows it has
    addresses = settled(df.select(F.col(ip_col).alias("_ip")).distinct().withColumn("_own", normal_ip(F.col("_ip")))).where("_own is not null")
    known = addresses.withColumns({"_family": F.when(F.col("_own").rlike(IPV4), 4).otherwise(6), "_digits": F.upper(address_hex(F.col("_own")))})
    each = settled(known).join(F.broadcast(lengths), "_family").select("_ip", "_family", "_digits", F.explode("_lengths").alias("_length"))
    cut = each.withColumn("_bits", cut_hex(F.col("_digits"), F.col("_length")))
    best = cut.join(one, ["_family", "_length", "_bits"]).groupBy("_ip").agg(F.max_by("_facts", "_length").alias("_facts"))
    joined = df.join(best, F.col(ip_col) == F.col("_ip"), "left")
    return joined.select(*df.columns, F.col("_facts.network").alias("network"), F.col("_facts.prefix_length").alias("prefix_length"), *(F.col(f"_facts.`{c}`").alias(c) for c in more))
