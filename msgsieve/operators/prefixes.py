"""Longest-prefix match of IPv4 and IPv6 addresses with a table of networks.

Addresses and networks are 128-bit numbers as 32 hexadecimal digits (IPv4 in
its mapped form).  An address is asked for once per prefix length that the
table holds, by an equal join on (length, leading bits); the longest match
wins, so nested networks resolve to the narrowest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAPPED = "0" * 20 + "ffff"
QUAD = r"^(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})$"


def _quad_digits(ip: Column) -> Column:
    """Eight hexadecimal digits of a dotted IPv4 address; null if it is none."""
    octets = [F.regexp_extract(ip, QUAD, i).try_cast("int") for i in range(1, 5)]
    return F.when(ip.rlike(QUAD) & (F.greatest(*octets) <= 255), F.concat(*[F.lpad(F.lower(F.hex(x)), 2, "0") for x in octets]))


def address_digits(ip: Column) -> Column:
    """32 hexadecimal digits of an IPv4 or IPv6 address; null if it is neither."""
    tail = F.regexp_extract(ip, r":(\d+\.\d+\.\d+\.\d+)$", 1)
    quad = _quad_digits(tail)
    plain = F.lower(F.when(tail == "", ip).otherwise(F.concat(F.regexp_replace(ip, r"[^:]*$", ""), F.substring(quad, 1, 4), F.lit(":"), F.substring(quad, 5, 4))))

    def groups(side: int) -> Column:
        return F.filter(F.split(F.coalesce(F.get(F.split(plain, "::"), side), F.lit("")), ":"), lambda x: x != "")

    def digits(side: int) -> Column:
        return F.array_join(F.transform(groups(side), lambda x: F.lpad(x, 4, "0")), "")

    left = 8 - F.size(groups(0)) - F.size(groups(1))
    short = plain.contains("::")
    whole = plain.rlike(r"^(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*)?(?:::)?(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*)?$") & F.when(short, left >= 1).otherwise(left == 0)
    six = F.when(whole, F.concat(digits(0), F.repeat(F.lit("0000"), left.cast("int")), digits(1)))
    return F.when(ip.contains(":"), six).otherwise(F.concat(F.lit(MAPPED), _quad_digits(ip)))


def leading_bits(digits: Column, length: Column) -> Column:
    """The first ``length`` bits as hexadecimal digits, the last one padded by zero bits."""
    whole, rest = F.floor(length / 4).cast("int"), length % 4
    unit = F.pow(F.lit(2), 4 - rest).cast("int")
    last = F.conv(F.substr(digits, whole + 1, F.lit(1)), 16, 10).cast("int")
    return F.concat(F.substr(digits, F.lit(1), whole), F.when(rest == 0, "").otherwise(F.lower(F.hex(last - last % unit))))


def longest_prefix(df: DataFrame, networks: DataFrame, ip: str = "ip", network: str = "network") -> DataFrame:
    """One row per distinct address: ``ip``, the narrowest ``network`` that holds it, and that network's other columns.

    ``network`` is text like ``10.0.0.0/8`` or ``2001:db8::/32``; bits behind the
    length are ignored, and an address without a length is a network of its
    own.  Addresses in no network, and texts that are no address, have nulls;
    networks that cannot be read match nothing.  Of networks written twice
    the row with the least values stays.  Null addresses are left out.
    """
    others = [c for c in networks.columns if c != network]
    address, bits = F.split_part(network, F.lit("/"), F.lit(1)), F.split_part(network, F.lit("/"), F.lit(2))
    most = F.when(address.contains(":"), 128).otherwise(32)
    size = F.when(~F.col(network).contains("/"), most).otherwise(bits.try_cast("int"))
    held = networks.select(address_digits(address).alias("_digits"), F.when(size.between(0, most), size + 128 - most).alias("_length"), F.struct(F.col(network).alias("network"), *others).alias("_net"))
    held = held.where("_digits is not null and _length is not null")
    held = held.groupBy("_length", leading_bits(F.col("_digits"), F.col("_length")).alias("_bits")).agg(F.min("_net").alias("_net"))
    lengths = [r[0] for r in held.select("_length").distinct().collect()]  # at most 129
    ips = df.select(F.col(ip).alias("ip")).where("ip is not null").distinct().withColumn("_digits", address_digits(F.col("ip")))
    asked = ips.where("_digits is not null").withColumn("_length", F.explode(F.array(*map(F.lit, lengths)).cast("array<int>")))
    asked = asked.withColumn("_bits", leading_bits(F.col("_digits"), F.col("_length")))
    best = asked.join(held, ["_length", "_bits"]).groupBy("ip").agg(F.max_by("_net", "_length").alias("_net"))
    return ips.select("ip").join(best, "ip", "left").select("ip", *[F.col(f"_net.{c}").alias(c) for c in ("network", *others)])
