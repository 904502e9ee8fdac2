"""Longest-prefix match against Python's address library."""
import ipaddress
import random

from pyspark.sql import functions as F

from msgsieve.operators.prefixes import address_digits, longest_prefix


def test_digits_of_addresses(spark):
    good = ["::", "::1", "2001:db8::1", "fe80::1:2:3", "1:2:3:4:5:6:7:8", "1::8", "ABCD:ef01::", "::ffff:10.1.2.3", "64:ff9b::192.0.2.33", "1:2:3:4:5:6:7::", "0.0.0.0", "255.255.255.255", "10.1.2.3"]
    bad = ["", "x", "1:2:3", "1::2::3", ":::", "1:2:3:4:5:6:7:8:9", "12345::", "256.1.1.1", "1.2.3", "::ffff:300.1.1.1", "1:", ":1", "1:2:3:4:5:6:7:8::", "10.1.2.3.4"]
    got = {r.ip: r.d for r in spark.createDataFrame([(x,) for x in good + bad], "ip string").select("ip", address_digits(F.col("ip")).alias("d")).collect()}

    def digits(x):
        a = ipaddress.ip_address(x)
        return f"{int(a) if a.version == 6 else int(a) + (0xffff << 32):032x}"

    assert got == {x: digits(x) for x in good} | dict.fromkeys(bad)


def test_narrowest_network(spark):
    rng = random.Random(5)
    six = [ipaddress.IPv6Address((0x20010db8 << 96) + (rng.randrange(4) << 90) + (rng.randrange(4) << 61) + rng.randrange(8)) for _ in range(120)]
    four = [ipaddress.IPv4Address((93 << 24) + (rng.randrange(4) << 15) + rng.randrange(8)) for _ in range(120)]
    nets = ({ipaddress.ip_network((x, rng.choice([0, 8, 32, 37, 38, 64, 67, 126, 128])), strict=False) for x in six[:40]}
            | {ipaddress.ip_network((x, rng.choice([0, 8, 16, 17, 30, 32])), strict=False) for x in four[:40]})
    rows = [(str(n), n.prefixlen) for n in nets] + [("nonsense/8", 1), ("10.0.0.0/33", 2), ("1.2.3.4/x", 3), (None, 4)]

    def narrowest(x):
        hits = [n for n in nets if n.version == x.version and x in n]
        hits += [n for n in nets if x.version == 4 and n.version == 6 and ipaddress.IPv6Address(f"::ffff:{x}") in n]
        return str(max(hits, key=lambda n: n.prefixlen + (96 if n.version == 4 else 0))) if hits else None

    df = spark.createDataFrame([(str(x),) for x in six + four] + [(None,), ("no address",)], "ip string")
    got = {r.ip: r.network for r in longest_prefix(df, spark.createDataFrame(rows, "network string, rank int")).collect()}
    assert got == {str(x): narrowest(x) for x in six + four} | {"no address": None}
    none = longest_prefix(df, spark.createDataFrame([], "network string, rank int"))
    assert none.columns == ["ip", "network", "rank"] and none.where("network is not null").count() == 0
