"""F29 returns every entity key, and J9 joins on each."""
from pyspark.sql import functions as F

from msgsieve.functions.text import entity_keys
from msgsieve.operators import lookups as lk


def test_no_key_is_cut(spark):
    body = ", ".join(f"40855501{n:02d}" for n in range(9))
    df = spark.createDataFrame([(1, "a@late.example.com", body), (2, "BANK", body), (3, None, None)], "id long, sender string, body string")
    got = {x.id: x.k for x in df.select("id", entity_keys(F.col("sender"), F.col("body")).alias("k")).collect()}
    phones = [f"phone:40855501{n:02d}" for n in range(9)]
    assert got == {1: [*phones, "domain:late.example.com"], 2: [*phones, "alpha:BANK"], 3: []}
    crumbs = spark.createDataFrame([(1, 1, "mail", 1, ["domain:late.example.com"]), (2, 2, "sms", 0, ["phone:4085550108"])],
                                   "crumb_id long, ts long, channel string, label int, entities array<string>")
    assert {x.id: (x.hits, x.threat_hits) for x in lk.entity_risk(df, crumbs).collect()} == {1: (2, 1), 2: (1, 0)}
