"""J9 and W12 read every crumb and event, against brute force."""
import os
import random
from collections import defaultdict

import pytest

import __spark_entry__ as entry
from msgsieve.operators import lookups as lk

SF = "/root/testdata/sf0.001"


def test_entity_risk_reads_all_crumbs(spark):
    r = random.Random(5)
    names = [f"d{n}.com" for n in range(12)]
    crumbs = []
    for n in range(1500):
        # d0 is old only, d1 is hot, d2 comes with d3
        at = [names[0]] if n < 30 else [names[1]] if n % 2 else [names[2], names[3]] if n % 3 else [r.choice(names[4:])]
        crumbs.append((n, n // 3, r.choice(["sms", "mail", "call"]), r.choice([0, 0, 0, 1]), [f"domain:{x}" for x in at]))
    messages = [(n, " ".join(f"a@{x}" for x in r.sample(names, r.randint(1, 4))), "") for n in range(80)]
    messages += [(900, "a@d0.com", ""), (901, "a@d2.com a@d3.com a@d2.com", ""), (902, "a@nowhere.org", "")]
    df = spark.createDataFrame(messages, "id long, sender string, body string")
    got = {x.id: (x.hits, x.threat_hits, x.channels, x.boost) for x in lk.entity_risk(
        df, spark.createDataFrame(crumbs + crumbs[:50], "crumb_id long, ts long, channel string, label int, entities array<string>")).collect()}
    want = {}
    for i, sender, _ in messages:
        keys = {f"domain:{x[2:]}" for x in sender.split()}
        near = sorted((c for c in crumbs if keys & set(c[4])), key=lambda c: (-c[1], -c[0]))[:40]
        if near:
            threats = sum(c[3] for c in near)
            want[i] = (len(near), threats, ",".join(sorted({c[2] for c in near})), round(min(0.25, 0.05 * threats), 3))
    assert got == want and got[900][0] == 30


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
def test_lookback_reads_all_events(spark):
    users = defaultdict(list)
    for x in spark.read.parquet(f"{SF}/events.parquet").select("user_id", "ts", "event_id").collect():
        users[x.user_id].append((x.ts, x.event_id))
    want = sorted((u, e, n + 1) for u, rows in users.items() for n, (_, e) in enumerate(sorted(rows, reverse=True)[:40]))
    assert sorted(map(tuple, entry.queries()["W12_recent_lookback"](spark, SF).collect())) == want
