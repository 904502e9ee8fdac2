"""op3 over every conversation and turn, against brute force."""
import hashlib
import os
import random
from collections import defaultdict

import pytest

import __spark_entry__ as entry
from msgsieve.llm.chat import every_conversation_pairs, preference_turns

SF = "/root/testdata/sf0.001"


def digest(*parts):
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:8], 16)


def brute(rows, group):
    """Rendered rows of the pairs, from cleaned (conv_id, turn, role, text)."""
    talks = defaultdict(list)
    for c, t, role, text in sorted(rows):
        talks[c].append((t, role, text))
    at, said = {}, {}
    for c, talk in talks.items():
        replies = [(digest(c, t), t, text) for t, role, text in talk if role == "assistant"]
        if replies:
            at[c] = min(replies)
            said[c] = [min(replies)[2], min(x[2] for x in replies), max(x[2] for x in replies)]
    groups, rings = max(1, len(at) // group), defaultdict(list)
    for c in at:
        rings[digest(c) % groups].append((digest(c), c))
    other = {}
    for ring in rings.values():
        ring.sort()
        for (_, c), (_, near) in zip(ring, ring[1:] + ring[:1]):
            other[c] = next(x for x in [*said[near], *said[c][1:], "", "no reply"] if x != at[c][2])
    out = []
    for c, talk in talks.items():
        split = at[c][1] if c in at else float("inf")
        for t, role, text in talk:
            out.append((c, "prompt" if t < split else "chosen", t, f"<|{role}|>\n{text}<|end|>\n", t >= split and role == "assistant"))
            if t == split:
                out.append((c, "rejected", t, f"<|{role}|>\n{other[c]}<|end|>\n", True))
    return sorted(out)


@pytest.mark.parametrize("group", [4, 64])
def test_every_conversation_and_turn(spark, group):
    r = random.Random(group)
    rows = [(c, t, r.choice(["user", "assistant"]), r.choice(["", "a", "b", f"text {c}"])) for c in range(60) for t in range(r.randint(1, 6))]
    rows += [(100, 0, "user", "no reply at all"), (101, 0, "assistant", "one reply"), (101, 1, "user", "and a turn after it")]
    chosen, rejected = every_conversation_pairs(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), group)
    got = sorted(map(tuple, preference_turns(chosen, rejected).collect()))
    assert got == brute(rows, group)
    assert {x[0] for x in got} == {x[0] for x in rows}
    assert sorted((x[0], x[2]) for x in got if x[1] != "rejected") == sorted(x[:2] for x in rows)


@pytest.mark.parametrize("text, other", [("a", ""), ("", "no reply")])
def test_replies_all_the_same_still_differ(spark, text, other):
    rows = [(c, 0, "assistant", text) for c in range(3)]
    got = preference_turns(*every_conversation_pairs(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()
    assert sorted((x.pair_id, x.rendered) for x in got if x.part == "rejected") == [(c, f"<|assistant|>\n{other}<|end|>\n") for c in range(3)]


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
def test_query_renders_every_turn(spark):
    turns = spark.read.parquet(f"{SF}/conversations.parquet").where("conv_id is not null and turn is not null").select("conv_id", "turn").distinct()
    got = entry.queries()["op3_chat_preferences"](spark, SF).where("part <> 'rejected'").selectExpr("pair_id as conv_id", "turn")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, turns.collect()))
