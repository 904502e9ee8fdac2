"""Keyed snapshots rewritten piece by piece, hash trees of two tables."""

from pyspark.sql import functions as F

from msgsieve.catalog import keyed_queries as kq
from msgsieve.catalog.registry import ORACLES, Inputs, query
from msgsieve.catalog.sources_queries import folder
from msgsieve.operators import hash_tree as ht, keyed as k, snapshots as sn

PIECE_ROWS = 20_000


def rewritten(i: Inputs, old, changes, keys, merge):
    """``old`` as a snapshot, changes applied in two steps by the key's hash, the newest version read back."""
    path = folder(i, "snapshot")
    sn.create(old, path, keys, PIECE_ROWS)
    for half in (0, 1):
        sn.rewrite(i.spark, path, changes.where(F.pmod(F.hash(*keys), F.lit(2)) == half), merge)
    return sn.read(i.spark, path)


@query("D1_rewrite_numbers")
def _(i: Inputs):
    old, new = kq.number_changes(i)
    return rewritten(i, old, new, ["e164"], k.upsert_numbers)


@query("D2_rewrite_fleet_keys")
def _(i: Inputs):
    old, new = kq.fleet_changes(i)
    return rewritten(i, old, new, ["sender_key"], k.upsert_fleet_keys)


@query("D3_rewrite_trial_fp")
def _(i: Inputs):
    old, new = kq.trial_changes(i)
    return rewritten(i, old, new, ["fingerprint"], k.upsert_trial_fp)


@query("D4_rewrite_safe_senders")
def _(i: Inputs):
    old, new = kq.safe_sender_changes(i)
    return rewritten(i, old, new, ["account_sub", "sender_pattern"], k.upsert_safe_senders)


@query("D5_rewrite_queue", """
WITH r AS (SELECT DISTINCT message_id, CASE WHEN verdict='block' THEN 'junk' ELSE 'trash' END AS action FROM grades)
SELECT coalesce(r.message_id, o.message_id) AS message_id, coalesce(r.action, o.action) AS action, CASE WHEN r.message_id IS NULL OR o.status = 'ok' THEN o.status ELSE 'pending' END AS status, coalesce(o.attempts, 0) AS attempts
FROM queue o FULL JOIN r ON r.message_id = o.message_id AND r.action = o.action""", "queue grades")
def _(i: Inputs):
    old, new = kq.queue_changes(i)
    return rewritten(i, old, new, ["message_id", "action"], k.upsert_queue)


@query("D6_rewrite_accounts")
def _(i: Inputs):
    old, new = kq.account_changes(i)
    return rewritten(i, old, new, ["account"], lambda o, c: k.insert_if_absent(o, c, ["account"]))


for name, plain in [("D1_rewrite_numbers", "D1_upsert_numbers"), ("D2_rewrite_fleet_keys", "D2_upsert_fleet_keys"), ("D3_rewrite_trial_fp", "D3_upsert_trial_fp"),
                    ("D4_rewrite_safe_senders", "D4_upsert_safe_senders"), ("D6_rewrite_accounts", "D6_insert_if_absent")]:
    ORACLES[name] = ORACLES[plain]

# Two states of the messages: in the newer one some texts changed, some rows are gone and some are new.
OLDER = ["id", "sender", "subject", "body"]
_STATES = """
o AS (SELECT id, sender, subject, body FROM messages),
n AS (SELECT id, sender, CASE WHEN id % 997 = 3 THEN concat(subject, '!') ELSE subject END AS subject, body FROM messages WHERE id % 1009 <> 5
  UNION ALL SELECT id + 70000000000, sender, subject, body FROM messages WHERE id % 1511 = 7)"""


def states(i: Inputs):
    m = i.timeless_messages.select(*OLDER)
    edited = F.when(F.col("id") % 997 == 3, F.concat("subject", F.lit("!"))).otherwise(F.col("subject"))
    newer = m.where("id % 1009 <> 5").withColumn("subject", edited)
    return m, newer.unionByName(m.where("id % 1511 = 7").withColumn("id", F.col("id") + 70_000_000_000))


def _tree_sql() -> str:
    """The tree of ``messages`` level by level."""
    field = "coalesce(concat(CAST(octet_length(encode(CAST({0} AS varchar))) AS varchar), ':', CAST({0} AS varchar)), '-')"
    sums = ", ".join(f"CAST(sum(CAST(concat('0x', substr(h, {1 + 8 * p}, 8)) AS bigint)) AS varchar)" for p in range(8))
    text = (f"WITH r AS (SELECT CAST(id AS bigint) >> {ht.SPAN_BITS} AS node, sha256(concat({', '.join(field.format(c) for c in OLDER)})) AS h FROM messages),\n"
            f"l0 AS (SELECT node, count(*) AS n, sha256(concat_ws('|', CAST(count(*) AS varchar), {sums})) AS digest FROM r GROUP BY node)")
    joined = "sha256(string_agg(concat(coalesce(CAST(node AS varchar), '-'), ':', digest), ',' ORDER BY node NULLS FIRST))"
    for level in range(1, ht.TOP + 1):
        text += f",\nl{level} AS (SELECT node >> {ht.FANOUT_BITS} AS node, CAST(sum(n) AS bigint) AS n, {joined} AS digest FROM l{level - 1} GROUP BY node >> {ht.FANOUT_BITS})"
    return text + f"\nSELECT CAST(sum(n) AS bigint) AS n, {joined} AS root FROM l{ht.TOP}"


@query("A22_hash_tree_root", _tree_sql(), "messages")
def _(i: Inputs):
    return ht.root(ht.hash_tree(i.timeless_messages, "id", OLDER[1:]))


@query("A22_differing_ranges", f"""
WITH {_STATES},
a AS (SELECT id >> {ht.SPAN_BITS} AS node, count(*) AS n_old FROM o GROUP BY 1), b AS (SELECT id >> {ht.SPAN_BITS} AS node, count(*) AS n_new FROM n GROUP BY 1),
d AS (SELECT DISTINCT id >> {ht.SPAN_BITS} AS node FROM ((SELECT * FROM o EXCEPT ALL SELECT * FROM n) UNION ALL (SELECT * FROM n EXCEPT ALL SELECT * FROM o)))
SELECT d.node << {ht.SPAN_BITS} AS lo, (d.node << {ht.SPAN_BITS}) + {(1 << ht.SPAN_BITS) - 1} AS hi, coalesce(n_old, 0) AS n_old, coalesce(n_new, 0) AS n_new
FROM d LEFT JOIN a ON a.node = d.node LEFT JOIN b ON b.node = d.node""", "messages")
def _(i: Inputs):
    old, new = states(i)
    return ht.differing_ranges(*[ht.hash_tree(x, "id", OLDER[1:]) for x in (old, new)])


@query("U5_changed_rows", f"""
WITH {_STATES},
d AS (SELECT id, 'removed' AS change FROM (SELECT * FROM o EXCEPT ALL SELECT * FROM n) UNION ALL SELECT id, 'added' FROM (SELECT * FROM n EXCEPT ALL SELECT * FROM o))
SELECT id, change, count(*) AS copies FROM d GROUP BY id, change""", "messages")
def _(i: Inputs):
    old, new = states(i)
    ranges = ht.differing_ranges(*[ht.hash_tree(x, "id", OLDER[1:]) for x in (old, new)])
    return ht.changed_rows(old, new, "id", OLDER[1:], ranges)
