"""Look-alikes whose tables stay off the driver, and neighbours measured a block at a time."""
import numpy as np

from msgsieve.operators import lookups as lk


def test_lookalike_tables_are_not_broadcast(spark):
    senders = spark.createDataFrame([(1, "x@gonzo.example"), (2, "x@gonzos.example"), (3, "x@gonzo.com"), (4, "x@other.example")], "id long, sender string")
    names = spark.createDataFrame([("gonzo", 1)], "name string, rank int")
    real = spark.createDataFrame([("gonzo.com",)], "domain string")
    out = lk.lookalike_names(senders, names, real)
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.id, r.name) for r in out.collect()) == [(1, "gonzo"), (2, "gonzo")]


def test_least_equals_a_full_sort():
    rng = np.random.default_rng(5)
    b = np.repeat(rng.normal(size=(40, 6)), 5, axis=0)
    b += 1000 * (np.arange(200) % 3 == 0)[:, None]
    a, ids = np.concatenate([b[:30], rng.normal(size=(20, 6))]), rng.permutation(200)
    for k in (1, 4, 200):
        row, col, d = lk._least(a, b, ids, k)
        full = np.sqrt(((a[:, None, :] - b[None, :, :]) ** 2).sum(-1))
        want = np.lexsort((np.broadcast_to(ids, full.shape), full), axis=1)[:, :k].ravel()
        assert (col == want).all() and (row == np.repeat(np.arange(len(a)), k)).all() and (d == full[row, want]).all()
