"""Approximate neighbours against brute force: recall, scopes, bounded shards, odd inputs."""
import numpy as np
import pytest

from msgsieve.operators import lookups as lk, vector_index as vi


def table(spark, x, scope=None):
    rows = [(int(i), [float(v) for v in r], int(scope[i]) if scope is not None else 0) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "vec_id long, vec array<float>, label int").repartition(4)


def brute(x, q, k):
    d = ((q[:, None] - x[None]) ** 2).sum(-1)
    return [set(r) for r in np.argsort(d, axis=1, kind="stable")[:, :k]]


def clusters(n, dims, groups, seed=3):
    r = np.random.default_rng(seed)
    return r.normal(size=(groups, dims))[r.integers(0, groups, n)] + 0.1 * r.normal(size=(n, dims))


@pytest.mark.parametrize("dims, groups", [(16, 40), (7, 1)])
def test_recall_and_work(spark, dims, groups):
    """Clustered data: few codes are compared.  Without clusters more lists are visited, and recall holds."""
    x = clusters(3000, dims, groups).astype("float32")
    v = table(spark, x).drop("label")
    index = vi.build_index(v, 5)
    assert index.rows.sum() == 3000
    asked = v.where("vec_id % 20 = 0")
    got = vi.search(index, asked, 5).collect()
    truth = brute(x.astype("float64"), x[::20].astype("float64"), 5)
    hits = sum(r["match_id"] in truth[r["query_id"] // 20] for r in got)
    assert len(got) == 150 * 5 and hits / len(got) >= 0.95
    assert {r["rank"] for r in got} == {1, 2, 3, 4, 5} and all(r["exact_compared"] <= 20 for r in got)
    assert all(abs(r["distance"] - np.linalg.norm(x[r["query_id"]].astype("float64") - x[r["match_id"]])) < 1e-9 for r in got)
    if groups > 1:
        assert np.mean([r["codes_compared"] for r in got]) < 0.2 * 3000


def test_small_shards_change_nothing(spark):
    """A list of a third of all rows is cut into shards; every row is still met."""
    x = clusters(1200, 8, 12, 5).astype("float32")
    x[:400] = x[0] + 0.02 * np.random.default_rng(1).normal(size=(400, 8))
    v = table(spark, x).drop("label")
    index = vi.build_index(v, 4, lists=12)
    a, b = (sorted((r["query_id"], r["match_id"]) for r in vi.search(index, v, 4, shard_rows=room).collect()) for room in (1 << 16, 100))
    first, count = vi._shards(index.rows, index.centres, 100)
    assert count.max() >= 2 and len(a) == 4800
    assert len(set(a) & set(b)) >= 0.99 * len(a)


def test_scopes_are_kept_apart(spark):
    x = clusters(600, 8, 6, 9).astype("float32")
    scope = np.arange(600) % 3
    got = lk.similar_messages_ann(table(spark, x, scope), table(spark, x, scope), 3, same=["label"]).collect()
    assert len(got) == 1800 and all(r["query_id"] % 3 == r["match_id"] % 3 == r["label"] for r in got)
    assert sum(r["query_id"] == r["match_id"] for r in got) == 600


def test_few_equal_and_no_rows(spark):
    same = table(spark, np.ones((40, 5))).drop("label")
    got = lk.similar_messages_ann(same, same, 3).collect()
    assert len(got) == 120 and {r["distance"] for r in got} == {0.0}
    one = same.where("vec_id = 7")
    assert [(r["query_id"], r["match_id"]) for r in lk.similar_messages_ann(one, one, 3).collect()] == [(7, 7)]
    assert lk.similar_messages_ann(same, same.where("false"), 3).collect() == []
    assert lk.similar_messages_ann(same.where("false"), same, 3).collect() == []


def test_codes_come_near_their_vectors():
    r = np.random.default_rng(2)
    x = r.normal(size=(4000, 6)).astype("float32")
    centres = vi.lloyd(x, 16)
    left = (x - centres[vi._squares(x, centres).argmin(1)]).reshape(len(x), 3, 2)
    books = np.stack([vi.lloyd(left[:, p], vi.CODES) for p in range(3)])
    lists, codes, rest = vi.encode(x, centres, books)
    back = vi.decode(lists, codes, centres, books)
    assert np.allclose(((x - back) ** 2).sum(1), rest, atol=1e-3) and rest.mean() < 0.05 * (x * x).sum(1).mean()


def test_recall_row(spark):
    v = table(spark, clusters(400, 8, 8)).drop("label")
    row = vi.recall(lk.similar_messages_ann(v, v, 5), lk.similar_messages(v, v, 5), 400).first()
    assert (row["queries"], row["wanted"]) == (400, 2000) and row["recall"] >= 0.95 and row["exact_share"] <= 0.05


def test_queries_are_every_twentieth_row(spark, tmp_path):
    """The registered searches ask for the ids divisible by 20, against all rows; their work grows with that set."""
    from msgsieve import catalog
    from msgsieve.catalog.registry import QUERIES, Inputs
    catalog.load()
    x = clusters(400, 8, 10)
    table(spark, x, np.arange(400) % 4).withColumnRenamed("vec", "embedding").write.parquet(f"{tmp_path}/embeddings.parquet")
    i = Inputs(spark, str(tmp_path))
    got = QUERIES["J15_similar_approximate"](i).collect()
    truth = brute(x.astype("float32").astype("float64"), x[::20].astype("float32").astype("float64"), 5)
    assert {r["query_id"] for r in got} == set(range(0, 400, 20)) and len(got) == 100
    assert sum(r["match_id"] in truth[r["query_id"] // 20] for r in got) >= 90
    scoped = QUERIES["J15_approximate_within_type"](i).collect()
    assert {r["query_id"] for r in scoped} == set(range(0, 400, 20)) and all(r["match_id"] % 4 == r["label"] == 0 for r in scoped)
    assert QUERIES["J15_recall"](i).first()["recall"] >= 0.9
