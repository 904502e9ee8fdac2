"""Approximate nearest neighbours: inverted lists over trained centroids, product codes, exact re-ranking.

* Centroids and code books are fitted on a sample of at most ``SAMPLE`` rows
  (least hash first), whatever the size of the corpus; every row is indexed.
* A row is its list (nearest centroid), one byte per ``WIDTH`` dimensions of its
  residual, and the squared length of what the bytes leave out.
* How many lists a query visits is measured, not guessed: the exact neighbours
  of ``PILOTS`` corpus rows, without themselves, are found by brute force over the whole corpus, and
  as many lists are visited as hold the wanted share of these neighbours.
* Lists are dealt to shards of bounded size on both sides; a list longer than
  a shard is cut.  Only codes travel to the shards.  A shard returns its best
  candidates per query by estimated distance; the best of these meet their
  vectors in one join and are ranked by exact distance.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from msgsieve.operators.ordered import top_per_key
from msgsieve.session import cut_lineage

SAMPLE = 1 << 16
SAMPLE_PARTS = 16
PILOTS = 128
WIDTH = 2
CODES = 256
SHARD_ROWS = 1 << 16
QUERY_ROWS = 1 << 12


@dataclass(frozen=True)
class VectorIndex:
    centres: np.ndarray          # list, dimension
    books: np.ndarray            # part, code, dimension inside the part
    rows: np.ndarray             # rows of each list
    probes: int
    codes: DataFrame             # vec_id, scope columns, list, code, rest
    corpus: DataFrame
    same: tuple[str, ...]


def _matrix(col: pd.Series, dims: int = 0) -> np.ndarray:
    x = np.stack(col.to_numpy()).astype("float32")
    return np.pad(x, ((0, 0), (0, dims - x.shape[1]))) if dims > x.shape[1] else x


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared L2 distances of all rows of ``a`` to all rows of ``b``."""
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0)


def lloyd(x: np.ndarray, count: int, rounds: int = 8) -> np.ndarray:
    """Centres of at most ``count`` clusters of the rows of ``x``."""
    centres = np.unique(x, axis=0)
    centres = centres[np.random.default_rng(7).permutation(len(centres))[:count]]
    for _ in range(rounds):
        near = np.concatenate([_squares(x[i:i + 8192], centres).argmin(1) for i in range(0, len(x), 8192)])
        sizes = np.bincount(near, minlength=len(centres))
        sums = np.stack([np.bincount(near, x[:, d], len(centres)) for d in range(x.shape[1])], 1)
        centres = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centres).astype("float32")
    return centres


def encode(x: np.ndarray, centres: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(list, codes, squared length of what is left) of each row."""
    lists = _squares(x, centres).argmin(1)
    left = (x - centres[lists]).reshape(len(x), len(books), -1)
    codes = np.stack([_squares(left[:, p], books[p]).argmin(1) for p in range(len(books))], 1).astype(np.uint8)
    left = left - np.stack([books[p][codes[:, p]] for p in range(len(books))], 1)
    return lists.astype("int32"), codes, (left * left).sum((1, 2))


def decode(lists: np.ndarray, codes: np.ndarray, centres: np.ndarray, books: np.ndarray) -> np.ndarray:
    return centres[lists] + np.concatenate([books[p][codes[:, p]] for p in range(len(books))], 1)


def _centres(sample: DataFrame, lists: int) -> np.ndarray:
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector
    distinct = sample.select("vec").distinct().limit(lists + 1).collect()
    if len(distinct) <= lists:
        return np.array([r["vec"] for r in distinct], dtype="float32")
    rows = sample.select(array_to_vector(F.col("vec").cast("array<double>")).alias("features"))
    return np.array(KMeans(k=lists, seed=7, maxIter=10).fit(rows).clusterCenters(), dtype="float32")


def _books(sample: DataFrame, centres: np.ndarray) -> np.ndarray:
    """One code book per part of the residuals, each fitted in a task of its own."""
    dims = centres.shape[1]
    parts = dims // WIDTH

    def cut(batches):
        for pdf in batches:
            x = _matrix(pdf["vec"], dims)
            left = (x - centres[_squares(x, centres).argmin(1)]).reshape(len(x), parts, WIDTH)
            yield pd.DataFrame({"part": np.tile(np.arange(parts), len(x)), "piece": list(left.reshape(-1, WIDTH))})

    def fit(key, pdf: pd.DataFrame) -> pd.DataFrame:
        book = lloyd(_matrix(pdf["piece"]), CODES)
        return pd.DataFrame({"part": key[0], "code": np.arange(len(book)), "piece": list(book)})

    pieces = sample.select("vec").mapInPandas(cut, "part int, piece array<float>").repartition(parts, "part")  # not joined to one task, however small
    fitted = pieces.groupBy("part").applyInPandas(fit, "part int, code int, piece array<float>")
    books = np.zeros((parts, CODES, WIDTH), "float32")
    for r in fitted.collect():  # CODES rows a part
        books[r["part"], r["code"]] = r["piece"]
    return books


def _nearest_of(corpus: DataFrame, pilots: pd.DataFrame, k: int, same: list[str], id_type: str) -> DataFrame:
    """The exact ``k`` neighbours of the pilots, themselves left out: each task compares its rows with all pilots and returns ``k`` rows for each."""
    asked = _matrix(pilots["vec"])
    own = pilots["vec_id"].to_numpy()
    scopes = [tuple(r) for r in pilots[same].itertuples(index=False)] if same else [()] * len(pilots)

    def scan(batches):
        best: list[list] = [[] for _ in scopes]
        for pdf in batches:
            if not len(pdf):
                continue
            x, ids = _matrix(pdf["vec"]), pdf["vec_id"].to_numpy()
            d = np.where(own[:, None] == ids[None, :], np.inf, _squares(asked, x))
            if same:
                scope = np.array([hash(tuple(r)) for r in pdf[same].itertuples(index=False)])
                d[np.array([hash(s) for s in scopes])[:, None] != scope[None, :]] = np.inf
            for i, near in enumerate(np.argsort(d, axis=1)[:, :k]):
                best[i] = sorted(best[i] + [(float(d[i, j]), ids[j]) for j in near if d[i, j] < np.inf])[:k]
        rows = [(i, x, y) for i, found in enumerate(best) for x, y in found]
        yield pd.DataFrame(rows, columns=["pilot", "d", "vec_id"])

    near = corpus.select("vec_id", "vec", *same).mapInPandas(scan, f"pilot int, d double, vec_id {id_type}")
    return top_per_key(near, ["pilot"], [F.asc("d"), F.asc("vec_id")], k)


def build_index(corpus: DataFrame, k: int = 5, share: float = 0.98, lists: int | None = None, same: list[str] | None = None) -> VectorIndex | None:
    """Index of ``corpus`` (vec_id, vec, scope columns ``same``); ``share`` of the pilots' ``k`` neighbours must lie in visited lists."""
    same = same or []
    n = corpus.count()
    if not n:
        return None
    id_type = corpus.schema["vec_id"].dataType.simpleString()
    ranked = corpus.select("vec_id", "vec", *same).orderBy(F.xxhash64("vec_id", F.lit(1)), "vec_id")
    sample = cut_lineage(ranked.limit(SAMPLE).repartition(SAMPLE_PARTS))  # a limit alone leaves one partition, and training to one task
    lists = max(2, lists or min(int(2 * n ** 0.5), SAMPLE // 32, n // 8))
    centres = _centres(sample, lists)
    dims = -(-centres.shape[1] // WIDTH) * WIDTH
    centres = np.pad(centres, ((0, 0), (0, dims - centres.shape[1])))
    books = _books(sample, centres)
    scope_ddl = "".join(f", `{c}` {corpus.schema[c].dataType.simpleString()}" for c in same)

    def code(batches):
        for pdf in batches:
            if len(pdf):
                found, codes, rest = encode(_matrix(pdf["vec"], dims), centres, books)
                yield pdf.drop(columns="vec").assign(list=found, code=[c.tobytes() for c in codes], rest=rest.astype("float32"))

    codes = cut_lineage(corpus.select("vec_id", *same, "vec").mapInPandas(code, f"vec_id {id_type}{scope_ddl}, list int, code binary, rest float"))
    rows = np.zeros(len(centres), np.int64)
    for r in codes.groupBy("list").count().collect():  # at most SAMPLE / 32 rows
        rows[r["list"]] = r["count"]
    pilots = corpus.select("vec_id", "vec", *same).orderBy(F.xxhash64("vec_id", F.lit(2)), "vec_id").limit(PILOTS).toPandas()
    near = _nearest_of(corpus, pilots, k, same, id_type).join(codes.select("vec_id", "list"), "vec_id").select("pilot", "list").collect()  # PILOTS * k rows
    order = _squares(_matrix(pilots["vec"], dims), centres).argsort(1).argsort(1)
    ranks = np.sort([order[r["pilot"], r["list"]] for r in near])
    probes = int(ranks[max(0, int(np.ceil(share * len(ranks))) - 1)]) + 1 if len(ranks) else len(centres)
    return VectorIndex(centres, books, rows, probes, codes, corpus, tuple(same))


def _shards(rows: np.ndarray, centres: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """(first shard, number of shards) of each list: neighbouring lists share a shard, long lists have several."""
    first, count = np.zeros(len(rows), np.int32), np.maximum(1, -(-rows // room)).astype(np.int32)
    spread = centres - centres.mean(0)
    axis = np.linalg.svd(spread, full_matrices=False)[2][0]
    shard, held = 0, 0
    for i in np.argsort(spread @ axis):
        if held and (count[i] > 1 or held + rows[i] > room):
            shard, held = shard + 1, 0
        first[i] = shard
        if count[i] > 1:
            shard += int(count[i])
        else:
            held += int(rows[i])
    return first, count


def search(index: VectorIndex | None, queries: DataFrame, k: int, rerank: int = 4, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, scope columns, match_id, distance, rank, codes_compared, exact_compared: about the ``k`` nearest rows of the index.

    ``rerank`` times ``k`` candidates of each query are compared exactly; the
    last two columns say how many codes and vectors the query met.
    """
    if index is None:
        return queries.select(F.col("vec_id").alias("query_id"), F.lit(None).cast("long").alias("match_id"), F.lit(0.0).alias("distance"), F.lit(0).alias("rank"),
                              F.lit(0).cast("long").alias("codes_compared"), F.lit(0).cast("long").alias("exact_compared")).limit(0)
    same, centres, books, rows, probes = list(index.same), index.centres, index.books, index.rows, index.probes
    dims, keep = centres.shape[1], k * rerank
    id_type = index.corpus.schema["vec_id"].dataType.simpleString()
    scope_ddl = "".join(f"`{c}` {index.corpus.schema[c].dataType.simpleString()}, " for c in same)
    first, count = _shards(rows, centres, shard_rows)

    def visit(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            near = np.argsort(_squares(_matrix(pdf["vec"], dims), centres), axis=1)[:, :probes]
            shards = [np.unique(np.concatenate([np.arange(first[i], first[i] + count[i]) for i in lists])) for lists in near]
            out = pdf.iloc[np.repeat(np.arange(len(pdf)), [len(s) for s in shards])].rename(columns={"vec_id": "query_id"})
            yield out.assign(shard=np.concatenate(shards), codes_compared=np.repeat(rows[near].sum(1), [len(s) for s in shards]))

    visits = queries.select(*same, "vec_id", "vec").mapInPandas(visit, f"{scope_ddl}query_id {id_type}, vec array<float>, shard int, codes_compared long")
    table = index.codes.sparkSession.createDataFrame(pd.DataFrame({"list": np.arange(len(first), dtype="int32"), "first": first, "count": count}))
    placed = index.codes.join(F.broadcast(table), "list")  # SAMPLE / 32 rows at most
    placed = placed.withColumn("shard", (F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("count"))).cast("int")).drop("first", "count")
    load = visits.groupBy(*same, "shard").agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("slices"))
    left = visits.join(load, [*same, "shard"]).withColumn("slice", F.pmod(F.xxhash64("query_id"), F.col("slices")).cast("int")).drop("slices")
    right = placed.join(load, [*same, "shard"]).withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).drop("slices")

    def estimate(key, q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        names = [*same, "query_id", "match_id", "estimate", "codes_compared"]
        if not len(q) or not len(c):
            return pd.DataFrame(columns=names)
        lists = c["list"].to_numpy()
        x = decode(lists, np.frombuffer(b"".join(c["code"]), np.uint8).reshape(len(c), -1), centres, books)
        ids, rest, out = c["vec_id"].to_numpy(), c["rest"].to_numpy(), []
        step = max(1, 4_000_000 // len(c))
        for at in range(0, len(q), step):
            part = q.iloc[at:at + step]
            asked = _matrix(part["vec"], dims)
            d = _squares(asked, x) + rest[None, :]
            seen = np.zeros((len(part), len(centres)), bool)
            np.put_along_axis(seen, np.argsort(_squares(asked, centres), axis=1)[:, :probes], True, axis=1)
            d[~seen[:, lists]] = np.inf
            best = np.argpartition(d, min(keep, len(c)) - 1, axis=1)[:, :keep]
            row, found = np.repeat(np.arange(len(part)), best.shape[1]), best.ravel()
            good = d[row, found] < np.inf
            row, found = row[good], found[good]
            out.append(pd.DataFrame({**{f: part[f].to_numpy()[row] for f in same}, "query_id": part["query_id"].to_numpy()[row], "match_id": ids[found],
                                     "estimate": d[row, found], "codes_compared": part["codes_compared"].to_numpy()[row]})[names])
        return pd.concat(out)

    key = [*same, "shard", "slice"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(estimate, f"{scope_ddl}query_id {id_type}, match_id {id_type}, estimate double, codes_compared long")
    candidates = top_per_key(found, [*same, "query_id"], [F.asc("estimate"), F.asc("match_id")], keep).drop("rank", "estimate")
    pairs = (candidates.join(index.corpus.select(*same, F.col("vec_id").alias("match_id"), F.col("vec").alias("match_vec")), [*same, "match_id"])
             .join(queries.select(*same, F.col("vec_id").alias("query_id"), "vec"), [*same, "query_id"]))

    def measure(batches):
        for pdf in batches:
            if len(pdf):
                gap = np.stack(pdf["vec"].to_numpy()).astype("float64") - np.stack(pdf["match_vec"].to_numpy()).astype("float64")
                yield pdf.drop(columns=["vec", "match_vec"]).assign(distance=np.sqrt((gap * gap).sum(1)))

    exact = pairs.select(*same, "query_id", "match_id", "codes_compared", "vec", "match_vec").mapInPandas(
        measure, f"{scope_ddl}query_id {id_type}, match_id {id_type}, codes_compared long, distance double")
    sizes = candidates.groupBy(*same, "query_id").agg(F.count("*").alias("exact_compared"))
    return top_per_key(exact, [*same, "query_id"], [F.asc("distance"), F.asc("match_id")], k).join(sizes, [*same, "query_id"])


def recall(found: DataFrame, exact: DataFrame, corpus_rows: int) -> DataFrame:
    """One row: queries, wanted, found, recall, and the mean shares of the corpus whose codes and vectors a query met."""
    hits = exact.select("query_id", "match_id").join(found.select("query_id", "match_id", F.lit(1).alias("hit")), ["query_id", "match_id"], "left")
    total = hits.agg(F.count_distinct("query_id").alias("queries"), F.count("*").alias("wanted"), F.count("hit").alias("found"))
    cost = found.groupBy("query_id").agg(F.max("codes_compared").alias("c"), F.max("exact_compared").alias("e")).agg(F.avg("c").alias("c"), F.avg("e").alias("e"))
    return total.crossJoin(cost).select("queries", "wanted", "found", F.round(F.col("found") / F.col("wanted"), 4).alias("recall"),
                                        F.round(F.col("c") / corpus_rows, 4).alias("codes_share"), F.round(F.col("e") / corpus_rows, 4).alias("exact_share"))
