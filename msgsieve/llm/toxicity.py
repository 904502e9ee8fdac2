"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the distinct 28-bit hashes of single words, word pairs and pairs
with one word left out (``gap``), A-Z folded, split at ASCII punctuation and
white space.  Per-coordinate learning rates and an L1 penalty leave weights on
few coordinates; those travel to the executors as two sorted arrays.

The model is fitted on a bounded sample of labelled rows (``per_class`` of
each class, lowest hashes of the id first), in one task of bounded size.  A
logistic curve over the margins makes them probabilities for classes of equal
weight.  Scoring reads every whole text once and shuffles nothing.

Defined cases: null texts count as empty and score by the intercept alone.
Label rows with a null in either column are left out; ids with several labels
count as toxic if one says so.  Without labels of both classes every score is
0, or 1 if all labels are toxic.  Repeated rows are scored alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from msgsieve.llm.common import as_columns, tidy
from msgsieve.llm.words import PUNCTUATION, mix64, text_chunks, word_hashes, word_spans

HASH_BITS = 28
PER_CLASS = 4000


@dataclass(frozen=True)
class ToxicityModel:
    """Hashes with a weight (ascending), their weights, and the intercept."""

    index: np.ndarray
    weight: np.ndarray
    intercept: float


def features(data: np.ndarray, offs: np.ndarray, gap: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of all features of a run of texts, with repeats."""
    start, end, first = word_spans(data, offs, PUNCTUATION)
    words = word_hashes(data, start, end, fold=True)
    owner = np.repeat(np.arange(len(offs) - 1), np.diff(first))
    texts, hashes = [owner], [words]
    for kind, step in ((1, 1), (2, 1 + gap)):
        if len(words) > step:
            same = owner[:-step] == owner[step:]
            texts.append(owner[:-step][same])
            hashes.append(mix64(words[:-step] * np.uint64(0x9FB21C651E98DF25) + words[step:] + np.uint64(kind))[same])
    return np.concatenate(texts), (np.concatenate(hashes) >> np.uint64(64 - HASH_BITS)).astype(np.int64)


def ftrl(rows: list[tuple[np.ndarray, int]], size: int, alpha: float = 1.0, beta: float = 1.0, l1: float = 10.0, l2: float = 0.1,
         epochs: int = 10) -> tuple[np.ndarray, float]:
    """Weights and intercept after ``epochs`` passes over (feature numbers, label) rows."""
    z, n = np.zeros(size), np.zeros(size)
    z0 = n0 = 0.0
    for _ in range(epochs):
        for at, label in rows:
            za, na = z[at], n[at]
            root = np.sqrt(na)
            w = np.where(np.abs(za) <= l1, 0.0, (np.sign(za) * l1 - za) / ((beta + root) / alpha + l2))
            w0 = -z0 / ((beta + n0 ** 0.5) / alpha)
            g = 1.0 / (1.0 + np.exp(-np.clip(w.sum() + w0, -35, 35))) - label
            up = np.sqrt(na + g * g)
            z[at] = za + g - (up - root) / alpha * w
            n[at] = na + g * g
            up0 = (n0 + g * g) ** 0.5
            z0, n0 = z0 + g - (up0 - n0 ** 0.5) / alpha * w0, n0 + g * g
    w = np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2))
    return w, -z0 / ((beta + n0 ** 0.5) / alpha)


def calibrate(margins: np.ndarray, labels: np.ndarray, pull: float = 1.0, soft: float = 1e-3) -> tuple[float, float]:
    """Slope and shift of the logistic curve that fits the labels, both classes weighing the same."""
    slope, shift = 1.0, 0.0
    aim = np.where(labels == 1, 1 - soft, soft)
    weight = np.where(labels == 1, 1.0, (labels == 1).sum() / max(1, (labels == 0).sum()))
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(slope * margins + shift, -35, 35)))
        g, h = weight * (p - aim), weight * np.maximum(p * (1 - p), 1e-9)
        grad = np.array([(g * margins).sum() + pull * (slope - 1), g.sum() + pull * shift])
        curve = np.array([[(h * margins * margins).sum() + pull, (h * margins).sum()], [(h * margins).sum(), h.sum() + pull]])
        step = np.linalg.solve(curve, grad)
        step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
        slope, shift = slope - step[0], shift - step[1]
    return slope, shift


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        labels, order = batch.column("toxic").to_pylist(), batch.column("order").to_pylist()
        for at, end, data, offs in text_chunks(batch):
            owner, hashes = features(data, offs)
            cut = np.searchsorted(np.sort(owner), np.arange(end - at + 1))
            hashes = hashes[np.argsort(owner, kind="stable")]
            found = [np.unique(hashes[a:b]).astype("<u4").tobytes() for a, b in zip(cut[:-1], cut[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(order[at:end], pa.int64()), pa.array(labels[at:end], pa.int32()), pa.array(found, pa.binary())], ["order", "toxic", "features"])


def _fit_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The whole bounded sample in hash order: one model."""
    rows = [(np.frombuffer(f, "<u4"), t) for batch in batches for f, t in zip(batch["features"], batch["toxic"])]
    if not rows:
        return
    index, count = np.unique(np.concatenate([f for f, _ in rows]), return_counts=True)
    index = index[count > 1]  # a feature of one row alone never passes the L1 penalty
    known = []
    for f, t in rows:
        at = np.searchsorted(index, f)
        at[at == len(index)] = 0
        known.append((at[index[at] == f] if len(index) else at[:0], t))
    weight, intercept = ftrl(known, len(index))
    slope, shift = calibrate(np.array([weight[at].sum() for at, _ in known]) + intercept, np.array([t for _, t in known]))
    weight, intercept = slope * weight, slope * intercept + shift
    keep = weight != 0
    yield pd.DataFrame({"index": [index[keep].astype("<i8").tobytes()], "weight": [weight[keep].astype("<f8").tobytes()], "intercept": [intercept]})


def fit_toxicity(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> ToxicityModel:
    """Fit on at most ``per_class`` labelled documents of each class.

    ``labels`` (doc_id, toxic) holds only what may be learnt from.  The sampled
    ids number at most ``2 * per_class``, so they are broadcast to the scan.
    """
    known = as_columns(labels, doc_id="long", toxic="int").dropna().groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    known = known.withColumn("pick", F.xxhash64("doc_id")).withColumn("order", F.xxhash64("doc_id", F.lit(1)))
    share = known.agg(F.sum("toxic"), F.count(F.lit(1))).first()
    ones, total = share[0] or 0, share[1]
    if not ones or ones == total:
        return ToxicityModel(np.zeros(0, np.int64), np.zeros(0), 35.0 if ones else -35.0)
    sample = known.where("toxic = 1").orderBy("pick", "doc_id").limit(per_class).unionByName(known.where("toxic = 0").orderBy("pick", "doc_id").limit(per_class))
    texts = as_columns(docs, doc_id="long", text="string").join(F.broadcast(sample), "doc_id")
    rows = texts.mapInArrow(tidy(_feature_rows), "order long, toxic int, features binary")
    got = rows.repartition(1).sortWithinPartitions("order", "toxic", "features").mapInPandas(tidy(_fit_task), "index binary, weight binary, intercept double").collect()
    if not got:
        return ToxicityModel(np.zeros(0, np.int64), np.zeros(0), -35.0)
    return ToxicityModel(np.frombuffer(got[0]["index"], "<i8"), np.frombuffer(got[0]["weight"], "<f8"), got[0]["intercept"])


def score_toxicity(docs: DataFrame, model: ToxicityModel, carry: list[str] | None = None, name: str = "score") -> DataFrame:
    """``carry`` columns of every row (doc_id by default) and the score, 0 to 1, in column ``name``."""
    carry = carry or ["doc_id"]
    schema = docs.select(*carry).withColumn(name, F.lit(0.0)).schema

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << 20, bool)
        seen[model.index & 0xFFFFF] = True
        for batch in batches:
            for at, end, data, offs in text_chunks(batch):
                margin = np.full(end - at, model.intercept)
                if len(model.index):
                    owner, hashes = features(data, offs)
                    maybe = seen[hashes & 0xFFFFF]
                    owner, hashes = owner[maybe], hashes[maybe]
                    place = np.minimum(np.searchsorted(model.index, hashes), len(model.index) - 1)
                    hit = model.index[place] == hashes
                    pairs = np.unique(owner[hit] * len(model.index) + place[hit])
                    margin += np.bincount(pairs // len(model.index), model.weight[pairs % len(model.index)], end - at)
                columns = [batch.column(batch.schema.get_field_index(c)).slice(at, end - at) for c in carry]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(1 / (1 + np.exp(-np.clip(margin, -35, 35))))], [*carry, name])

    return docs.select(*dict.fromkeys([*carry, "text"])).mapInArrow(tidy(score), schema)


def drop_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, all columns as they are."""
    return score_toxicity(docs, model, docs.columns, "_toxicity").where(F.col("_toxicity") < threshold).drop("_toxicity")


def learnable(doc_id: Column) -> Column:
    """The two thirds of all ids that labels are learnt from."""
    return F.crc32(F.encode(doc_id.cast("string"), "utf-8")) % 3 != 1
