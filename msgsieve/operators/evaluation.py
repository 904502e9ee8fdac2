"""Evaluation, gates, promotion, drift and novelty bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from msgsieve.operators.quantiles import quantiles

REGRESSION_EPS = 0.01


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def binary_eval(preds: DataFrame, groups: list[str] | None = None, label: str = "label", pred: str = "pred") -> DataFrame:
    """Confusion counts and rates; a missing prediction counts as wrong and invalidates the run."""
    y, p = F.col(label), F.col(pred)
    counts = [
        F.count_if((p == 1) & (y == 1)).alias("tp"), F.count_if((p == 0) & (y == 0)).alias("tn"),
        F.count_if((y == 0) & (p.isNull() | (p == 1))).alias("fp"), F.count_if((y == 1) & (p.isNull() | (p == 0))).alias("fn"),
        F.count_if(p.isNull() & y.isNotNull()).alias("inference_errors")]
    rows = preds.filter(y.isNotNull())
    agg = (rows.groupBy(*groups) if groups else rows).agg(*counts)
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    out = agg.withColumns({
        "n": tp + tn + fp + fn, "accuracy": _ratio(tp + tn, tp + tn + fp + fn), "precision": _ratio(tp, tp + fp),
        "recall": _ratio(tp, tp + fn), "specificity": _ratio(tn, tn + fp), "fpr": _ratio(fp, fp + tn),
        "evaluation_valid": F.col("inference_errors") == 0})
    return out.withColumn("f1", _ratio(F.lit(2.0) * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def eval_by_tag(preds: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """Accuracy per tag; rows without tags count as ``untagged``."""
    tags = F.when(F.size(F.coalesce("tags", F.array().cast("array<string>"))) > 0, F.col("tags")).otherwise(F.array(F.lit("untagged")))
    hit = F.coalesce(F.col(pred) == F.col(label), F.lit(False))
    return (preds.select(F.explode(tags).alias("tag"), hit.alias("hit")).groupBy("tag")
            .agg(F.count("*").alias("n"), F.round(F.avg(F.col("hit").cast("double")), 3).alias("accuracy")))


def tag_recall(by_tag: DataFrame, tag: str = "pump_fake") -> DataFrame:
    """Accuracy of one tag, 1.0 when the tag does not occur."""
    return by_tag.agg(F.coalesce(F.max(F.when(F.col("tag") == tag, F.col("accuracy"))), F.lit(1.0)).alias(f"{tag}_recall"))


def wilson(k: Column, n: Column, z: float = 1.96) -> Column:
    """struct(lo, hi): 95 % score interval; (0, 0) for n = 0."""
    p = k / n
    denom = F.lit(1.0) + F.lit(z * z) / n
    centre = (p + F.lit(z * z) / (n * 2)) / denom
    margin = F.sqrt(p * (F.lit(1.0) - p) / n + F.lit(z * z) / (n * n * 4)) * z / denom
    lo, hi = F.greatest(F.lit(0.0), centre - margin), F.least(F.lit(1.0), centre + margin)
    return F.struct(F.when(n > 0, lo).otherwise(0.0).alias("lo"), F.when(n > 0, hi).otherwise(0.0).alias("hi"))


def with_intervals(metrics: DataFrame) -> DataFrame:
    r, f = wilson(F.col("tp"), F.col("tp") + F.col("fn")), wilson(F.col("fp"), F.col("fp") + F.col("tn"))
    return metrics.withColumns({"recall_lo": F.round(r["lo"], 4), "recall_hi": F.round(r["hi"], 4),
                                "fpr_lo": F.round(f["lo"], 4), "fpr_hi": F.round(f["hi"], 4)})


# channel, min_accuracy, max_fpr, min_recall, min_pump_fake_recall
GATES = [("phishing", 0.90, 0.10, None, 1.0), ("smishing", 0.90, 0.05, 0.90, None), ("vishing", 0.90, 0.05, 0.90, None)]
GATE_SCHEMA = "channel string, min_accuracy double, max_fpr double, min_recall double, min_pump_fake_recall double"


def gate_table(spark) -> DataFrame:
    return spark.createDataFrame(GATES, GATE_SCHEMA)


def release_gate(metrics: DataFrame, gates: DataFrame) -> DataFrame:
    """Point gate, evidence gate on interval bounds and their conjunction, per channel."""
    m = with_intervals(metrics).join(F.broadcast(gates), "channel")
    c = F.col
    pump = c("pump_fake_recall") if "pump_fake_recall" in metrics.columns else F.lit(None).cast("double")
    point = (c("evaluation_valid") & (c("accuracy") >= c("min_accuracy")) & (c("fpr") <= c("max_fpr"))
             & (c("recall") >= F.coalesce("min_recall", F.lit(0.0)))
             & (c("min_pump_fake_recall").isNull() | (F.coalesce(pump, F.lit(0.0)) >= c("min_pump_fake_recall"))))
    evidence = (c("evaluation_valid") & (c("tp") + c("fn") > 0) & (c("tn") + c("fp") > 0)
                & (c("recall_lo") >= F.coalesce("min_recall", F.lit(0.90))) & (c("fpr_hi") <= c("max_fpr")))
    return m.withColumns({"gate_pass": point, "evidence_sufficient": evidence, "release_ready": point & evidence})


def decide_promotion(candidate: DataFrame, champion: DataFrame, primary: str = "recall", eps: float = REGRESSION_EPS, force: bool = False) -> DataFrame:
    """Promote per channel if the gate holds and nothing regresses; ``force`` waives only the comparison.

    ``candidate`` carries ``gate_pass``.
    """
    keep = champion.select("channel", *[F.col(x).alias(f"_{x}") for x in dict.fromkeys([primary, "fpr", "accuracy"])])
    j = candidate.join(keep, "channel", "left")
    c = F.col
    worse = (c(primary) < c(f"_{primary}") - eps) | (c("fpr") > c("_fpr") + REGRESSION_EPS) | (c("accuracy") < c("_accuracy") - REGRESSION_EPS)
    note = F.format_string(f"{primary} %.3f→%.3f, fpr %.3f→%.3f", c(f"_{primary}"), c(primary), c("_fpr"), c("fpr"))
    none = c(f"_{primary}").isNull()
    promoted = c("gate_pass") & (F.lit(force) | none | ~worse)
    reason = (F.when(~c("gate_pass"), "failed gate").when(F.lit(force), "force_promote_after_gate")
              .when(none, "no champion → promote first passing model")
              .when(worse, F.concat(F.lit("regression vs champion ("), note, F.lit(")")))
              .otherwise(F.concat(F.lit("improves/holds ("), note, F.lit(")"))))
    return j.select("channel", F.coalesce(promoted, F.lit(False)).alias("promoted"), reason.alias("reason"))


# --- four-action evaluation --------------------------------------------------
ACTIONS = ["allow", "label", "silence", "block"]
TAXONOMIES = ["legit", "nuisance", "fraud"]


def judge_actions(rows: DataFrame, train_groups: DataFrame) -> DataFrame:
    """Add ``outcome`` per row: ok, or why it cannot be judged.

    ``rows``: (ord, id, group_id, taxonomy, expected, predicted).  The first
    row of an id by ``ord`` stands; later ones are duplicates.
    """
    first = rows.filter(F.length("id") > 0).groupBy("id").agg(F.min("ord").alias("_first"))
    seen = train_groups.select("group_id", F.lit(True).alias("_train")).distinct()
    j = rows.join(first, "id", "left").join(seen, "group_id", "left")
    c = F.col
    outcome = (F.when(c("id").isNull() | (c("id") == ""), "missing_id").when(c("ord") != c("_first"), "duplicate_id")
               .when(c("group_id").isNull() | (c("group_id") == ""), "missing_group_id")
               .when(~F.coalesce(c("taxonomy").isin(TAXONOMIES), F.lit(False)) | ~F.coalesce(c("expected").isin(ACTIONS), F.lit(False)), "invalid_taxonomy_or_expected_action")
               .when(c("_train"), "group_overlap").when(c("predicted").isNull(), "inference_error")
               .when(~c("predicted").isin(ACTIONS), "invalid_prediction").otherwise("ok"))
    return j.withColumn("outcome", outcome).drop("_first", "_train")


SUPPORTED = ["ok", "group_overlap", "inference_error", "invalid_prediction"]


def action_confusion(judged: DataFrame) -> DataFrame:
    """Expected action by predicted action, with an ``invalid`` column."""
    p = F.when(F.col("outcome") == "ok", F.col("predicted")).otherwise("invalid")
    return (judged.filter(F.col("outcome").isin(SUPPORTED)).withColumn("_p", p).groupBy("expected")
            .pivot("_p", [*ACTIONS, "invalid"]).agg(F.count(F.lit(1))).na.fill(0))


def action_scores(judged: DataFrame) -> DataFrame:
    """Support, precision and recall per action."""
    ok = F.col("outcome") == "ok"
    sides = judged.filter(F.col("outcome").isin(SUPPORTED)).select(F.explode(F.array_compact(F.array(
        F.struct(F.col("expected").alias("action"), F.lit("e").alias("side"), (ok & (F.col("expected") == F.col("predicted"))).alias("hit")),
        F.when(ok, F.struct(F.col("predicted").alias("action"), F.lit("p").alias("side"), F.lit(False).alias("hit")))))).alias("s")).select("s.*")
    agg = sides.groupBy("action").agg(F.count_if(F.col("side") == "e").alias("support"), F.count_if(F.col("side") == "p").alias("predicted"),
                                      F.count_if("hit").alias("tp"))
    return agg.withColumns({"precision": _ratio(F.col("tp"), F.col("predicted")), "recall": _ratio(F.col("tp"), F.col("support"))})


def action_summary(judged: DataFrame) -> DataFrame:
    """Accuracy, false-block rates, error counts and validity as one row."""
    o, e, p, t = (F.col(x) for x in ("outcome", "expected", "predicted", "taxonomy"))
    sup, ok = o.isin(SUPPORTED), o == "ok"
    agg = judged.agg(
        F.count("*").alias("input_count"), F.count_if(sup).alias("valid_expected_count"), F.count_if(ok).alias("prediction_count"),
        F.count_if(ok & (p == e)).alias("correct"), F.count_if(ok & (p == "block") & (e != "block")).alias("false_block_count"),
        F.count_if(ok & (p == "block") & (e != "block") & (t == "legit")).alias("legit_false_block_count"),
        F.count_if(sup & (e != "block")).alias("_nonblock"), F.count_if(sup & (t == "legit")).alias("_legit"),
        F.count_if(~o.isin("ok", "inference_error", "invalid_prediction")).alias("record_errors"),
        F.count_if(o == "invalid_prediction").alias("prediction_errors"), F.count_if(o == "inference_error").alias("inference_errors"),
        F.count_if(o == "group_overlap").alias("overlap_rows"))
    out = agg.withColumns({
        "accuracy": _ratio(F.col("correct"), F.col("valid_expected_count")),
        "false_block_rate": _ratio(F.col("false_block_count"), F.col("_nonblock")),
        "legit_false_block_rate": _ratio(F.col("legit_false_block_count"), F.col("_legit")),
        "evaluation_valid": (F.col("input_count") > 0) & (F.col("record_errors") == 0) & (F.col("prediction_errors") == 0) & (F.col("inference_errors") == 0)})
    return out.withColumn("expectations_met", F.col("evaluation_valid") & (F.col("correct") == F.col("input_count"))).drop("_nonblock", "_legit")


def action_failures(judged: DataFrame) -> DataFrame:
    """All rows that could not be judged."""
    return judged.filter(F.col("outcome") != "ok").select("ord", "id", "outcome")


def action_support(judged: DataFrame) -> DataFrame:
    return (judged.filter(F.col("outcome").isin(SUPPORTED)).groupBy("taxonomy", F.col("expected").alias("expected_action")).agg(F.count("*").alias("n")))


# --- drift -------------------------------------------------------------------
EPS = 1e-6


def psi(reference: DataFrame, batch: DataFrame, feature: str = "feature", value: str = "value", bins: int = 10) -> DataFrame:
    """Population stability index per feature of two long tables (feature, value).

    Bin edges are the distinct exact quantiles of the reference; the ends are
    open.  Counting is a map-side combined aggregate on (feature, bin).
    """
    probs = {f"q{k}": k / bins for k in range(bins + 1)}
    q = quantiles(reference, [feature], value, probs)
    edges = F.array_sort(F.array_distinct(F.array(*[F.col(k) for k in probs])))
    cut = q.select(feature, F.when(F.size(edges) > 2, F.slice(edges, 2, F.size(edges) - 2)).otherwise(F.array().cast("array<double>")).alias("inner"))

    def counted(df: DataFrame, name: str) -> DataFrame:
        j = df.select(feature, F.col(value).cast("double").alias("v")).filter(F.col("v").isNotNull()).join(F.broadcast(cut), feature)
        return j.groupBy(feature, F.size(F.filter("inner", lambda e: e <= F.col("v"))).alias("bin")).agg(F.count("*").alias(name))

    both = counted(reference, "e").join(counted(batch, "a"), [feature, "bin"], "full").na.fill(0, ["e", "a"])
    totals = both.groupBy(feature).agg(F.sum("e").alias("te"), F.sum("a").alias("ta"))
    p = both.join(totals, feature)
    e, a = F.greatest(F.col("e") / F.col("te"), F.lit(EPS)), F.greatest(F.col("a") / F.col("ta"), F.lit(EPS))
    return (p.filter((F.col("te") > 0) & (F.col("ta") > 0)).groupBy(feature).agg(F.sum((a - e) * F.log(a / e)).alias("psi")))


def drift_level(score: Column) -> Column:
    return F.when(score >= 0.25, "significant").when(score >= 0.10, "moderate").otherwise("stable")


def long_features(df: DataFrame, columns: list[str]) -> DataFrame:
    """Wide feature columns to (feature, value) rows."""
    return df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "feature", "value")


def drift_report(reference: DataFrame, batch: DataFrame, columns: list[str], confidence: str | None = None, bins: int = 10) -> DataFrame:
    """Greatest and mean index over features, confidence index and level, as one row."""
    cols = columns + ([confidence] if confidence else [])
    per = psi(long_features(reference, cols), long_features(batch, cols), bins=bins)
    is_conf = F.col("feature") == (confidence or "")
    agg = per.agg(F.coalesce(F.max(F.when(~is_conf, F.col("psi"))), F.lit(0.0)).alias("max_feature_psi"),
                  F.coalesce(F.sum(F.when(~is_conf, F.col("psi"))) / len(columns), F.lit(0.0)).alias("mean_feature_psi"),
                  F.coalesce(F.max(F.when(is_conf, F.col("psi"))), F.lit(0.0)).alias("confidence_psi"))
    top = F.greatest("max_feature_psi", "confidence_psi")
    return agg.withColumns({"overall_psi": F.round(top, 4), "level": drift_level(top), "should_retrain": top >= 0.25}).withColumns(
        {c: F.round(c, 4) for c in ("max_feature_psi", "mean_feature_psi", "confidence_psi")})


# --- novelty -----------------------------------------------------------------
def score_quantiles(df: DataFrame, groups: list[str], value: str = "score") -> DataFrame:
    q = quantiles(df, groups, value, {"q01": 0.01, "q05": 0.05, "q25": 0.25, "q50": 0.50})
    ends = df.groupBy(*groups).agg(F.min(value).alias("min"), F.max(value).alias("max"))
    return q.join(ends, groups)


def novelty_bands(scored: DataFrame, bands: DataFrame, groups: list[str], value: str = "score") -> DataFrame:
    """Novelty 0-1 and level from the normal scores' quantiles; lower scores are stranger.

    ``bands`` has one row per channel.
    """
    j = scored.join(F.broadcast(bands), groups, "left")
    s = F.col(value)
    spread = F.greatest(F.col("q50") - F.col("min"), F.lit(1e-6))
    nov = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("q50") - s) / spread))
    level = F.when(s < F.col("q01"), "EXTREME").when(s < F.col("q05"), "CRITICAL").when(s < F.col("q25"), "WARNING").otherwise("NORMAL")
    return j.withColumns({"novelty": F.coalesce(nov, F.lit(0.0)), "level": level}).withColumn("is_anomalous", F.col("level").isin("CRITICAL", "EXTREME"))
