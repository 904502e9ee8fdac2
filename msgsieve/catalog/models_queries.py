"""Model queries: n-gram tables, classifier, novelty, audio, retrain."""

import math
import struct

from pyspark.sql import functions as F

from msgsieve.catalog.registry import Inputs, query
from msgsieve.models import audio, novelty as nv, text_model as tm
from msgsieve.plans.training import batch_retrain
from msgsieve.session import cut_lineage


def labelled(i: Inputs):
    """Texts with a label: toxic flag of the documents that have one."""
    return i.table("labels").join(i.timeless_messages, F.col("doc_id") == F.col("id")).select("id", F.col("body").alias("text"), F.col("toxic").alias("label"), "message_type")


_TOK = "regexp_extract_all(lower(text), '([\\p{L}\\p{N}_]{2,})', 1)"


@query("M1_term_counts", f"""
WITH w AS (SELECT doc_id AS id, {_TOK} AS t FROM documents),
g AS (SELECT id, unnest(list_concat(list_concat(t, list_transform(range(1, greatest(len(t), 1)), lambda i: array_to_string(list_slice(t, i, i + 1), ' '))), list_transform(range(1, greatest(len(t) - 1, 1)), lambda i: array_to_string(list_slice(t, i, i + 2), ' ')))) AS term FROM w)
SELECT id, count(DISTINCT term) AS terms, count(*) AS total FROM g GROUP BY id""")
def _(i: Inputs):
    c = tm.term_counts(i.table("documents").select(F.col("doc_id").alias("id"), "text"), kinds="w")
    return c.groupBy("id").agg(F.count("*").alias("terms"), F.sum("tf").alias("total"))


@query("M1_char_counts", """
WITH p AS (SELECT doc_id AS id, unnest(list_transform(list_filter(regexp_split_to_array(lower(text), '[\\s\\x0B]+'), lambda w: w <> ''), lambda w: concat(' ', w, ' '))) AS p FROM documents),
g AS (SELECT id, unnest(list_concat(list_concat(list_transform(range(1, length(p) - 1), lambda i: substr(p, i, 3)), list_transform(range(1, greatest(length(p) - 2, 1)), lambda i: substr(p, i, 4))), list_transform(range(1, greatest(length(p) - 3, 1)), lambda i: substr(p, i, 5)))) AS term FROM p)
SELECT id, count(DISTINCT term) AS terms, count(*) AS total FROM g GROUP BY id""")
def _(i: Inputs):
    c = tm.term_counts(i.table("documents").select(F.col("doc_id").alias("id"), "text"), kinds="c")
    return c.groupBy("id").agg(F.count("*").alias("terms"), F.sum("tf").alias("total"))


def _vocabulary_sql(source: str) -> str:
    """CTEs up to ``v`` (kind, term, df, rank) and ``c`` (id, kind, term, tf) over ``source`` (id, text)."""
    return f"""d AS ({source}), w AS (SELECT id, {_TOK} AS t FROM d),
p AS (SELECT id, unnest(list_transform(list_filter(regexp_split_to_array(lower(text), '[\\s\\x0B]+'), lambda w: w <> ''), lambda w: concat(' ', w, ' '))) AS p FROM d),
g AS (SELECT id, 'w' AS kind, unnest(list_concat(list_concat(t, list_transform(range(1, greatest(len(t), 1)), lambda i: array_to_string(list_slice(t, i, i + 1), ' '))), list_transform(range(1, greatest(len(t) - 1, 1)), lambda i: array_to_string(list_slice(t, i, i + 2), ' ')))) AS term FROM w
  UNION ALL SELECT id, 'c', unnest(list_concat(list_concat(list_transform(range(1, length(p) - 1), lambda i: substr(p, i, 3)), list_transform(range(1, greatest(length(p) - 2, 1)), lambda i: substr(p, i, 4))), list_transform(range(1, greatest(length(p) - 3, 1)), lambda i: substr(p, i, 5)))) FROM p),
c AS MATERIALIZED (SELECT id, kind, term, count(*) AS tf FROM g GROUP BY id, kind, term),
v AS (SELECT kind, term, df FROM (SELECT kind, term, count(*) AS df, row_number() OVER (PARTITION BY kind ORDER BY sum(tf) DESC, term) AS rank FROM c GROUP BY kind, term)
  WHERE rank <= CASE kind WHEN 'w' THEN {tm.WORD_TERMS} ELSE {tm.CHAR_TERMS} END)"""


@query("M1_vocabulary", f"WITH {_vocabulary_sql('SELECT doc_id AS id, text FROM documents')} SELECT kind, term, round(ln((1 + (SELECT count(*) FROM d))::DOUBLE / (df + 1)) + 1, 6) AS idf FROM v")
def _(i: Inputs):
    d = i.table("documents").select(F.col("doc_id").alias("id"), "text")
    return tm.vocabulary_of(d, d.count()).select("kind", "term", F.round("idf", 6).alias("idf"))


@query("M2_feature_matrix", f"""WITH {_vocabulary_sql('SELECT id, body AS text, toxic AS label FROM labels JOIN messages ON doc_id = id')}, k AS (SELECT id, count(*) AS cells FROM c JOIN v USING (kind, term) GROUP BY id)
SELECT d.id, label, coalesce(cells, 0) + CASE WHEN length(text) > 0 THEN 1 ELSE 0 END AS cells FROM d LEFT JOIN k ON k.id = d.id""", "messages")
def _(i: Inputs):
    d = labelled(i)
    from pyspark.ml.functions import vector_to_array
    m = tm.encoded(d.withColumn("n", F.length("text")), cut_lineage(tm.vocabulary_of(d, d.count())), ["n"])
    return m.select("id", "label", F.size(F.filter(vector_to_array("features"), lambda v: v != 0)).alias("cells"))


@query("M3_train_and_score")
def _(i: Inputs):
    d = labelled(i)
    model = tm.train_classifier(d)
    return tm.score_messages(model, d).select("id", "label", "pred", F.round("conf", 4).alias("conf"))


@query("T3_top_terms")
def _(i: Inputs):
    d = labelled(i)
    return tm.top_terms(tm.train_classifier(d), d, 5).select("id", "feature", "weight", "contribution")


@query("T4_weight_deltas", """
WITH b AS (SELECT source AS term, avg(n_chars) / 1000 AS w FROM documents WHERE lang = 'en' GROUP BY 1), a AS (SELECT source AS term, avg(n_chars) / 1000 AS w FROM documents WHERE lang <> 'en' GROUP BY 1)
SELECT a.term AS feature, round(b.w, 5) AS before, round(a.w, 5) AS after, round(a.w - b.w, 5) AS delta FROM a JOIN b ON b.term = a.term WHERE abs(a.w - b.w) > 1e-12 ORDER BY abs(a.w - b.w) DESC, a.term LIMIT 10""")
def _(i: Inputs):
    d = i.table("documents")

    def weights(cond):
        return d.filter(cond).groupBy(F.col("source").alias("term")).agg((F.avg("n_chars") / 1000).alias("weight"))
    return tm.weight_deltas(weights("lang = 'en'"), weights("lang <> 'en'"))


@query("M11_incremental_update")
def _(i: Inputs):
    d = labelled(i)
    model = tm.train_classifier(d)
    after = tm.incremental_update(model, d)
    return tm.weight_deltas(model.terms.filter("kind = 'w'"), after.terms.filter("kind = 'w'"))


@query("M8_batch_retrain")
def _(i: Inputs):
    d = labelled(i)
    golden = i.table("benchmark").select(F.col("item_id").alias("id"), "text", (F.col("item_id") % 2).cast("int").alias("label"))
    _, row = batch_retrain("smishing", d.select("id", "text", "label"), golden, dry_run=True)
    return row.select("channel", "version", "n_train", "data_hash", "gate_pass", "promoted", "reason")


def _vectors(i: Inputs):
    return i.table("embeddings").select(F.when(F.col("label") < 5, "phishing").otherwise("smishing").alias("channel"), F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


@query("M6_fit_novelty")
def _(i: Inputs):
    t = nv.fit_novelty(_vectors(i))
    return t.groupBy("channel").agg(F.count_distinct("tree").alias("trees"), F.count("*").alias("nodes"))


@query("M7_score_novelty")
def _(i: Inputs):
    v = _vectors(i)
    return nv.novelty(v, v).select("channel", "id", F.round("score", 6).alias("score"), F.round("novelty", 6).alias("novelty"), "level")


def wav_rows(i: Inputs):
    """Each vector becomes a short 8 kHz recording: its 64 numbers are the strengths of 64 tones' samples."""
    head = b"RIFF" + struct.pack("<I", 36 + 2 * 2048) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 16000, 2, 16) + b"data" + struct.pack("<I", 2 * 2048)
    sample = F.transform(F.sequence(F.lit(0), F.lit(2047)), lambda k: F.least(F.greatest((F.element_at("embedding", (F.pmod(k, F.lit(64)) + 1).cast("int")) * F.sin(k * F.lit(2 * math.pi / 37)) * 30000).cast("int"), F.lit(-32768)), F.lit(32767)))
    little = F.array_join(F.transform(sample, lambda s: F.concat(F.lpad(F.hex(F.pmod(s, F.lit(256))), 2, "0"), F.lpad(F.hex(F.pmod(F.floor(s / 256), F.lit(256))), 2, "0"))), "")
    return i.table("embeddings").select(F.col("vec_id").cast("string").alias("path"), F.concat(F.lit(head), F.unhex(little)).alias("content"), (F.col("label") >= 5).cast("int").alias("label"))


@query("M9_audio_features")
def _(i: Inputs):
    f = audio.audio_features(wav_rows(i))
    return audio.voice_risk(f).select("path", "error", "ok", "risk", F.round("centroid", 3).alias("centroid"), F.array_join("codes", ",").alias("codes"))


@query("M9_voice_risk", """
WITH f AS (SELECT event_id, (event_id % 100)::DOUBLE / 100 AS flatness, (event_id % 97)::DOUBLE / 97 AS silence, (event_id % 51)::DOUBLE / 100 AS hi, (event_id % 41)::DOUBLE / 100 AS lo, (event_id % 11)::DOUBLE / 100 AS clip FROM events),
h AS (SELECT *, least(0.85, 0.15 + CASE WHEN flatness > 0.45 AND silence < 0.35 THEN 0.25 ELSE 0 END + CASE WHEN hi > 0.22 AND lo < 0.25 THEN 0.2 ELSE 0 END + CASE WHEN silence > 0.85 THEN 0.15 ELSE 0 END + CASE WHEN clip > 0.05 THEN 0.1 ELSE 0 END) AS heur FROM f)
SELECT event_id, round(least(0.92, heur), 6)::DOUBLE AS risk, concat_ws(',', CASE WHEN round(heur, 6) >= 0.55 THEN 'SYNTHETIC_VOICE_SUSPECTED' END, CASE WHEN silence > 0.85 THEN 'VOICE_SILENCE_PAD' END, CASE WHEN flatness > 0.5 THEN 'VOICE_FLAT_SPECTRUM' END) AS codes FROM h""")
def _(i: Inputs):
    k = F.col("event_id")

    def part(n, d):
        return (k % n).cast("double") / d
    f = i.table("events").select(k, part(100, 100).alias("flatness"), part(97, 97).alias("silence"), part(51, 100).alias("hi_ratio"), part(41, 100).alias("lo_ratio"), part(11, 100).alias("clip"))
    return audio.voice_risk(f).select("event_id", "risk", F.array_join("codes", ",").alias("codes"))


@query("M10_train_voice_model")
def _(i: Inputs):
    rows = wav_rows(i)
    f = audio.audio_features(rows).join(rows.select("path", "label"), "path").persist()
    model, area = audio.train_voice_model(f, auc_floor=0.0)
    return model.transform(f).groupBy("label", F.col("prediction").cast("int").alias("pred")).agg(F.count("*").alias("n")).withColumn("auc", F.lit(round(area, 4)))
