"""Keyed writes as snapshot jobs: new snapshot = f(old snapshot, changes).

No row-level table format is assumed.  Every job applied twice with the same
changes gives the same snapshot as applied once, unless it counts attempts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from msgsieve.functions.text import redact_sender, text_or_empty
from msgsieve.operators.filters import TRUSTED_DB_SOURCES, json_field, require_tenant, trusted_labels, valid_tenant


def grade_label(verdict: Column) -> Column:
    """block -> 1, safe -> 0, anything else -> null."""
    return F.when(verdict == "block", 1).when(verdict == "safe", 0)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Last write per key wins; ``seq`` orders the changes."""
    cols = [c for c in old.columns if c not in keys]
    both = (old.withColumn(seq, F.lit(None).cast(new.schema[seq].dataType)) if seq not in old.columns else old).unionByName(new)
    order = F.coalesce(F.col(seq).cast("double"), F.lit(float("-inf")))
    return both.groupBy(*keys).agg(F.max_by(F.struct(*cols), order).alias("_v")).select(*keys, "_v.*")


def upsert_numbers(old: DataFrame, new: DataFrame) -> DataFrame:
    return upsert(old, new, ["e164"], "seq")


def upsert_fleet_keys(old: DataFrame, new: DataFrame) -> DataFrame:
    """Confidence never rises on update; the report count is replaced."""
    n = new.select("sender_key", F.col("confidence").alias("_c"), F.col("report_count").alias("_n"))
    return old.join(n, "sender_key", "full").select(
        "sender_key", F.least("confidence", "_c").alias("confidence"), F.coalesce("_n", "report_count").alias("report_count"))


def upsert_trial_fp(old: DataFrame, attempts: DataFrame) -> DataFrame:
    """Count attempts, keep the greatest risk and the last address."""
    new = attempts.groupBy("fingerprint").agg(F.count("*").alias("_n"), F.max("risk_score").alias("_r"), F.max_by("ip", "signup_id").alias("_ip"))
    return old.join(new, "fingerprint", "full").select(
        "fingerprint", (F.coalesce("attempts", F.lit(0)) + F.coalesce("_n", F.lit(0))).alias("attempts"),
        F.greatest("risk_score", "_r").alias("risk_score"), F.coalesce("_ip", "last_ip").alias("last_ip"))


def safe_sender_rows(df: DataFrame, auto_learned: bool) -> DataFrame:
    """Normal form of allow-list entries: pattern, domain and match type; unusable ones dropped."""
    p = F.lower(F.trim(text_or_empty(F.col("sender"))))
    domain = F.element_at(F.split(p, "@"), -1)
    return (df.withColumns({"sender_pattern": p, "domain": domain,
                            "match_type": F.when(p.contains("%"), "pattern").when(p.contains("@"), "exact").otherwise("domain"),
                            "auto_learned": F.lit(auto_learned)})
            .filter((p != "") & (F.length(p) <= 255) & (domain != "")).drop("sender"))


def upsert_safe_senders(old: DataFrame, new: DataFrame) -> DataFrame:
    return upsert(old, new, ["account_sub", "sender_pattern"], "seq")


def learn_safe_senders(grades: DataFrame, messages: DataFrame) -> DataFrame:
    """Allow-list rows learned from safe grades, one per (tenant, sender)."""
    safe = (grades.filter(grade_label(F.col("verdict")) == 0).select(F.col("message_id").alias("id"), "account_sub")
            .join(messages.select("id", "account_sub", "sender"), ["id", "account_sub"]))
    return safe_sender_rows(safe.select("account_sub", "sender").distinct(), True)


def upsert_queue(old: DataFrame, requests: DataFrame) -> DataFrame:
    """Requeue an action unless it is already done; key (message, action)."""
    new = requests.select("message_id", "action", F.lit(True).alias("_new")).distinct()
    j = old.join(new, ["message_id", "action"], "full")
    return j.select("message_id", "action",
                    F.when(F.col("_new").isNull() | (F.col("status") == "ok"), F.col("status")).otherwise("pending").alias("status"),
                    F.coalesce("attempts", F.lit(0)).alias("attempts"),
                    F.col("_new").isNotNull().alias("touched"))


def insert_if_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    fresh = new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti")
    return old.unionByName(fresh)


def mark_promoted(reports: DataFrame, keys: DataFrame) -> DataFrame:
    """Stamp reports of promoted keys, once."""
    k = keys.select("sender_key", F.lit(True).alias("_p")).distinct()
    j = reports.join(k, "sender_key", "left")
    stamp = F.col("_p") & ~F.col("promoted_to_fleet")
    return (j.withColumn("newly_promoted", F.coalesce(stamp, F.lit(False)))
            .withColumn("promoted_to_fleet", F.col("promoted_to_fleet") | F.col("newly_promoted")).drop("_p"))


# --- grading -----------------------------------------------------------------
def _first_cascade_after(needs: DataFrame, cascades: DataFrame) -> DataFrame:
    """(id, label, at): first cascade of the same tenant and sender after each message's own grade.

    Ordered inside one-day slices of a sender, so a hot sender is spread over
    as many tasks as it has days; the next non-empty slice comes from a small
    per-slice table.
    """
    key, day = ["account_sub", "sender"], F.floor(F.unix_seconds("at") / 86_400)
    c = cascades.select(*key, "at", F.col("label").alias("c_label"), F.lit(None).cast("long").alias("id")).withColumn("slice", day)
    n = needs.select(*key, "at", F.lit(None).cast("int").alias("c_label"), "id").withColumn("slice", day)
    # Within a slice: the nearest later cascade.  At equal times needs come later in this descending order,
    # so a cascade at the very same instant does not count.
    later = Window.partitionBy(*key, "slice").orderBy(F.desc("at"), F.asc_nulls_last("id")).rowsBetween(Window.unboundedPreceding, -1)
    mark = F.when(F.col("id").isNull(), F.struct("c_label", "at"))
    inside = c.unionByName(n).withColumn("hit", F.last(mark, ignorenulls=True).over(later)).filter(F.col("id").isNotNull())
    per_slice = c.groupBy(*key, "slice").agg(F.min_by(F.struct("c_label", "at"), "at").alias("head"))
    # (sender, day) pairs only: next slice that has a cascade.
    slices = n.select(*key, "slice").distinct().join(per_slice, [*key, "slice"], "full")
    ahead = Window.partitionBy(*key).orderBy(F.desc("slice")).rowsBetween(Window.unboundedPreceding, -1)
    nxt = slices.withColumn("next_head", F.last("head", ignorenulls=True).over(ahead)).select(*key, "slice", "next_head")
    return (inside.join(nxt, [*key, "slice"], "left").select("id", F.coalesce("hit", "next_head").alias("h"))
            .select("id", F.col("h.c_label").alias("after_label"), F.col("h.at").alias("after_at")))


def apply_grades(messages: DataFrame, grades: DataFrame) -> DataFrame:
    """State after people's grades, in time order, including same-sender cascades.

    ``grades``: (message_id, account_sub, verdict, graded_at), one per message.
    A grade sets its own message; block and safe also set the tenant's ungraded
    messages of that sender.  Safe clears the confidence, block keeps it.
    """
    g = grades.select(F.col("message_id").alias("id"), "account_sub", grade_label(F.col("verdict")).alias("own_label"),
                      F.col("verdict").alias("status"), F.col("graded_at").alias("own_at"))
    m = messages.join(g, ["id", "account_sub"], "left")
    cascades = (m.filter(F.col("own_label").isNotNull() & (text_or_empty(F.col("sender")) != ""))
                .select("account_sub", "sender", F.col("own_label").alias("label"), F.col("own_at").alias("at")))
    first = cascades.groupBy("account_sub", "sender").agg(
        F.min_by(F.struct(F.col("label").alias("c0"), F.col("at").alias("t0")), "at").alias("f")).select("account_sub", "sender", "f.*")
    unsure = m.filter(F.col("own_at").isNotNull() & F.col("own_label").isNull()).select("id", "account_sub", "sender", F.col("own_at").alias("at"))
    m = m.join(first, ["account_sub", "sender"], "left").join(_first_cascade_after(unsure, cascades), "id", "left")
    before = F.col("label").isNull() & F.col("t0").isNotNull() & (F.col("own_at").isNull() | (F.col("t0") < F.col("own_at")))
    own = F.col("own_at").isNotNull()
    m = m.withColumn("_pre", F.when(before, F.col("c0")))
    steps = F.array_compact(F.array("_pre", F.col("own_label"), F.col("after_label")))
    last = F.get(steps, F.size(steps) - 1)
    label = (F.when(F.col("own_label").isNotNull(), F.col("own_label")).when(own, F.col("after_label"))
             .otherwise(F.coalesce("label", "_pre")))
    cleared = F.exists(steps, lambda s: s == 0)
    return m.withColumns({
        "new_label": label, "is_threat": F.coalesce(last, "is_threat"),
        "confidence": F.when(cleared, F.lit(0.0)).otherwise(F.col("confidence")),
        "cascaded": (~own & F.col("_pre").isNotNull()) | (own & F.col("after_label").isNotNull()),
    }).drop("label", "_pre", "c0", "t0", "after_label", "after_at", "own_label", "own_at").withColumnRenamed("new_label", "label")


# --- tenants -----------------------------------------------------------------
def erase_tenant(tables: dict[str, DataFrame], account_sub: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """Every table without the tenant's rows, and a (table, removed) report."""
    sub = require_tenant(account_sub)
    kept = {name: df.filter(~F.col("account_sub").eqNullSafe(sub)) for name, df in tables.items()}
    report = None
    for name, df in tables.items():
        row = df.filter(F.col("account_sub") == sub).agg(F.lit(name).alias("table"), F.count("*").alias("removed"))
        report = row if report is None else report.unionByName(row)
    return kept, report


def harvest_verified(messages: DataFrame, account_sub: str) -> DataFrame:
    """Verified labels kept for training before a tenant is erased, without personal identity."""
    sub = require_tenant(account_sub)
    rows = trusted_labels(messages.filter(F.col("account_sub") == sub), json_field(F.col("metadata"), "label_source"), TRUSTED_DB_SOURCES)
    text = (text_or_empty(F.col("subject")) != "") | (text_or_empty(F.col("body")) != "")
    return rows.filter(text).select(
        "id", F.col("message_type").alias("channel"), "subject", "body",
        redact_sender(F.col("sender")).alias("sender"), F.col("trusted_label").alias("label"), F.lit("retained-verified").alias("source"))


def append_messages(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """Stored rows plus valid, not yet stored batch rows."""
    from msgsieve.operators.dedup import new_messages
    ok = valid_tenant(F.col("account_sub")) & (F.col("mailbox_id") > 0)
    return stored.unionByName(new_messages(batch.filter(ok), stored))


# --- sender lists ------------------------------------------------------------
def list_upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """Block or warn list: last entry per sender."""
    return upsert(old, new, ["sender"], "seq")


def listed(df: DataFrame, entries: DataFrame) -> DataFrame:
    """Rows whose sender is on a list."""
    return df.join(entries.select("sender").distinct(), "sender", "left_semi")


# --- documents and secrets ---------------------------------------------------
def metadata_patch(df: DataFrame, patch: Column, column: str = "metadata") -> DataFrame:
    """Merge a JSON patch into a JSON document, top-level keys of the patch winning; values keep their type."""
    base = F.coalesce(F.from_json(F.coalesce(F.col(column), F.lit("{}")), "map<string,variant>"), F.from_json(F.lit("{}"), "map<string,variant>"))
    change = F.coalesce(F.from_json(patch, "map<string,variant>"), F.from_json(F.lit("{}"), "map<string,variant>"))
    old = F.map_filter(base, lambda k, _: ~F.array_contains(F.map_keys(change), k))
    return df.withColumn(column, F.to_json(F.map_concat(old, change)))


ENCRYPTED_PREFIX = "enc1:"


def encrypt_columns(df: DataFrame, columns: list[str], key: Column) -> DataFrame:
    """Encrypt text columns; values that already carry the mark stay as they are."""
    def seal(c: str) -> Column:
        sealed = F.concat(F.lit(ENCRYPTED_PREFIX), F.base64(F.aes_encrypt(F.col(c), key, F.lit("GCM"))))
        return F.when(F.col(c).startswith(ENCRYPTED_PREFIX) | (F.col(c) == ""), F.col(c)).otherwise(sealed)
    done = {f"{c}_was_encrypted": F.coalesce(F.col(c).startswith(ENCRYPTED_PREFIX), F.lit(False)) for c in columns}
    return df.withColumns(done).withColumns({c: seal(c) for c in columns})


def decrypt_columns(df: DataFrame, columns: list[str], key: Column) -> DataFrame:
    """Clear text; null for a value the key cannot open, unmarked values pass."""
    def opened(c: str) -> Column:
        raw = F.unbase64(F.substr(F.col(c), F.lit(len(ENCRYPTED_PREFIX) + 1)))
        return F.when(F.col(c).startswith(ENCRYPTED_PREFIX), F.try_aes_decrypt(raw, key, F.lit("GCM")).cast("string")).otherwise(F.col(c))
    return df.withColumns({c: opened(c) for c in columns})
