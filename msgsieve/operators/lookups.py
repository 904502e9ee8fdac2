"""Look-up joins: allow-lists, threat lists, look-alikes, feeds, geography, neighbours, ownership."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from msgsieve import lexicons as lx
from msgsieve.functions import phones, urls
from msgsieve.functions.text import entity_keys, has_any, text_or_empty
from msgsieve.operators import vector_index
from msgsieve.operators.ordered import top_per_key
from msgsieve.session import cut_lineage


# --- exports -----------------------------------------------------------------
def sms_with_handles(messages: DataFrame, handles: DataFrame, how: str = "left", limit: int | None = None) -> DataFrame:
    """SMS rows with their sender; ``inner`` keeps only received messages with a handle."""
    joined = messages.join(handles, messages.handle_id == handles.rowid, how)
    if how == "inner":
        joined = joined.filter(~F.col("is_from_me"))
    text = F.replace(F.replace(text_or_empty(F.col("text")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    out = joined.select("msg_id", text.alias("text"), F.coalesce("handle", F.lit("Unknown")).alias("sender"), "date")
    return out.orderBy(F.desc("date"), F.desc("msg_id")).limit(limit) if limit else out


# --- sender lists ------------------------------------------------------------
GRAMS = (8, 4, 2, 1)


def pattern_keys(pattern: Column) -> Column:
    """The index key (kind, key) of a LIKE pattern, from its longest literal piece.

    ``p``: the piece begins the pattern, ``s``: it ends it, ``g``: the first 8,
    4, 2 or 1 characters of a piece in the middle, ``a``: no piece, or an escape
    that hides one.  Every text that matches the pattern has the key among its
    ``text_keys``.
    """
    piece = F.reduce(F.split(pattern, "[%_]"), F.lit(""), lambda a, x: F.when(F.length(x) > F.length(a), x).otherwise(a))
    gram = F.coalesce(*[F.when(F.length(piece) >= n, F.substring(piece, 1, n)) for n in GRAMS])
    key = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("key"))
    return (F.when(pattern.contains("\\") | (piece == ""), key("a", F.lit(""))).when(F.startswith(pattern, piece), key("p", piece))
            .when(F.endswith(pattern, piece), key("s", piece)).otherwise(key("g", gram)))


def text_keys(text: Column) -> Column:
    """All (kind, key) under which a pattern that matches ``text`` may be filed."""
    n = F.length(text)
    spans = F.sequence(F.lit(1), F.greatest(n, F.lit(1)))

    def keys(kind: str, values: Column) -> Column:
        return F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("key")))

    def grams(size: int) -> Column:
        return F.filter(F.transform(spans, lambda i: F.substring(text, i, F.lit(size))), lambda x: F.length(x) == size)

    return F.array_distinct(F.concat(
        keys("a", F.array(F.lit(""))), keys("p", F.transform(spans, lambda i: F.substring(text, F.lit(1), i))),
        keys("s", F.transform(spans, lambda i: F.substring(text, i, n))), *[keys("g", grams(size)) for size in GRAMS]))


def match_safe_senders(df: DataFrame, rules: DataFrame) -> DataFrame:
    """Best rule per message as (id, tier, pattern): exact sender, then pattern, then domain.

    The tests run once per distinct (tenant, sender), not per message.  Exact
    and domain rules are equal joins.  Patterns are filed under a key from
    their longest literal piece and meet only senders that have the key; LIKE
    comes last, so a tenant's rules and senders are never paired as a whole.
    """
    pairs = (df.filter(F.col("sender").contains("@")).select("account_sub", "sender").distinct()
             .withColumn("_s", F.lower("sender")).withColumn("_d", F.element_at(F.split("_s", "@"), -1)))

    def equal(kind: str, tier: int, on: str) -> DataFrame:
        own = rules.filter(F.col("match_type") == kind).select("account_sub", F.col("pattern").alias(on)).distinct()
        return pairs.join(own, ["account_sub", on]).select("account_sub", "sender", F.lit(tier).alias("tier"), F.col(on).alias("pattern"))

    patterns = rules.filter(F.col("match_type") == "pattern").select("account_sub", "pattern").distinct()
    filed = patterns.withColumn("_k", pattern_keys(F.col("pattern"))).select("account_sub", "pattern", "_k.kind", "_k.key")
    asked = pairs.join(patterns.select("account_sub").distinct(), "account_sub", "left_semi").select("account_sub", "sender", "_s", F.explode(text_keys(F.col("_s"))).alias("_k"))
    likely = asked.select("account_sub", "sender", "_s", "_k.kind", "_k.key").join(filed, ["account_sub", "kind", "key"])
    like = likely.filter(F.like("_s", F.col("pattern"))).select("account_sub", "sender", F.lit(2).alias("tier"), "pattern")
    hit = equal("exact", 1, "_s").unionByName(like).unionByName(equal("domain", 3, "_d"))
    best = hit.groupBy("account_sub", "sender").agg(F.min(F.struct("tier", "pattern")).alias("b"))
    return df.join(best, ["account_sub", "sender"]).select("id", "b.tier", "b.pattern")


def sender_key(sender: Column) -> Column:
    domain = urls.sender_domain(sender)
    return F.when(domain != "", domain).otherwise(F.lower(F.trim(text_or_empty(sender))))


def match_fleet_keys(df: DataFrame, keys: DataFrame) -> DataFrame:
    """Add ``fleet_hit`` and ``fleet_confidence`` from the shared threat list."""
    k = keys.select(F.col("sender_key").alias("_k"), F.col("confidence").alias("fleet_confidence"))
    return (df.withColumn("_key", sender_key(F.col("sender"))).join(k, F.col("_key") == F.col("_k"), "left")
            .withColumn("fleet_hit", F.col("_k").isNotNull()).drop("_key", "_k"))


CAMPAIGN_PHONE = r"(?<!\d)((?:\+?1[\s\-.]?)?\(?\d{3}\)?[\s\-.]?\d{3}[\s\-.]?\d{4})(?!\d)"


def match_campaign_packs(df: DataFrame, packs: DataFrame) -> DataFrame:
    """(id, campaign_id) for messages whose sender or any number in the text is in a pack."""
    found = F.regexp_extract_all(text_or_empty(F.col("body")), F.lit(CAMPAIGN_PHONE), F.lit(1))
    tens = F.concat(F.array(phones.last_ten(F.col("sender"))), F.transform(found, phones.last_ten))
    keys = F.array_distinct(F.filter(tens, lambda d: F.length(d) == 10))
    return (df.select("id", F.explode(keys).alias("digits")).join(packs, "digits")
            .groupBy("id").agg(F.min("campaign_id").alias("campaign_id")))


def entity_risk(df: DataFrame, crumbs: DataFrame, hits: int = 40) -> DataFrame:
    """How often related entities were graded lately, per message, from its newest 40 crumbs.

    ``crumbs`` (crumb_id, ts, channel, label, entities) are all read.  A
    message's newest crumbs are among the newest of each of its entities, so
    only 40 per entity meet the messages.
    """
    newest = [F.desc("ts"), F.desc("crumb_id"), F.asc("channel"), F.asc("crumb_label")]

    def nearest(rows: DataFrame, key: str) -> DataFrame:
        # Ranked densely: a crumb that comes twice, by a copy or by two entities, takes one place.
        rank = F.dense_rank().over(Window.partitionBy(key).orderBy(*newest))
        return rows.withColumn("rank", rank).filter(F.col("rank") <= hits).drop("rank").distinct()

    keyed = nearest(crumbs.select("crumb_id", "ts", "channel", F.col("label").alias("crumb_label"), F.explode(F.array_distinct("entities")).alias("entity")), "entity")
    pairs = (df.select("id", F.explode(F.array_distinct(entity_keys(F.col("sender"), F.col("body")))).alias("entity"))
             .join(keyed, "entity").select("id", "crumb_id", "ts", "channel", "crumb_label"))
    kept = nearest(pairs, "id")
    threats = F.count_if(F.col("crumb_label") == 1)
    return kept.groupBy("id").agg(
        F.count("*").alias("hits"), threats.alias("threat_hits"),
        F.array_join(F.array_sort(F.collect_set("channel")), ",").alias("channels"),
        F.round(F.least(F.lit(0.25), threats * 0.05), 3).alias("boost"))


# --- feeds -------------------------------------------------------------------
def url_feed_verdicts(links: DataFrame, listed: DataFrame, scored: DataFrame) -> DataFrame:
    """Strongest hit per distinct link.

    ``listed`` (url) counts .9; ``scored`` (url, score, phishing, malware)
    counts score/100 with floors .8 and .85.
    """
    risk = F.coalesce(F.col("score") / 100.0, F.lit(0.0))
    risk = F.when(F.col("phishing"), F.greatest(risk, F.lit(0.8))).otherwise(risk)
    risk = F.when(F.col("malware"), F.greatest(risk, F.lit(0.85))).otherwise(risk)
    feeds = (listed.select("url", F.lit(0.9).alias("risk"), F.lit("listed").alias("source"))
             .unionByName(scored.select("url", F.least(risk, F.lit(1.0)).alias("risk"), F.lit("scored").alias("source"))
                          .filter(F.col("risk") > 0)))
    # Aggregate the feeds before the join: one row per link meets the link table.
    best = feeds.groupBy("url").agg(F.max_by(F.struct("risk", "source"), F.struct("risk", F.col("source") == "listed")).alias("b"))
    return links.select("url").distinct().join(best, "url").select("url", "b.risk", "b.source")


IPV4 = r"^(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})$"
PRIVATE_IP = r"^(10\.|172\.(1[6-9]|2[0-9]|3[01])\.|192\.168\.|127\.|169\.254\.|::1$|fc00:|fe80:)"
HIGH_RISK_COUNTRIES = ["CN", "RU", "NG", "PK", "IN", "BR", "RO", "VN"]
RISKY_ISPS = ["vpn", "proxy", "hosting", "datacenter", "cloud", "digital ocean", "aws", "azure"]


def ip_number(ip: Column) -> Column:
    return sum((F.regexp_extract(ip, IPV4, i + 1).cast("long") * (256 ** (3 - i)) for i in range(4)), F.lit(0))


def ip_geo(df: DataFrame, ranges: DataFrame, ip: str = "ip") -> DataFrame:
    """Location and risk per distinct address.

    Ranges are cut into the /16 blocks they cover, so the range test is an
    equi-join on the block; a block holds at most 65,536 distinct addresses.
    """
    ips = (df.select(F.col(ip).alias("ip")).filter(F.length(F.col(ip)) > 0).distinct()
           .withColumn("private", F.col("ip").rlike(PRIVATE_IP))
           .withColumn("n", F.when(~F.col("private"), F.when(F.col("ip").rlike(IPV4), ip_number(F.col("ip")))))
           .withColumn("block", F.shiftright("n", 16)))
    cut = ranges.withColumn("block", F.explode(F.sequence(F.shiftright("lo", 16), F.shiftright("hi", 16))))
    hit = ips.join(cut, (ips.block == cut.block) & F.col("n").between(F.col("lo"), F.col("hi")), "left")
    risk = (F.when(F.col("country_code").isin(HIGH_RISK_COUNTRIES), "HIGH")
            .when(has_any(F.lower("isp"), RISKY_ISPS), "MEDIUM").otherwise("LOW"))
    return hit.select("ip", "private", "country_code", "isp",
                      F.when(F.col("country_code").isNotNull(), risk).alias("risk_level"))


# --- domains -----------------------------------------------------------------
def known_good_match(sender: Column) -> Column:
    """Longest allow-listed parent of the sender's domain; null if none. A column, so no join."""
    parents = urls.parent_domains(urls.mailbox_domain(sender))
    return F.get(F.filter(parents, lambda p: p.isin(lx.KNOWN_GOOD_DOMAINS)), 0)


def known_good_domain(df: DataFrame, domains: DataFrame) -> DataFrame:
    """(id, matched_domain) for a caller's own allow-list table ``domains(domain)``."""
    keyed = (df.withColumn("_d", urls.mailbox_domain(F.col("sender")))
             .select("id", F.explode(urls.parent_domains(F.col("_d"))).alias("domain")))
    return (keyed.join(domains.select("domain").distinct(), "domain")
            .groupBy("id").agg(F.max_by("domain", F.length("domain")).alias("matched_domain")))


def disposable_sender(sender: Column) -> Column:
    """Burn-mail domain or a host below one; relay aliases are exempt."""
    s = F.lower(F.trim(text_or_empty(sender)))
    d = F.trim(F.element_at(F.split(s, "@"), -1))
    parents = F.filter(F.coalesce(urls.parent_domains(d), F.array(d)), lambda p: p.isin(lx.DISPOSABLE_DOMAINS))
    return s.contains("@") & ~d.isin(lx.RELAY_DOMAINS) & (F.size(parents) > 0)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once a row, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), 0)


def _brand_slug(s: Column) -> Column:
    return F.regexp_replace(F.translate(F.lower(s), "01345", "oieas"), "[^a-z]", "")


def lookalike_host(sender: Column) -> Column:
    h = F.lower(F.element_at(F.split(text_or_empty(sender), "@"), -1))
    h = F.regexp_replace(h, r"^[>;'\" ]+|[>;'\" ]+$", "")
    h = F.regexp_replace(F.regexp_replace(h, r"\.+$", ""), r"^www\.", "")
    parts = F.split(h, r"\.")
    return F.when(F.size(parts) >= 2, F.array_join(F.slice(parts, -2, 2), ".")).otherwise(h)


def lookalike_brand(sender: Column) -> Column:
    """Brand whose domain the sender's host imitates; null if none or if it is a real brand domain.

    The brand table is a fixed short list, so the test is an array expression
    inside the scan stage: no join and no shuffle.
    """
    def near(slug: Column, b: Column) -> Column:
        n = F.length(b)
        head = F.substring(slug, F.lit(1), n + 1)
        return ((slug == b)
                | ((F.abs(F.length(slug) - n) <= 1) & (F.levenshtein(slug, b, 1) == 1))
                | ((n >= 5) & slug.contains(b) & (F.length(slug) <= n + 3) & (F.levenshtein(head, b, 1) >= 0)))

    def imitated(slug: Column) -> Column:
        return F.when(F.length(slug) >= 4, F.get(F.filter(F.array(*[F.lit(b) for b, _ in lx.BRAND_DOMAINS]), lambda b: near(slug, b)), 0))

    def brand(host: Column) -> Column:
        real = urls.in_domains(host, [d for _, ds in lx.BRAND_DOMAINS for d in ds])
        return F.when(host.contains(".") & ~real, once(_brand_slug(F.split_part(host, F.lit("."), F.lit(1))), imitated))

    return once(lookalike_host(sender), brand)


def one_letter_deletions(name: Column) -> Column:
    """The name and every form of it that lacks one letter: names at edit distance 1 share a form."""
    cut = F.transform(F.sequence(F.lit(1), F.greatest(F.length(name), F.lit(1))), lambda i: F.concat(F.substring(name, F.lit(1), i - 1), F.substring(name, i + 1, F.length(name))))
    return F.array_distinct(F.concat(F.array(name), cut))


def lookalike_names(df: DataFrame, names: DataFrame, real: DataFrame) -> DataFrame:
    """(id, host, name) for senders whose host imitates a name of a table of any size.

    ``names`` has (name, rank), lower-case letters; the least rank wins.
    ``real`` (domain) has the owners' domains; hosts at or below one are left
    out.  A slug imitates a name when it is the same, one edit away, or holds
    it with at most three letters more (names of five letters on).  The first
    two tests join on shared one-letter deletions, the third on the slug's few
    substrings of that length, so no slug meets a name that shares nothing.
    """
    hosts = df.select("id", lookalike_host(F.col("sender")).alias("host"))
    slugs = hosts.filter(F.col("host").contains(".")).select("host").distinct()
    slugs = slugs.withColumn("slug", _brand_slug(F.split_part(F.col("host"), F.lit("."), F.lit(1)))).filter(F.length("slug") >= 4)
    # Both tables grow with the input and their forms are many: no size guessed from a file may send them through the driver.
    owned = slugs.select("host", F.explode(urls.parent_domains(F.col("host"))).alias("domain")).join(real.select("domain").distinct().hint("merge"), "domain", "left_semi")
    slugs = slugs.join(owned.select("host").distinct().hint("merge"), "host", "left_anti")
    size = F.length("slug")
    inner = F.flatten(F.transform(F.sequence(F.lit(0), F.least(F.lit(3), size - 5)), lambda less: F.transform(
        F.sequence(F.lit(1), less + 1), lambda i: F.substring(F.col("slug"), i, size - less))))
    forms = lambda kind, values: F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("form")))
    held = F.when(size >= 5, inner).otherwise(F.array().cast("array<string>"))
    asked = slugs.select("host", "slug", F.explode(F.concat(forms("d", one_letter_deletions(F.col("slug"))), forms("i", F.array_distinct(held)))).alias("k"))
    filed = names.select("name", "rank", F.explode(F.concat(forms("d", one_letter_deletions(F.col("name"))), forms("i", F.array("name")))).alias("k"))
    pairs = asked.select("host", "slug", "k.*").join(filed.select("name", "rank", "k.*").hint("merge"), ["kind", "form"])
    n = F.length("name")
    near = F.levenshtein(F.col("slug"), F.col("name"), 1) >= 0
    within = (n >= 5) & (size <= n + 3) & F.contains(F.col("slug"), F.col("name")) & (F.levenshtein(F.substring(F.col("slug"), F.lit(1), n + 1), F.col("name"), 1) >= 0)
    best = pairs.filter(near | within).groupBy("host").agg(F.min_by("name", F.struct("rank", "name")).alias("name"))
    return hosts.join(best.hint("merge"), "host").select("id", "host", "name")


def typosquat_urls(links: DataFrame) -> DataFrame:
    return (links.withColumn("typo_target", urls.typosquat_target(urls.netloc(F.col("url"))))
            .filter(F.col("typo_target").isNotNull()))


# --- nearest neighbours ------------------------------------------------------
CELL_ROWS = 4096          # rows of one side compared at a time, unless
BLOCK_BYTES = 4 << 20     # their vectors take more than this
PART_BYTES = 64 << 20     # vectors of a partition of the corpus, which a task holds


def _pivots(vectors: DataFrame, count: int) -> np.ndarray:
    """A bounded, repeatable sample of vectors used as cell centres."""
    rows = vectors.orderBy(F.xxhash64("vec_id")).limit(count).select("vec").collect()
    return np.array([r.vec for r in rows], dtype="float64")


def _to_matrix(col: pd.Series) -> np.ndarray:
    return np.stack(col.to_numpy()).astype("float64")


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise L2 distances, in slices so that memory stays small."""
    step = max(1, 4_000_000 // max(1, b.size))
    return np.concatenate([np.sqrt(((a[i:i + step, None, :] - b[None, :, :]) ** 2).sum(-1)) for i in range(0, len(a), step)])


def _least(a: np.ndarray, b: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of a, row of b, L2 distance) of the exact ``k`` nearest rows of ``b`` for each row of ``a``, ties by ``ids``.

    One matrix product bounds all distances up to rounding; only pairs within
    that rounding of the ``k``-th are measured.
    """
    square, other = (a * a).sum(1), (b * b).sum(1)
    about = square[:, None] + other[None, :] - 2 * a @ b.T
    slack = 1e-9 * (square + other.max())
    row, col = np.nonzero(about <= (np.partition(about, k - 1, axis=1)[:, k - 1] + slack)[:, None])
    pieces = [np.sqrt(((a[row[i:i + 65536]] - b[col[i:i + 65536]]) ** 2).sum(-1)) for i in range(0, len(row), 65536)]
    d = np.concatenate(pieces)
    order = np.lexsort((ids[col], d, row))
    row, col, d = row[order], col[order], d[order]
    kept = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[kept], col[kept], d[kept]


def similar_messages(queries: DataFrame, corpus: DataFrame, k: int, same: list[str] | None = None,
                     pivots: int = 64) -> DataFrame:
    """The exact ``k`` nearest corpus vectors per query by L2 distance.

    Both inputs have (vec_id, vec) and the columns of ``same``, which must be
    equal (tenant, type).  Corpus rows go to the cell of their nearest pivot;
    a query needs only cells that can hold one of its ``k`` nearest (triangle
    inequality on cell radius).  Rows of one cell are packed into blocks of
    bounded size on both sides.  Both are written once, and each pair of blocks
    that a query of the one may need is compared where the two are read: no
    vector is copied to disk for each cell that it visits.  A task holds one
    partition of corpus blocks and returns at most ``k`` candidates per query.
    Nothing is sampled or capped.
    """
    same = same or []
    centres = _pivots(corpus.select("vec_id", "vec"), pivots)
    if len(centres) == 0:
        return queries.select(*same, F.col("vec_id").alias("query_id"), F.lit(None).cast("long").alias("match_id"),
                              F.lit(None).cast("double").alias("distance"), F.lit(None).cast("int").alias("rank")).limit(0)
    id_type = corpus.schema["vec_id"].dataType.simpleString()
    same_ddl = "".join(f", `{c}` {corpus.schema[c].dataType.simpleString()}" for c in same)

    def assign(batches):
        for pdf in batches:
            if len(pdf):
                d = _distances(_to_matrix(pdf["vec"]), centres)
                pdf["cell"], pdf["to_pivot"] = d.argmin(1).astype("int32"), d.min(1)
                yield pdf

    placed = corpus.select("vec_id", "vec", *same).mapInPandas(
        assign, f"vec_id {id_type}, vec array<float>{same_ddl}, cell int, to_pivot double")
    # One small row per (scope, cell): number of rows and radius.
    stats = cut_lineage(placed.groupBy(*same, "cell").agg(F.count("*").alias("n"), F.max("to_pivot").alias("radius")))
    per_scope = (stats.groupBy(*same) if same else stats.groupBy()).agg(
        F.collect_list(F.struct("cell", "n", "radius")).alias("cells"))

    def visit(batches):
        for pdf in batches:
            home, bounds, visits = [], [], []
            for vec, cells in zip(_to_matrix(pdf["vec"]) if len(pdf) else [], pdf["cells"]):
                ids = np.array([c["cell"] for c in cells])
                n = np.array([c["n"] for c in cells])
                radius = np.array([c["radius"] for c in cells])
                d = np.sqrt(((centres[ids] - vec) ** 2).sum(1))
                reach = d + radius
                order = np.argsort(reach)
                enough = np.searchsorted(np.cumsum(n[order]), k)
                # With fewer than k rows in all, every one is taken.
                bound = reach[order[enough]] if enough < len(order) else np.inf
                home.append(ids[d.argmin()])
                bounds.append(bound)
                visits.append(np.packbits(np.isin(np.arange(len(centres)), ids[d - radius <= bound + 1e-9])).tobytes())
            if home:
                yield pdf.drop(columns="cells").assign(cell=np.array(home, "int32"), bound=bounds, visits=visits)

    asked = queries.select("vec_id", "vec", *same)
    if same:
        asked = asked.join(per_scope, same)
    else:
        asked = asked.withColumn("_one", F.lit(1)).join(F.broadcast(per_scope.withColumn("_one", F.lit(1))), "_one").drop("_one")
    asked = cut_lineage(asked.mapInPandas(visit, f"vec_id {id_type}, vec array<float>{same_ddl}, cell int, bound double, visits binary"))

    dims = centres.shape[1]
    room = max(1, min(CELL_ROWS, BLOCK_BYTES // (4 * dims)))

    def packed(rows: DataFrame, sizes: DataFrame, bound: str) -> DataFrame:
        """A row per block of at most ``room`` rows of a cell: ids, vecs, bounds and the cells that any of them needs."""
        def pack(batches):
            held, key = [], None

            def block():
                ids, vecs, bounds, visits = zip(*held)
                needed = [] if visits[0] is None else np.flatnonzero(np.unpackbits(np.bitwise_or.reduce([np.frombuffer(v, np.uint8) for v in visits]))).tolist()
                out = pd.DataFrame({**dict(zip([*same, "cell"], ([x] for x in key))), "ids": [list(ids)], "vecs": [np.stack(vecs).astype("<f4").tobytes()],
                                    "bounds": [np.array(bounds, "<f8").tobytes()], "visits": [needed]})
                held.clear()
                return out

            for pdf in batches:
                for *at, i, vec, b, v in zip(*[pdf[c] for c in (*same, "cell", "vec_id", "vec", "bound", "visits")]):
                    if held and (at != key or len(held) == room):
                        yield block()
                    key = at
                    held.append((i, vec, b, v))
            if held:
                yield block()

        spots = sizes.select(*same, "cell", F.ceil(F.col("n") / room).cast("int").alias("slices"))
        rows = rows.join(F.broadcast(spots) if not same else spots, [*same, "cell"]).withColumn("slice", F.pmod(F.xxhash64("vec_id"), F.col("slices")).cast("int"))
        rows = rows.select(*same, "cell", "vec_id", "vec", F.col(bound).alias("bound"), (F.col("visits") if "visits" in rows.columns else F.lit(None).cast("binary")).alias("visits"), "slice")
        rows = rows.repartition(*same, "cell", "slice").sortWithinPartitions(*same, "cell", "slice").drop("slice")
        return rows.mapInPandas(pack, f"{same_out}cell int, ids array<{id_type}>, vecs binary, bounds binary, visits array<int>")

    same_out = "".join(f"`{c}` {corpus.schema[c].dataType.simpleString()}, " for c in same)
    cores = corpus.sparkSession.sparkContext.defaultParallelism
    bytes_of = lambda frame: (frame.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]) * dims * 4
    load = cut_lineage(asked.groupBy(*same, "cell").agg(F.count("*").alias("n")))
    blocks = packed(placed, stats, "to_pivot").coalesce(-(-bytes_of(stats) // PART_BYTES) or 1)
    blocks = cut_lineage(blocks.select(*[F.col(c).alias(f"_{c}") for c in same], F.col("cell").alias("_cell"), F.col("ids").alias("_ids"), F.col("vecs").alias("_vecs"), F.col("bounds").alias("_radii")))
    asked = cut_lineage(packed(asked, load, "bound").repartition(max(3 * cores, -(-bytes_of(load) // PART_BYTES))).withColumn("block", F.monotonically_increasing_id()))
    # Each partition of the one side is read beside each of the other; neither is shuffled or sent to the driver.
    needed = F.array_contains("visits", F.col("_cell"))
    for c in same:
        needed = needed & (F.col(c) == F.col(f"_{c}"))
    pairs = asked.join(blocks.hint("shuffle_replicate_nl"), needed).select("block", *same, "cell", "ids", "vecs", "bounds", "_cell", "_ids", "_vecs", "_radii")

    def nearest(batches):
        at = best = None
        names = [*same, "query_id", "match_id", "distance"]

        def rows():
            row, ids, d = best
            picked = pa.array(row)
            known = [pa.repeat(scope, len(row)) for scope in at["scope"]]
            return pa.RecordBatch.from_arrays([*known, at["ids"].take(picked), pa.array(ids, from_pandas=True).cast(at["ids"].type, safe=False), pa.array(d)], names)

        for batch in batches:
            for i in range(batch.num_rows):
                cell = {c: batch[c][i] for c in batch.schema.names}
                if at is None or at["block"] != cell["block"].as_py():
                    if best is not None:
                        yield rows()
                    at = {"block": cell["block"].as_py(), "scope": [cell[c] for c in same], "ids": cell["ids"].values,
                          "vecs": np.frombuffer(cell["vecs"].as_buffer(), "<f4").reshape(-1, dims).astype("float64"), "bounds": np.frombuffer(cell["bounds"].as_buffer(), "<f8")}
                    best = np.zeros(0, np.int64), cell["_ids"].values.to_numpy(zero_copy_only=False)[:0], np.zeros(0)
                other = np.frombuffer(cell["_vecs"].as_buffer(), "<f4").reshape(-1, dims).astype("float64")
                radius = np.frombuffer(cell["_radii"].as_buffer(), "<f8").max()
                best = _nearer(at["vecs"], at["bounds"], best, other, cell["_ids"].values.to_numpy(zero_copy_only=False), centres[cell["_cell"].as_py()], radius, k)
        if best is not None:
            yield rows()

    found = pairs.mapInArrow(nearest, f"{same_out}query_id {id_type}, match_id {id_type}, distance double")
    return top_per_key(found, [*same, "query_id"], [F.asc("distance"), F.asc("match_id")], k)


def _nearer(a: np.ndarray, bounds: np.ndarray, best: tuple, b: np.ndarray, ids: np.ndarray, centre: np.ndarray, radius: float, k: int) -> tuple:
    """``best`` (row of a, id, distance; k a row at most) after the rows of ``b``, all within ``radius`` of ``centre``."""
    row, known, d = best
    last = np.full(len(a), np.inf)  # distance of the k-th so far
    full = np.bincount(row, minlength=len(a)) >= k
    if len(row):
        worst = np.zeros(len(a))
        np.maximum.at(worst, row, d)
        last[full] = worst[full]
    limit = np.minimum(last, bounds) + 1e-9
    asked = np.flatnonzero(np.sqrt(((a - centre) ** 2).sum(1)) - radius <= limit)
    step = max(1, 2_000_000 // len(b))
    pieces = [(row, known, d)]
    for lo in range(0, len(asked), step):
        some = asked[lo:lo + step]
        closed = some[full[some]]
        some = some[~full[some]]
        if len(some):
            r, c, x = _least(a[some], b, ids, min(k, len(b)))
            pieces.append((some[r], ids[c], x))
        if len(closed):
            # One matrix product bounds all distances up to rounding; most rows have k nearer ones already.
            x = a[closed]
            square, other = (x * x).sum(1), (b * b).sum(1)
            about = square[:, None] + other[None, :] - 2 * x @ b.T
            r, c = np.nonzero(about <= (limit[closed] ** 2 + 1e-9 * (1 + square + other.max()))[:, None])
            if len(r):
                far = np.concatenate([np.sqrt(((x[r[i:i + 65536]] - b[c[i:i + 65536]]) ** 2).sum(-1)) for i in range(0, len(r), 65536)])
                pieces.append(_first(closed[r], ids[c], far, k))
    return best if len(pieces) == 1 else _first(*(np.concatenate(x) for x in zip(*pieces)), k)


def _first(row: np.ndarray, ids: np.ndarray, d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` of least distance of each row, ties by ``ids``."""
    order = np.lexsort((ids, d, row))
    row, ids, d = row[order], ids[order], d[order]
    kept = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[kept], ids[kept], d[kept]


def similarity(distance: Column) -> Column:
    return F.round(F.greatest(F.lit(0.0), 1 - distance), 4)


def nearest_label(queries: DataFrame, corpus: DataFrame, same: list[str] | None = None) -> DataFrame:
    """Stored verdict of the single nearest item; ``corpus`` also has ``is_threat``."""
    best = similar_messages(queries, corpus, 1, same)
    return best.join(corpus.select(F.col("vec_id").alias("match_id"), "is_threat"), "match_id")


def similar_messages_ann(queries: DataFrame, corpus: DataFrame, k: int, same: list[str] | None = None, share: float = 0.98) -> DataFrame:
    """About the ``k`` nearest corpus vectors per query by an inverted file with product codes; see ``vector_index``."""
    return vector_index.search(vector_index.build_index(corpus, k, share, same=same), queries, k)


# --- ownership ---------------------------------------------------------------
CHANNEL_ALIASES = {"email": "email", "sms": "sms", "call": "call", "phishing": "email", "smishing": "sms", "vishing": "call"}


def owned_reports(reports: DataFrame, messages: DataFrame) -> DataFrame:
    """Reports with ``error`` null when the message belongs to the reporter; the stored sender wins."""
    own = messages.select(F.col("id").alias("message_id"), "account_sub", F.col("sender").alias("stored_sender"), F.lit(True).alias("_own"))
    joined = reports.join(own, ["message_id", "account_sub"], "left")
    missing = F.col("message_id").isNotNull() & F.col("_own").isNull()
    return (joined.withColumn("error", F.when(missing, "message_not_found"))
            .withColumn("sender", F.when(F.col("_own"), text_or_empty(F.col("stored_sender"))).otherwise(F.col("sender")))
            .drop("_own", "stored_sender"))


def queueable_actions(requests: DataFrame, messages: DataFrame, action: str = "junk") -> DataFrame:
    """Requested message ids with their provider identity and ``queued`` or ``skipped``."""
    own = messages.select(F.col("id").alias("message_id"), "account_sub", "mailbox_id", "provider", "provider_uid", "uidvalidity", "folder")
    joined = requests.join(own, ["message_id", "account_sub"], "left")
    whole = F.lit(True)
    for c in ("provider", "provider_uid", "folder"):
        whole = whole & (text_or_empty(F.col(c)) != "")
    whole = whole & F.coalesce(F.col("mailbox_id") != 0, F.lit(False))
    return joined.withColumns({"action": F.lit(action), "outcome": F.when(whole, "queued").otherwise("skipped")})


# --- numbers -----------------------------------------------------------------
def prior_sightings(numbers: DataFrame, messages: DataFrame) -> DataFrame:
    """Risk of numbers already seen as threats; every row counts."""
    seen = (messages.filter(F.col("is_threat") == 1).select("sender", "message_type")
            .join(numbers.select(F.col("number").alias("sender")).distinct(), "sender", "left_semi"))
    n = F.count("*")
    agg = seen.groupBy(F.col("sender").alias("number")).agg(
        n.alias("report_count"), F.array_sort(F.collect_set("message_type")).alias("_c"))
    return agg.select("number", "report_count", F.least(F.lit(0.95), F.col("report_count") * 0.1 + 0.5).alias("risk"),
                      F.least(F.lit(1.0), F.col("report_count") * 0.1 + 0.5).alias("confidence"),
                      F.array_join(F.concat("_c", F.array(F.lit("prior_offender"))), ",").alias("categories"))


def callback_fanout(calls: DataFrame) -> DataFrame:
    """One label row per number spoken in a threat transcript, except the caller's."""
    numbers = phones.extract_phones(F.col("body"), F.col("sender"))
    return (calls.filter(F.col("is_threat") == 1)
            .select(F.col("id").alias("parent_id"), "account_sub", F.col("sender").alias("parent_caller_id"),
                    F.explode(numbers).alias("sender"), F.lit("label").alias("action"), F.lit("transcript-callback").alias("via"),
                    F.concat(F.lit("[callback from transcript of "), F.col("sender"), F.lit("] "), F.col("body")).alias("content")))


def number_candidates(messages: DataFrame) -> DataFrame:
    """Distinct numbers of all call and SMS rows."""
    calls = messages.filter(F.col("message_type").isin("vishing", "smishing"))
    return calls.select(phones.e164(F.col("sender")).alias("number")).filter(F.col("number").startswith("+")).distinct()


def number_enrichment_candidates(messages: DataFrame, feed: DataFrame, min_risk: float = 0.4) -> DataFrame:
    """Candidates with a feed risk worth storing; the feed is reduced to one row per number first."""
    best = feed.groupBy("number").agg(F.max("risk").alias("risk"))
    return number_candidates(messages).join(best.filter(F.col("risk") >= min_risk), "number")


def train_eval_overlap(evaluation: DataFrame, train_groups: DataFrame, overlap: bool = True) -> DataFrame:
    """Evaluation rows whose group is (or is not) in training."""
    return evaluation.join(train_groups.select("group_id").distinct(), "group_id", "left_semi" if overlap else "left_anti")


# --- message-level verdict joins ---------------------------------------------
def url_table(messages: DataFrame) -> DataFrame:
    """One row per scheme link of a message: (id, message_type, pos, url)."""
    # Outer form and later filter: the inner form makes Spark scan the text twice more to drop empty arrays early.
    rows = messages.select("id", "message_type", F.posexplode_outer(urls.scheme_urls(F.col("body"))).alias("pos", "url"))
    return rows.filter(F.col("pos").isNotNull())


def url_risk(links: DataFrame, redirects: str | None = None) -> DataFrame:
    """Add flags, ``risk_score`` 0-100 and ``threat_level`` to a link table."""
    flagged = links.withColumn("flags", urls.url_flags(F.col("url"), F.col(redirects) if redirects else None))
    scored = flagged.withColumn("risk_score", urls.flag_points(F.col("flags")))
    return scored.withColumn("threat_level", urls.threat_level(F.col("risk_score")))


def with_high_risk_links(messages: DataFrame) -> DataFrame:
    """Add ``links`` and ``high_risk_links`` per message without leaving the scan stage."""
    found = urls.scheme_urls(F.col("body"))
    staged = messages.withColumn("_urls", found)
    high = F.size(F.filter("_urls", lambda x: urls.flag_points(urls.url_flags(x)) >= 70))
    return staged.withColumns({"links": F.size("_urls"), "high_risk_links": high}).drop("_urls")


def url_boost(messages: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Raise messages with a link verdict of 70 or more; ``verdicts`` has (id, risk_score)."""
    bad = verdicts.filter(F.col("risk_score") >= 70).groupBy("id").agg(F.count("*").alias("bad_links"))
    joined = messages.join(bad, "id", "left").withColumn("bad_links", F.coalesce("bad_links", F.lit(0)))
    hit = F.col("bad_links") > 0
    return joined.withColumns({"is_threat": F.when(hit, 1).otherwise(F.col("is_threat")),
                               "confidence": F.when(hit, F.greatest("confidence", F.lit(0.85))).otherwise(F.col("confidence"))})


def email_report(messages: DataFrame, bad_urls: DataFrame, bad_ips: DataFrame, bad_senders: DataFrame) -> DataFrame:
    """Threat points per message: .4 per bad link, .3 per bad address, .3 for a bad sender.

    The look-up frames carry counts per message: (id, n).
    """
    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("id").agg(F.sum("n").alias(name))

    out = messages.select("id")
    for df, name in ((bad_urls, "bad_urls"), (bad_ips, "bad_ips"), (bad_senders, "bad_senders")):
        out = out.join(counted(df, name), "id", "left")
    out = out.na.fill(0, ["bad_urls", "bad_ips", "bad_senders"])
    score = F.round(F.col("bad_urls") * 0.4 + F.col("bad_ips") * 0.3 + F.least("bad_senders", F.lit(1)) * 0.3, 6)
    out = out.withColumn("threat_score", score)
    return out.withColumn("recommendation", F.when(F.col("threat_score") >= 0.7, "block")
                          .when(F.col("threat_score") >= 0.4, "quarantine").otherwise("safe"))


def identity_risk(subjects: DataFrame, phone_feed: DataFrame, email_feed: DataFrame, breach_feed: DataFrame) -> DataFrame:
    """Report rows per consented subject; numbers and mailboxes read different feeds.

    Feeds: phone (subject, risk), email (subject, fraud_score, disposable,
    recent_abuse), breach (subject, breaches).
    """
    s = F.trim("subject")
    digits = F.regexp_replace(s, r"\D", "")
    who = (subjects.filter(F.col("consented")).select(s.alias("subject"))
           .withColumn("is_phone", (F.length(digits) >= 10) & ~s.contains("@")))
    phone = (who.filter("is_phone").join(phone_feed.groupBy("subject").agg(F.max("risk").alias("risk")), "subject")
             .select("subject", F.lit("phone").alias("layer"), F.lit("").alias("findings"), "risk"))
    risk = F.coalesce(F.col("fraud_score") / 100.0, F.lit(0.0))
    risk = F.when(F.col("disposable"), F.greatest(risk, F.lit(0.6))).otherwise(risk)
    risk = F.when(F.col("recent_abuse"), F.greatest(risk, F.lit(0.55))).otherwise(risk)
    notes = F.concat_ws("; ", F.when(F.col("disposable"), "Disposable mailbox"), F.when(F.col("recent_abuse"), "Recent abuse"))
    mail = (who.filter(~F.col("is_phone") & F.col("subject").contains("@")).withColumn("_k", F.lower("subject"))
            .join(email_feed.withColumnRenamed("subject", "_k"), "_k")
            .select("subject", F.lit("email").alias("layer"), notes.alias("findings"), risk.alias("risk")))
    breach = (who.join(breach_feed.groupBy("subject").agg(F.sum("breaches").alias("n")), "subject")
              .select("subject", F.lit("breach").alias("layer"), F.concat(F.col("n").cast("string"), F.lit(" breaches")).alias("findings"),
                      F.least(F.lit(1.0), F.col("n") * 0.1).alias("risk")))
    return phone.unionByName(mail).unionByName(breach)

