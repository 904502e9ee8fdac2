"""Mix sources to target weights by a low-discrepancy schedule of equal-token blocks.

1. Targets: weights share a total; no source exceeds ``max_passes`` times its
   size, the excess goes to the others by weight (a water level, found in
   exact integers from sums over the sources).
2. Schedule: slot ``i`` is the golden-ratio point ``frac((i + 1) / phi)`` in
   53-bit fixed point, looked up in the sources' cumulative targets.  Slots
   are ranked per source.
3. Blocks: a source's documents, shuffled by a hash, form a stream of tokens
   that starts over at its end.  The stream up to the target is cut into as
   many equal blocks as the source has slots; slot of rank r takes block r.

Everything is DataFrame work.  A source that holds most rows is ranked in
chunks (``ranking``).  The interval look-up is an equi-join on the top bits of
the point.  Only sums over all sources reach the driver.
"""

from __future__ import annotations

from math import ceil, isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from msgsieve.llm.common import as_columns, cut_lineage
from msgsieve.llm.ranking import running_total

POINT_BITS = 53
GOLDEN = 5566755282872655  # 2**53 / phi, odd


def word_count(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: tuple[int, int] = (3, 2),
                   max_passes: int = 2) -> DataFrame:
    """source, source_rank, source_size, target: one row per source of ``sized`` (source, size).

    Sources in code-point order (null last) take ``weights`` in turn and share
    ``share`` (a fraction) of all sizes.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    parts = sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("_part", F.spark_partition_id())
    parts = cut_lineage(parts)
    rank = Window.partitionBy("_part").orderBy(F.col("source").asc_nulls_last())
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.groupBy("_part").count().withColumn("_before", F.coalesce(F.sum("count").over(ahead), F.lit(0)))
    turn = F.array(*[F.lit(w) for w in weights])
    ranked = parts.withColumn("_in", F.row_number().over(rank) - 1).join(before.select("_part", "_before"), "_part")
    ranked = ranked.withColumn("source_rank", (F.col("_in") + F.col("_before")).cast("long"))
    ranked = ranked.withColumn("weight", turn[(F.col("source_rank") % len(weights)).cast("int")].cast("long"))
    ranked = cut_lineage(ranked.select("source", "source_rank", "source_size", "weight", (F.col("source_size") * max_passes).alias("cap")))
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    # The water level: what one unit of weight gets once the full sources are set aside.  It only rises.
    goal, level = total * share[0], 0.0
    while True:
        full = F.col("weight") * F.lit(level) >= F.col("cap")
        capped, free = ranked.agg(F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0)),
                                  F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0))).first()
        raised = max(level, (goal - capped * share[1]) / (free * share[1])) if free else float("inf")
        if raised == level:
            break
        level = raised
    target = F.least(F.col("cap").cast("double"), F.col("weight") * F.lit(level)) if total else F.lit(0.0)
    return cut_lineage(ranked.select("source", "source_rank", "source_size", target.alias("target")))


def schedule(targets: DataFrame, block_tokens: int) -> DataFrame:
    """source_rank, block, slot: which block of which source each slot takes, without gaps per source."""
    quota = F.round("target").cast("long")
    live = targets.where(quota > 0).select("source_rank", quota.alias("quota"))
    total, sources = live.agg(F.coalesce(F.sum("quota"), F.lit(0)), F.count(F.lit(1))).first()
    slots = max(ceil(total / block_tokens), sources)
    chunk = isqrt(max(1, sources)) + 1
    summed = running_total(live.withColumn("_chunk", F.floor(F.col("source_rank") / chunk)).withColumn("_all", F.lit(0)),
                           ["_all"], "_chunk", ["source_rank"], "quota", "_from")
    scale = F.lit(2 ** POINT_BITS).cast("decimal(38,0)")
    point = lambda c: F.floor(F.col(c).cast("decimal(20,0)") * scale / F.lit(max(1, total)).cast("decimal(20,0)")).cast("long")
    bounds = summed.withColumn("_to", F.col("_from") + F.col("quota")).select("source_rank", point("_from").alias("low"), point("_to").alias("high"))
    shift = POINT_BITS - max(12, sources.bit_length() + 2)
    cells = bounds.select("*", F.explode(F.sequence(F.shiftright("low", shift), F.shiftright(F.greatest(F.col("high") - 1, F.col("low")), shift))).alias("cell"))
    spark = targets.sparkSession
    points = spark.range(slots).select(F.col("id").alias("slot"), (((F.col("id") + 1).cast("decimal(19,0)") * F.lit(GOLDEN).cast("decimal(16,0)"))
                                                                  % F.lit(2 ** POINT_BITS).cast("decimal(16,0)")).cast("long").alias("point"))
    points = points.withColumn("cell", F.shiftright("point", shift))
    hit = points.join(cells, "cell").where("point >= low and point < high").select("slot", "source_rank")
    # A source too small for a point of its own gets the slot after the last.
    missed = live.join(hit.select("source_rank").distinct(), "source_rank", "left_anti").select((F.lit(slots) + F.col("source_rank")).alias("slot"), "source_rank")
    dealt = cut_lineage(hit.unionByName(missed))
    dealt = dealt.withColumn("_chunk", F.floor(F.col("slot") / max(64, isqrt(slots)))).withColumn("_one", F.lit(1).cast("long"))
    return running_total(dealt, ["source_rank"], "_chunk", ["slot"], "_one", "block").select("source_rank", "block", "slot")


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: tuple[int, int] = (3, 2), max_passes: int = 2,
        block_tokens: int = 512, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """The mix as pieces, and the documents it was cut from.

    Pieces: source_rank, block, slot, start, doc_from, n_tokens - in slot order
    these are the training stream; ``doc_from`` counts words inside the
    document.  Documents: doc_id, row, source, size, source_rank, source_size,
    target, start; (source_rank, start) names a document that has words, row
    is a hash of all that was given.

    Defined cases: null or blank texts have size 0 and are never taken.  Null
    is a source of its own, after all others.  Repeated rows are rows of
    their own.  Without any words every target is 0.  Order among rows
    follows a hash of the id, then id and size, so reruns agree.
    """
    rows = as_columns(docs, doc_id="long", source="string", text="string").select(
        "doc_id", "source", F.xxhash64("doc_id", "source", "text").alias("row"), word_count(F.col("text")).alias("size"))
    rows = cut_lineage(rows)
    targets = source_targets(rows, weights, share, max_passes)
    many = isqrt(max(1, rows.count())) + 1
    keyed = rows.join(targets, rows["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    keyed = keyed.withColumn("_hash", F.xxhash64("doc_id", F.lit(seed))).withColumn("_chunk", F.pmod("_hash", F.lit(many)))
    order = [F.col("_hash"), F.col("doc_id"), F.col("size")]
    placed = running_total(keyed, ["source_rank"], "_chunk", order, "size", "start")
    placed = cut_lineage(placed.select("doc_id", "row", "source", "size", "source_rank", "source_size", "target", "start"))
    slots = cut_lineage(schedule(targets, block_tokens))
    counts = slots.groupBy("source_rank").agg(F.count(F.lit(1)).alias("blocks"))
    cut = placed.where("size > 0 and round(target) > 0").join(counts, "source_rank").withColumn("quota", F.round("target").cast("long"))
    cut = cut.withColumn("short", F.floor(F.col("quota") / F.col("blocks"))).withColumn("long_ones", F.col("quota") % F.col("blocks"))
    passes = cut.select("*", F.explode(F.sequence(F.lit(0), F.lit(max_passes - 1))).alias("turn"))
    passes = passes.withColumn("low", F.col("start") + F.col("turn") * F.col("source_size"))
    passes = passes.withColumn("high", F.least(F.col("low") + F.col("size"), F.col("quota"))).where("low < high")
    edge = F.col("long_ones") * (F.col("short") + 1)
    block_at = lambda p: F.when(p < edge, F.floor(p / (F.col("short") + 1))).otherwise(F.col("long_ones") + F.floor((p - edge) / F.greatest(F.col("short"), F.lit(1))))
    begin_of = lambda b: b * F.col("short") + F.least(b, F.col("long_ones"))
    pieces = passes.select("*", F.explode(F.sequence(block_at(F.col("low")), block_at(F.col("high") - 1))).alias("block"))
    first = F.greatest(begin_of(F.col("block")), F.col("low"))
    last = F.least(begin_of(F.col("block") + 1), F.col("high"))
    pieces = pieces.select("source_rank", "block", "start", (first - F.col("low")).alias("doc_from"), (last - first).alias("n_tokens"))
    taken = pieces.where("n_tokens > 0").join(slots, ["source_rank", "block"])
    return taken, placed


def taken_words(docs: DataFrame, **options) -> DataFrame:
    """doc_id, row, size, source, source_size, target, taken: what ``mix`` takes of each document."""
    pieces, placed = mix(docs, **options)
    # A row with words is known by its place in the source's stream.
    sums = pieces.groupBy("source_rank", "start").agg(F.sum("n_tokens").alias("got"))
    some = placed.where("size > 0").join(sums, ["source_rank", "start"], "left").withColumn("taken", F.coalesce("got", F.lit(0)))
    none = placed.where("size = 0").withColumn("taken", F.lit(0).cast("long"))
    return some.unionByName(none, allowMissingColumns=True).select("doc_id", "row", "size", "source", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, to the nearest whole document.

    Documents without words are never taken, nor is one of which less than
    half is.  Rows that are alike share what they are taken together.
    """
    takes = taken_words(docs, **options).where("taken > 0").groupBy("row").agg(F.round(F.sum("taken") / F.sum("size")).cast("int").alias("_times"))
    named = docs.withColumn("_row", F.xxhash64(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("string")))
    met = named.join(takes.where("_times > 0").withColumnRenamed("row", "_row"), "_row")
    return met.withColumn("_turn", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(*docs.columns)
