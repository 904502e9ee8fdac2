"""Snapshots rewritten piece by piece: which pieces move, lost and late writers, growth, odd keys."""
import pytest
from pyspark.sql import functions as F

from msgsieve.operators import keyed as k, snapshots as sn


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def numbers(spark, n):
    return spark.range(n).select(F.format_string("+1%010d", "id").alias("e164"), (F.col("id") % 7 / 7).alias("risk"))


def change(spark, *pairs):
    return spark.createDataFrame([(a, b, n) for n, (a, b) in enumerate(pairs)], "e164 string, risk double, seq long")


def test_one_key_moves_one_piece(spark, tmp_path):
    path = str(tmp_path / "s")
    old = numbers(spark, 4000)
    sn.create(old, path, ["e164"], max_rows=300)
    before = {(r.depth, r.prefix): r.folder for r in sn.manifest_rows(spark, path).collect()}
    assert len(before) == 16 and sum(r.rows for r in sn.manifest_rows(spark, path).collect()) == 4000
    assert sn.rewrite(spark, path, change(spark, ("+10000000017", 0.99)), k.upsert_numbers) == 2
    after = {(r.depth, r.prefix): r.folder for r in sn.manifest_rows(spark, path).collect()}
    assert sum(after[p] != before[p] for p in before) == 1 and set(after) == set(before)
    want = old.withColumn("risk", F.when(F.col("e164") == "+10000000017", 0.99).otherwise(F.col("risk")))
    assert rows(sn.read(spark, path)) == rows(want)
    assert rows(sn.read(spark, path, version=1)) == rows(old)


def test_lost_writer_leaves_the_old_version(spark, tmp_path):
    path = str(tmp_path / "s")
    old = numbers(spark, 500)
    sn.create(old, path, ["e164"], max_rows=100)

    def broken(a, b):
        return k.upsert_numbers(a, b).withColumn("risk", F.when(F.col("e164") == "+10000000017", F.raise_error(F.lit("lost")).cast("double")).otherwise(F.col("risk")))

    with pytest.raises(Exception, match="lost"):
        sn.rewrite(spark, path, change(spark, ("+10000000017", 0.5)), broken)
    assert sn.versions(spark, path) == [1] and rows(sn.read(spark, path)) == rows(old)
    # A writer that was lost between its files and its pointer.
    (tmp_path / "s" / "versions" / "_aside").write_text("{")
    assert sn.rewrite(spark, path, change(spark, ("new", 0.5)), k.upsert_numbers) == 2
    assert sn.read(spark, path).count() == 501


def test_later_of_two_writers_is_refused(spark, tmp_path):
    path = str(tmp_path / "s")
    sn.create(numbers(spark, 50), path, ["e164"])

    def slow(a, b):
        sn.rewrite(spark, path, change(spark, ("first", 0.1)), k.upsert_numbers)
        return k.upsert_numbers(a, b)

    with pytest.raises(sn.SnapshotConflict):
        sn.rewrite(spark, path, change(spark, ("second", 0.2)), slow)
    assert rows(sn.read(spark, path).where("e164 in ('first', 'second')")) == [("first", 0.1)]
    with pytest.raises(sn.SnapshotConflict):
        sn.create(numbers(spark, 5), path, ["e164"])


def test_pieces_split_as_they_grow_and_never_overlap(spark, tmp_path):
    path = str(tmp_path / "s")
    sn.create(numbers(spark, 3), path, ["e164"], max_rows=50)
    model = {r.e164: r.risk for r in numbers(spark, 3).collect()}
    for start, size in [(0, 2), (2, 400), (402, 90), (100, 30)]:
        pairs = [(f"+1{n:010d}", 0.5 + n / 1e6) for n in range(start, start + size)]
        sn.rewrite(spark, path, change(spark, *pairs), k.upsert_numbers)
        model |= dict(pairs)
        assert dict(rows(sn.read(spark, path))) == model and sn.read(spark, path).count() == len(model)
        held = [(r.prefix << (64 - r.depth), (r.prefix + 1) << (64 - r.depth)) for r in sn.manifest_rows(spark, path).collect()]
        assert all(a[1] <= b[0] for a, b in zip(sorted(held), sorted(held)[1:]))
    assert max(r.rows for r in sn.manifest_rows(spark, path).collect()) < 200


def test_odd_keys_empty_snapshot_and_empty_changes(spark, tmp_path):
    path = str(tmp_path / "s")
    schema = "account_sub string, sender_pattern string, match_type string"
    sn.create(spark.createDataFrame([], schema), path, ["account_sub", "sender_pattern"], max_rows=2)
    assert rows(sn.read(spark, path)) == []
    new = spark.createDataFrame([("a", None, "x", 1), (None, "a", "y", 1), (None, None, "z", 1), ("", "", "e", 1)], schema + ", seq long")
    sn.rewrite(spark, path, new, k.upsert_safe_senders)
    assert rows(sn.read(spark, path)) == rows(new.drop("seq"))
    sn.rewrite(spark, path, new.withColumn("match_type", F.lit("later")), k.upsert_safe_senders)
    assert rows(sn.read(spark, path)) == rows(new.drop("seq").withColumn("match_type", F.lit("later")))
    assert sn.rewrite(spark, path, new.limit(0), k.upsert_safe_senders) == 4
    assert rows(sn.manifest_rows(spark, path, 4)) == rows(sn.manifest_rows(spark, path, 3))
    with pytest.raises(ValueError, match="no version"):
        sn.read(spark, path, version=9)
