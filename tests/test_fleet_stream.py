"""Exact reporters of closed windows over several micro-batches."""
from datetime import datetime, timedelta, timezone

from msgsieve.streaming import flow

DAY = timedelta(days=1)
START = datetime(2024, 1, 1, 6, tzinfo=timezone.utc)
SCHEMA = "created_at timestamp, sender_key string, account_sub string, expected boolean"


def test_reporters_over_batches(spark, tmp_path):
    def report(day, key, who, expected=False):
        return START + day * DAY, key, who, expected

    batches = [
        [report(0, "k", "a"), report(0, "k", "a"), report(1, "k", "b"), report(1, "k", "c", True), report(1, None, "a"), report(1, "k", None), report(1, "k", "d", None)],
        [report(2, "k", "a"), report(2, "m", "a"), report(1, "k", "b")],
        [report(40, "k", "z")],
        [report(41, "k", "z")],  # this batch closes and writes the windows up to day 39
        [report(1, "k", "late"), report(80, "m", "z")],
    ]
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = flow.file_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], SCHEMA).schema, glob="*.parquet", files_per_trigger=1)
    out = flow.stream_fleet_counts(stream)
    flow.append_available(out, str(tmp_path / "out"), str(tmp_path / "ckpt"))
    got = {((r.window_end.replace(tzinfo=timezone.utc) - datetime(2024, 1, 1, tzinfo=timezone.utc)).days, r.sender_key): r.reporters
           for r in spark.read.schema(out.schema).parquet(str(tmp_path / "out")).collect()}

    def expected(end):
        found = {}
        for rows in batches[:4] + [batches[4][1:]]:  # the late report meets closed windows only
            for at, key, who, known in rows:
                day = (at - START).days
                if known is False and key and who and end - 30 <= day < end:
                    found.setdefault((end, key), set()).add(who)
        return {k: len(v) for k, v in found.items()}

    want = {}
    for end in range(1, 80):
        want |= expected(end)
    assert got == want
    assert got[31, "k"] == 2 and got[1, "k"] == 1 and got[41, "k"] == 1
