"""Tables read as streams, be they one file or a folder of parts."""
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from msgsieve.catalog import registry, streams_queries

ROWS = [(k, f"urgent wire transfer {k}", "en", f"s{k % 2}", 20) for k in range(6)]


def _write(spark, tmp_path, parts):
    table = pa.table({n: [r[c] for r in ROWS] for c, n in enumerate(("doc_id", "text", "lang", "source", "n_chars"))})
    if parts:
        (tmp_path / "documents.parquet").mkdir()
        for p in range(2):
            pq.write_table(table.slice(3 * p, 3), tmp_path / "documents.parquet" / f"part-{p}.parquet")
    else:
        pq.write_table(table, tmp_path / "documents.parquet")
    pq.write_table(table, tmp_path / "labels.parquet")  # a neighbour that is no part of the stream
    return registry.Inputs(spark, str(tmp_path))


@pytest.mark.parametrize("parts", [False, True])
def test_stream_of_a_table(spark, tmp_path, parts):
    i = _write(spark, tmp_path, parts)
    got = streams_queries.appended(i, streams_queries.document_stream(i), "copy").collect()
    assert sorted(r.doc_id for r in got) == list(range(6))


def test_profiles_of_a_folder(spark, tmp_path):
    got = registry.QUERIES["R11_stream_profiles"](_write(spark, tmp_path, True)).collect()
    assert sorted((r.email, r.email_count) for r in got) == [("s0", 3), ("s1", 3)]
