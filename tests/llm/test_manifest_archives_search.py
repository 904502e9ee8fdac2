"""Manifest, archives and lexical search against brute force on small odd tables."""
import gzip
import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from msgsieve.llm import lexical, merkle, queries, warc

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
CLASH = ["grp", "key", "leaf", "presented", "n", "terms", "counts", "row", "item", "score", "rank", "kind", "payload", "name", "content", "idx", "size", "path"]


def with_clash(df):
    return df.withColumns({c: F.lit("clash") for c in CLASH})


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# 11


def brute_tree(leaves, width):
    """(root, [proof as (before, after) per level] of each leaf)"""
    proofs, level, at = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(level) > 1:
        runs = [level[i:i + width] for i in range(0, len(level), width)]
        for leaf, i in enumerate(at):
            run, j = runs[i // width], i % width
            proofs[leaf].append((run[:j], run[j + 1:]))
        level, at = [sha(*run) for run in runs], [i // width for i in at]
    return level[0], proofs


def brute_audit(rows, width):
    groups = {}
    for grp, key, leaf, presented in rows:
        groups.setdefault(grp, []).append((key, leaf, presented))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: (rows_, brute_tree([x[1] for x in rows_], width)) for g in names for rows_ in [sorted(groups[g], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))]}
    root, upper = brute_tree([trees[g][1][0] for g in names], width)
    out = []
    for g, above in zip(names, upper):
        rows_, (subroot, proofs) = trees[g]
        for (key, leaf, presented), proof in zip(rows_, proofs):
            folded = presented or leaf
            for before, after in proof + above:
                folded = sha(*before, folded, *after)
            out.append((key, g, leaf, subroot, root, sha(*[x for b, a in proof + above for x in (*b, *a)]), folded, folded == root))
    return sorted(out, key=repr)


@pytest.mark.parametrize("width, block, levels", [(2, 4, 1), (2, 1 << 13, 10), (3, 5, 2), (5, 3, 10)])
def test_audit_equals_brute_force(spark, monkeypatch, width, block, levels):
    monkeypatch.setattr(merkle, "BLOCK", block)
    monkeypatch.setattr(merkle, "LEVELS", levels)
    r = random.Random(width * 100 + block)
    rows = [("en", i * 2, sha(str(i)), sha("other") if i % 7 == 0 else None) for i in range(101)]
    rows += [(g, r.randrange(50), sha(str(g), str(i)), None) for i in range(40) for g in (None, "", "é", "z")]
    rows += [("one", 1, sha("x"), sha("y")), ("en", None, sha("null key"), None), ("en", 4, sha("2"), None), ("en", 4, sha("2"), None), ("same", 3, sha("s"), sha("s"))]
    table = spark.createDataFrame(rows, "grp string, key long, leaf string, presented string").repartition(5)
    found = merkle.audit(table.withColumns({c: F.lit("clash") for c in ("n", "idx", "size", "path", "row", "number", "part")}), width)
    got = sorted(map(tuple, found.select("key", "grp", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=repr)
    assert got == brute_audit(rows, width)
    assert {x[0] for x in got if not x[7]} == {1, *range(0, 202, 14)}


def test_audit_of_an_empty_table(spark):
    rows = spark.createDataFrame([], "grp string, key long, leaf string, presented string")
    assert merkle.audit(rows).collect() == []


@pytest.mark.parametrize("size", [1, 2, 3, 7, 8, 9, 31, 64])
@pytest.mark.parametrize("width", [2, 3])
def test_multiproof_is_minimal(size, width):
    """With the missing nodes every proof can be made; none of them can be derived from the leaves and the others."""
    leaves = [sha(str(i)).encode() for i in range(size)]
    whole, root = merkle.derive_interior(leaves, 0, size, width, {})
    node = {(level, first + i): x for level, (first, nodes) in enumerate(whole) for i, x in enumerate(nodes)}
    for a in range(size):
        for b in range(a + 1, size + 1):
            asked = list(merkle.missing_nodes(a, b - a, size, width))
            assert len(asked) == len(set(asked)) and len(asked) <= 2 * (width - 1) * len(whole)
            levels, found = merkle.derive_interior(leaves[a:b], a, size, width, {x: node[x] for x in asked})
            assert found == root
            for i in range(a, b):
                assert merkle.fold(leaves[i], merkle.expand_path(levels, i, width)) == root
            for level, i in asked:
                below = range(i * width ** level, min((i + 1) * width ** level, size))
                assert not set(below) & set(range(a, b))
            top = list(merkle.frontier(leaves[a:b], a, size, width))
            assert all(x == (node | {(len(whole), 0): root})[level, i] for level, i, x, _ in top)


def test_leaf_digest_of_nulls_bytes_and_large_numbers(spark):
    rows = [(1, None, "ö", 2 ** 63 - 1, ""), (None, "s", None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    got = [x[0] for x in df.select(merkle.leaf_digest(*map(F.col, df.columns))).collect()]
    assert got == [sha("1:1", "-", "2:ö", f"19:{2 ** 63 - 1}", "0:"), sha("-", "1:s", "-", "-", "-")]


def test_manifest_query_on_odd_documents(spark, tmp_path):
    rows = [(i, "t" * i, "en" if i % 3 else None, "s", i if i % 5 else None) for i in range(60)] + [(None, None, None, None, None), (7, "x" * 300_000, "en", "s", 2 ** 63 - 1)]
    with_clash(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.QUERIES["op11_merkle_manifest"](spark, str(tmp_path)).collect()
    assert len(found) == len(rows) and len({x["root"] for x in found}) == 1
    changed = {i for i, _, _, _, n in rows if i is not None and n is not None and zlib.crc32(str(i).encode()) % 7 == 0}
    assert {x["doc_id"] for x in found if not x["verified"]} == changed and changed


# 12


def test_arc_lines_of_both_versions():
    """Declared lengths decide, whatever a payload looks like."""
    trap = b"HTTP/1.1 200 OK\r\n\r\n\nhttp://x.org/ 1.1.1.1 20200101000000 text/html 5\nWARC/1.1\r\n\r\n"
    for version in (1, 2):
        data = warc.arc_version_block("a.arc", version, "19970101000000")
        for url in ("http://a.org/", "http://b.org/x"):
            data += warc.arc_record("a.arc", version, len(data), url, "19970203", "text/html", trap)
        first, *rest = warc.arc_records(data)
        assert first.fields["URL"] == "filedesc://a.arc" and first.content.startswith(b"%d 0 " % version)
        assert [x.fields["URL"] for x in rest] == ["http://a.org/", "http://b.org/x"] and all(x.content == trap for x in rest)
        assert all(data[x.offset:].startswith(x.fields["URL"].encode()) for x in rest)
        if version == 2:
            assert all(x.fields["Result-code"] == "200" and x.fields["Offset"] == str(x.offset) for x in rest)
    with pytest.raises(ValueError):
        list(warc.arc_records(data[:-20]))
    with pytest.raises(ValueError):
        list(warc.arc_records(data.replace(b" 200 - -", b" 200 -", 2)))
    assert warc.warc_date("19970203") == "1997-02-03T00:00:00Z" and warc.warc_date("20200102030405") == "2020-01-02T03:04:05Z"


def page_rows():
    copy = "<p>" + "ä" * 60
    return [(5, "http://a", copy), (3, "http://b/x y\n", copy), (4, None, copy), (9, "u", "short"), (8, "u", "short"), (1, "u", None), (2, "u", ""), (None, "n", copy),
            (7, "u", "x" * 99), (10, "u", "x" * 99), (11, "u", "y" * 100), (12, "u", "y" * 100), (12, "u", "y" * 100), (20, "u", "WARC/1.1\r\n\r\n\r\n\r\nWARC-Type: x" * 40),
            (21, "u", "z" * 3_000_000), (22, "u", "\x00\r\n\r\n\n" * 30)]


def brute_pages(rows):
    firsts = {}
    for i, _, html in rows:
        firsts.setdefault(html or "", []).append(i)
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        same = firsts[html or ""]
        first = min((x for x in same if x is not None), default=None)
        revisit = len(data) >= 100 and len(same) > 1 and (i != first or same.count(i) > 1)
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), revisit, first))
    return out


def test_pages_through_archives(spark):
    rows = page_rows()
    pages = with_clash(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3))
    got = sorted(map(tuple, warc.convert_pages(pages, archive_bytes=400).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr)
    assert len(got) == len(rows)
    twelve = [x for x in got if x[0] == 12]
    assert all(x[3:] == ("revisit", 11) for x in twelve) and len(twelve) == 2
    want = [(i, n, d, "revisit" if r else "response", f if r else None) for i, n, d, r, f in brute_pages(rows)]
    assert got == sorted([x if x[0] != 12 else (*x[:3], "revisit", 11) for x in want], key=repr)


def test_rows_repeated_with_one_id_have_one_response(spark):
    pages = spark.createDataFrame([(4, "u", "q" * 200)] * 3, "page_id long, url string, html string").repartition(2)
    got = warc.convert_pages(pages).collect()
    assert sorted((x["record_type"], x["refers_to"]) for x in got if x["record_type"] == "revisit") == [("revisit", 4)] * 2
    assert len({x["record_id"] for x in got}) == 3


def test_no_pages_no_archives(spark):
    assert warc.convert_pages(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_records_of_other_kinds(spark, tmp_path):
    """Records that hold no HTTP message become resources; files are whole WARC archives."""
    data = warc.arc_version_block("d.arc", 1, "20000101000000")
    data += warc.arc_record("d.arc", 1, len(data), "dns:a.org", "20000101000000", "text/dns", b"20000101\na.org. 60 IN A 1.1.1.1")
    data += warc.arc_record("d.arc", 1, len(data), "http://a.org/", "20000101000000", "text/html", b"HTTP/1.0 200 OK\r\nContent-Length: 2\r\n\r\nhi")
    records = warc.parsed_archives(spark.createDataFrame([("d.arc", bytearray(data))], "name string, content binary"))
    assert [(x["kind"], x["payload_bytes"]) for x in records.collect()] == [("warcinfo", records.collect()[0]["payload_bytes"]), ("resource", 31), ("response", 2)]
    path = f"{tmp_path}/warc"
    warc.write_warc(records, warc.first_of_equals(records), path)
    found = [x for f in tmp_path.glob("warc/*.gz") for x in warc.warc_records(gzip.decompress(f.read_bytes()))]
    assert sorted(h["warc-type"] for h, _ in found) == ["resource", "response", "warcinfo"]
    assert all(h["warc-date"] == "2000-01-01T00:00:00Z" and h["warc-record-id"].startswith("<urn:uuid:") for h, _ in found)
    with pytest.raises(ValueError):
        list(warc.warc_records(gzip.decompress(next(tmp_path.glob("warc/*.gz")).read_bytes()).replace(b"hi", b"ho")))


# 13


def terms_of(text):
    return TERM.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))


def brute_ranks(docs, items, k):
    bags = [(i, terms_of(t)) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n, length = len(bags), sum(len(b) for _, b in bags)
    df = {}
    for _, bag in bags:
        for t in set(bag):
            df[t] = df.get(t, 0) + 1
    out = []
    for item, text in items:
        scored = []
        for i, bag in bags:
            m = 10 + 90 * len(bag) * n // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * bag.count(t) // (1000 * bag.count(t) + 8 * m)) for t in set(terms_of(text)) if t in df)
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, rank, x[3], -x[0]) for rank, x in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("block, item_terms", [(2048, 1 << 20), (16, 40)])
def test_ranks_equal_brute_force(spark, monkeypatch, block, item_terms):
    monkeypatch.setattr(lexical, "BLOCK", block)
    r = random.Random(block)
    words = [f"{a}{b}" for a in "abcdefghij" for b in ("lo", "MI", "tü", "9", "ßx", "ra", "q", "ww")]
    weights = [1 / (i + 1) for i in range(len(words))]
    docs = [(i * 3, r.choice([" ", ", ", "-"]).join(r.choices(words, weights, k=r.randint(1, 80)))) for i in range(300)]
    docs += [(2000 + i, "same text here") for i in range(30)] + [(5, None), (6, ""), (7, "., !"), (None, "same text here"), (2000, "same text here"), (8, "lo " * 40_000)]
    items = [(i, " ".join(r.choices(words, k=r.randint(1, 12)))) for i in range(25)] + [(90, None), (91, "?!"), (92, "TEXT here"), (93, "unknown"), (94, " ".join(words)), (94, "same same"), (95, "Text text HERE same lo")]
    got = lexical.rank_documents(with_clash(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)), with_clash(spark.createDataFrame(items, "item_id long, text string")), 10, item_terms)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_ranks(docs, items, 10)
    assert len(set(terms_of(items[29][1]))) > 64


def test_search_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.rank_documents(docs.where("false"), items).collect() == []
    assert lexical.rank_documents(docs, items.where("false")).collect() == []
    assert [tuple(x)[:3] for x in lexical.rank_documents(docs, items).collect()] == [(1, 1, 1)]


def test_search_stops_early():
    """Once k documents stand, masks that cannot reach them are not scored."""
    vocabulary = [f"t{i}" for i in range(6)]
    bags = [(1, "t0 t1 t2 t3 t4 t5")] * 10 + [(i, "t0") for i in range(2, 500)]
    hashes = sorted(range(6))
    items = lexical.Items(*map(lexical.np.array, ([10, 20, 30, 40, 50, 60], [1000] * 6, [0, 6], hashes)), documents=len(bags), length=1000)
    terms = lexical.np.array([10 * (int(w[1]) + 1) for _, b in bags for w in b.split()], lexical.np.uint64)
    owner = lexical.np.array([d for d, (_, b) in enumerate(bags) for _ in b.split()])
    items = items._replace(vocabulary=items.vocabulary.astype(lexical.np.uint64))
    offered = []

    class Counted(lexical.Best):
        def add(self, scores, ids):
            offered.append(len(ids))
            super().add(scores, ids)

    best = [Counted(10)]
    sizes = lexical.np.array([len(b.split()) for _, b in bags])
    for _ in range(3):
        lexical.search_block(items, best, lexical.np.array([i for i, _ in bags]), sizes, terms, lexical.np.ones(len(terms), lexical.np.int64), owner)
    assert len(best[0].ids) == 10 and offered[1:] == [10, 10] and len(vocabulary) == 6
