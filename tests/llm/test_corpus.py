"""Corpus operators against brute force, on small random corpora with odd rows."""
import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from msgsieve.llm import ngram_join, queries, suffix_index
from msgsieve.llm.chat import preference_turns, repeated_reply_pairs
from msgsieve.llm.decontaminate import benchmark_matches, clean_documents, contaminated_documents
from msgsieve.llm.exact_dedup import exact_duplicates
from msgsieve.llm.html_blocks import LABELLED, article_tree, extract_pages, is_article, main_text
from msgsieve.llm.mixing import mix, mixed_documents, taken_words
from msgsieve.llm.ngram_join import keep_one_of_each, ngram_groups
from msgsieve.llm.substring_dedup import drop_repeated_words, longest_repeats
from msgsieve.llm.token_store import open_codes, pack_codes, read_store, token_at, unpack_codes, write_store
from msgsieve.llm.toxicity import drop_toxic, fit_toxicity, score_toxicity

SF = "/root/testdata/sf0.001"
CLASH = ["n", "hash", "size", "target", "score", "row", "mark", "part", "start", "cls", "comp", "keep_id", "tie", "slot", "_row", "_mark"]
WORD = re.compile(r"[^\x20\x09-\x0d]+")
WORDS = [f"{a}{b}" for a in "abcdefgh" for b in ("lo", "mi", "Ra", "tü", "x.")]


def fold(text):
    return text.translate({i: i + 32 for i in range(65, 91)})


def corpus(spark, rows):
    """Documents with every operator's internal names as further columns."""
    full = [(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows]
    df = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit("clash") for c in CLASH})


def some_rows(seed, n=60, words=60):
    """Random texts with copies, near copies, shared passages, nulls, blanks, short and long texts."""
    r = random.Random(seed)
    passage = [r.choice(WORDS) for _ in range(30)]
    rows = []
    for i in range(n):
        text = [r.choice(WORDS) for _ in range(r.randint(1, words))]
        if i % 7 == 3:
            at = r.randint(0, len(text))
            text[at:at] = passage
        if i % 5 == 4 and rows and rows[-1][1]:
            text = rows[-1][1].split()
            if i % 2 and len(text) > 1:
                text[r.randrange(len(text))] = r.choice(WORDS)
        rows.append((i * 3, r.choice([" ", "\n", "\t "]).join(text), r.choice(["a", "b", "Ö", None])))
    long = " ".join(r.choice(WORDS) for _ in range(6000))
    return [*rows, (1000, None, "a"), (1001, "", "b"), (1002, " \n\t", None), (1003, long, "a"), (1004, long + " end", "hot"), (1005, "ONE two", "b"), (1006, "one TWO", "b")]


def collect(df):
    return sorted(map(tuple, df.collect()), key=repr)


# 1


def toxic_corpus():
    r = random.Random(5)
    rows, labels = [], []
    for i in range(400):
        text = [r.choice(WORDS) + r.choice("pqrst") for _ in range(r.randint(5, 80))]
        bad = i % 4 == 0
        for _ in range(r.randint(2, 4) if bad else 0):
            text[r.randrange(len(text))] = r.choice(["Vile,", "foul", "NASTY."])
        rows.append((i, " ".join(text), "a"))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_toxicity_learns_and_leaves_odd_rows_alone(spark):
    rows, labels = toxic_corpus()
    docs = corpus(spark, [*rows, (9000, None, None), (9001, "", "a"), (9001, "", "a"), (None, "foul vile nasty", "a"), (9002, "foul " * 30000, "a")])
    known = spark.createDataFrame([x for x in labels if x[0] % 3] + [(None, 1, 1), (7, 1, None)], "doc_id long, quality int, toxic int").withColumn("order", F.lit("clash"))
    model = fit_toxicity(docs, known)
    assert 0 < len(model.index) < 500
    scored = score_toxicity(docs, model).collect()
    assert len(scored) == len(rows) + 5 and all(0 <= x["score"] <= 1 for x in scored)
    got = {x["doc_id"]: x["score"] >= 0.7 for x in scored}
    held = [x for x in labels if x[0] % 3 == 0]
    assert sum(got[i] == bool(t) for i, _, t in held) / len(held) > 0.97
    assert got[None] and got[9002] and not got[9000] and not got[9001]
    kept = drop_toxic(docs, model)
    assert kept.columns == docs.columns and {x[0] for x in kept.select("doc_id").collect()} == {i for i, t in got.items() if not t}


def test_toxicity_without_labels(spark):
    docs = corpus(spark, [(1, "a b", "s"), (2, None, "s")])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(x["score"] < 1e-9 for x in score_toxicity(docs, fit_toxicity(docs, labels)).collect())
    assert score_toxicity(docs.where("false"), fit_toxicity(docs, labels)).count() == 0


# 2


def shingles(text, size):
    words = WORD.findall(fold(text or ""))
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + size]) for i in range(len(words) - size + 1)}


def brute_groups(rows, size, percent):
    sets = [shingles(t, size) for _, t, _ in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    low = {}
    for i, row in enumerate(rows):
        low[find(i)] = min(low.get(find(i), row[0]), row[0])
    return [(row[0], len(sets[i]), low[find(i)]) for i, row in enumerate(rows)]


@pytest.mark.parametrize("size, percent, seed", [(4, 85, 1), (2, 50, 2), (5, 80, 3)])
def test_ngram_groups(spark, size, percent, seed):
    rows = some_rows(seed, 80)
    chain = [r.split() for r in [" ".join(random.Random(seed).choices(WORDS, k=60))] * 6]
    for k, words in enumerate(chain):
        words[:3 * k] = [f"z{k}{i}" for i in range(3 * k)]
        rows.append((2000 + k, " ".join(words), "a"))
    rows.append(rows[0])
    got = collect(ngram_groups(corpus(spark, rows), size, percent))
    assert got == sorted(brute_groups(rows, size, percent), key=repr)


def test_ngram_join_keeps_one(spark):
    rows = some_rows(4, 50)
    docs = corpus(spark, [*rows, rows[5], rows[5], (None, "no id here at all", "a")])
    kept = keep_one_of_each(docs)
    assert kept.columns == docs.columns
    want = Counter(i for i, _, c in brute_groups(rows, 5, 80) if i == c) + Counter([None])
    assert Counter(x[0] for x in kept.select("doc_id").collect()) == want
    assert ngram_groups(docs.where("false")).count() == 0 and keep_one_of_each(docs.where("false")).count() == 0


# 3


def turns(spark, rows):
    return spark.createDataFrame(rows, "pair_id long, turn long, role string, text string").withColumns({c: F.lit("clash") for c in CLASH})


def test_preference_turns(spark):
    same = [(1, 0, "user", "hi"), (1, 1, "assistant", "hello")]
    chosen = [*same, (1, 2, "user", "x"), (1, 3, "assistant", "good"), (2, 0, "user", None), (3, 0, "user", "only here"), (None, 0, "user", "lost"), (1, 1, "assistant", "hello")]
    rejected = [*same, (1, 2, "user", "x"), (1, 3, "assistant", "bad"), (1, 4, None, "more"), (2, 0, "user", "")]
    got = collect(preference_turns(turns(spark, chosen), turns(spark, rejected)))
    say = lambda role, text: f"<|{role}|>\n{text}<|end|>\n"
    assert got == sorted([
        (1, "prompt", 0, say("user", "hi"), False), (1, "prompt", 1, say("assistant", "hello"), False), (1, "prompt", 2, say("user", "x"), False),
        (1, "chosen", 3, say("assistant", "good"), True), (1, "rejected", 3, say("assistant", "bad"), True), (1, "rejected", 4, say("user", "more"), False),
        (2, "prompt", 0, say("user", ""), False)], key=repr)
    empty = turns(spark, [])
    assert preference_turns(empty, empty).count() == 0
    one = turns(spark, [(1, 0, "assistant", "a")]).withColumnRenamed("pair_id", "conv_id")
    assert all(x.count() == 0 for x in repeated_reply_pairs(one))


# 4


def test_mix(spark):
    rows = some_rows(6, 200)
    rows += [(5000 + i, " ".join(["w"] * 40), "hot") for i in range(120)] + [(5000, " ".join(["w"] * 40), "hot")]
    docs = corpus(spark, rows)
    got = taken_words(docs, block_tokens=64).select("doc_id", "size", "source", "source_size", "target", "taken")
    first = collect(got)
    assert first == collect(taken_words(docs.repartition(7), block_tokens=64).select(*got.columns))
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    left, open_, aim = 1.5 * sum(sizes.values()), set(order), {}
    while True:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > 2 * sizes[s]}
        aim |= {s: weight[s] * level for s in open_ - full} | {s: 2 * sizes[s] for s in full}
        left, open_ = left - sum(2 * sizes[s] for s in full), open_ - full
        if not full:
            break
    took = Counter()
    for _, size, source, source_size, target, taken in first:
        assert source_size == sizes[source] and math.isclose(target, aim[source], rel_tol=1e-9) and 0 <= taken <= 2 * size
        took[source] += taken
    assert all(abs(took[s] - aim[s]) <= 1 for s in order) and len(first) == len(rows)
    pieces, _ = mix(docs, block_tokens=64)
    blocks = pieces.groupBy("source_rank", "block").agg(F.sum("n_tokens").alias("n")).groupBy("source_rank").agg(F.max("n") - F.min("n")).collect()
    assert all(x[1] <= 1 for x in blocks)
    slots = [x[0] for x in pieces.select("slot").distinct().collect()]
    assert len(slots) == len(set(slots)) and pieces.select("source_rank", "block").distinct().count() == len(slots)


def test_mix_of_nothing(spark):
    assert collect(taken_words(corpus(spark, [(1, None, None), (2, " ", "a")])).select("doc_id", "target", "taken")) == [(1, 0.0, 0), (2, 0.0, 0)]
    assert taken_words(corpus(spark, []).where("false")).count() == 0
    docs = corpus(spark, [(1, "a b c d", "x"), (2, "a b", None), (3, None, "x")])
    assert mixed_documents(docs).columns == docs.columns


# 5


@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize("collide", [False, True])
def test_exact_duplicates(spark, keep, collide):
    rows = [*some_rows(7), (None, "ONE two", "a"), (2001, None, "b"), (2002, "É x", "a"), (2003, "é x", "a"), (2004, "İ X", "a"), (2005, "İ x", "a")]
    rows.append(rows[0])
    options = {"hash_of": lambda t: F.unhex(F.lit("00"))} if collide else {}
    got = collect(exact_duplicates(corpus(spark, rows), keep, **options))
    groups = {}
    for i, t, _ in rows:
        groups.setdefault(fold(t or ""), []).append(i)
    pick = {t: (min if keep == "smallest" else max)([i for i in ids if i is not None], default=None) for t, ids in groups.items()}
    want = [(i, pick[fold(t or "")], len(groups[fold(t or "")]), i == pick[fold(t or "")], hashlib.sha256(fold(t or "").encode()).hexdigest()) for i, t, _ in rows]
    assert got == sorted(want, key=repr)
    assert exact_duplicates(corpus(spark, rows).where("false")).count() == 0


# 6


def brute_words(rows, size):
    docs = [(i, (t or "").encode().split()) for i, t, _ in rows]
    first = {}
    for i, words in sorted(docs, key=lambda x: x[0]):
        for p in range(len(words) - size + 1):
            first.setdefault(tuple(words[p:p + size]), (i, p))
    out = []
    for i, words in docs:
        gone = set()
        for p in range(len(words) - size + 1):
            if first[tuple(words[p:p + size])] != (i, p):
                gone.update(range(p, p + size))
        kept = b" ".join(w for p, w in enumerate(words) if p not in gone)
        out.append((i, len(words), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("size, seed", [(20, 8), (4, 9)])
def test_repeated_words(spark, size, seed):
    rows = some_rows(seed)
    rows += [(3000, "one " * 100, "a"), (3001, "x y " * 40, "b")]
    rows.append(rows[2])
    got = drop_repeated_words(corpus(spark, rows).repartition(5), size)
    assert collect(got.drop("kept")) == sorted(brute_words(rows, size), key=repr)
    assert drop_repeated_words(corpus(spark, rows).where("false"), size).count() == 0


def test_longest_repeats(spark):
    text = " ".join(f"w{i}" for i in range(90))
    got = longest_repeats(corpus(spark, [(1, text, "a"), (2, "q " + text, "a"), (3, None, "b")])).groupBy("length").count().collect()
    assert {x["length"]: x["count"] for x in got} == {80: 22, 40: 80, 20: 40}


# 7


def test_codes_give_any_token():
    r = np.random.default_rng(3)
    for ids in (np.zeros(0, np.uint32), np.array([5], np.uint32), r.integers(0, 50000, 5000).astype(np.uint32), np.array([255, 256, 2 ** 32 - 1, 0, 65536] * 300, np.uint32)):
        codes = pack_codes(ids)
        assert (unpack_codes(codes) == ids).all()
        levels = open_codes(codes)
        assert [token_at(levels, i) for i in range(0, len(ids), 7)] == ids[::7].tolist()


def test_token_store(spark, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    odd = ["It's a\x85b  c <|endoftext|>d", "ΣΑΣ İs ﬁ 12345 'll ''s\x1c\x1fq 😀👍🏽 ẹ́", "a ́b é", "A\tB\nC\x0bD\x0cE\rF"]
    rows = [*some_rows(10, 30), *[(4000 + k, t, "a") for k, t in enumerate(odd)]]
    rows = [(-5, "below zero", "a"), *rows]
    write_store(corpus(spark, rows).repartition(6), path, str(tmp_path / "store"))
    at, want = 0, []
    for i, t, _ in sorted(rows, key=lambda x: x[0]):
        ids = np.array([*Tokenizer.from_file(path).encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert collect(read_store(spark, str(tmp_path / "store"))) == sorted(want, key=repr)


def test_token_store_of_odd_tables(spark, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    write_store(corpus(spark, [(1, "x", "a")]).where("false"), path, str(tmp_path / "none"))
    assert read_store(spark, str(tmp_path / "none")).count() == 0
    write_store(corpus(spark, [(None, "x", "a"), (1, "x", "a"), (1, "x", "a")]), path, str(tmp_path / "odd"))
    assert [x[:3] for x in sorted(map(tuple, read_store(spark, str(tmp_path / "odd")).collect()), key=lambda x: x[1])] == [(None, 0, 2), (1, 2, 2), (1, 4, 2)]


# 8

PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style></head><body class="page"><!-- <p>no</p> -->
<header class="masthead"><a href="/">Site</a></header><nav><ul><li><a href=/a>A</a><li><a href=/b>B</a></ul></nav>
<div class="cookie-notice">We use cookies and so on, please accept all of them now.</div>
<article><header><h1>Head&amp;line</h1></header><p>First   paragraph &lt;b&gt; with <b>bold</b> and a < sign,<br>next&nbsp;line.
<p>Second &eacute;t&#233;<script>var x = "</p>";</script> <i>end</i>.</p><div class="ad-box">Buy now, it is cheap and good and nice.</div>
<form><label>Name</label><input name=q></form><aside>Side words of some length stand here, more or less.</aside><ul><li>One<li>Two</ul><table><tr><td>c1<td>c2</table></article>
<section id="comments"><p>A reader comment that is long enough to look like an article, with many words in it.</p></section>
<footer>&copy; Site</footer></body></html>"""


def test_pages(spark):
    text = "Head&line\n\nFirst paragraph <b> with bold and a < sign, next line.\n\nSecond été end.\n\nOne\n\nTwo\n\nc1\n\nc2"
    assert main_text(PAGE) == text
    long = "<article>" + "<p>word " * 20000
    pages = spark.createDataFrame([(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (3, "v", ""), (None, "w", "<p"), (4, "x", long)], "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("text", "n")})
    got = {(x["page_id"], x["url"]): x["text"] for x in extract_pages(pages).collect()}
    assert got[1, "u"] == text and got[2, None] == "" and got[3, "v"] == "" and len(got[4, "x"].split()) == 20000
    assert extract_pages(pages).count() == 6 and extract_pages(pages.where("false")).count() == 0


def test_pages_without_a_main_element():
    body = "This paragraph has a good many words, so that it is taken for the text of an article by its length alone, and rightly so."
    page = f"<body><ul><li><a href=a>Home</a></li><li><a href=b>News</a></li></ul><p>{body}</p><p>{body}</p><div class='related'><a href=c>More of the same kind of thing</a></div></body>"
    assert main_text(page) == f"{body}\n\n{body}"


def test_tree_fits_its_table():
    assert all(is_article(article_tree(), row[:-1]) == bool(row[-1]) for row in LABELLED)


# 9


def brute_items(rows, items, size=5, similarity=0.8):
    def bag(words, k):
        return Counter(tuple(words[i:i + k]) for i in range(len(words) - k + 1))

    found = set()
    for i, t, _ in rows:
        words = WORD.findall(fold(t or ""))
        for item, text in items:
            own = WORD.findall(fold(text or ""))
            k = min(size, len(own))
            if k:
                mine = bag(own, k)
                for p in range(len(words) - len(own) + 1):
                    other = bag(words[p:p + len(own)], k)
                    both = sum((mine & other).values())
                    if both >= similarity * (2 * (len(own) - k + 1) - both):
                        found.add((i, item))
    return sorted(found, key=repr)


def test_decontamination(spark):
    r = random.Random(11)
    rows = some_rows(11, 60, 90)
    items = [(k, " ".join(r.choices(WORDS, k=n))) for k, n in enumerate([40, 25, 60, 3, 8, 40])]
    items += [(10, None), (11, ""), (12, items[0][1]), (None, "an item without an id that nobody has")]
    for k, (_, text) in enumerate(items[:6]):
        for edits in range(3):
            words = text.split()
            for _ in range(edits):
                words[r.randrange(len(words))] = "changed"
            rows.append((6000 + 10 * k + edits, " ".join([*r.choices(WORDS, k=20), *[w.translate({i: i - 32 for i in range(97, 123)}) for w in words], *r.choices(WORDS, k=9)]), "a"))
    docs = corpus(spark, rows).repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("n", F.lit(1))
    want = brute_items(rows, items)
    got = benchmark_matches(docs, bench, block_bytes=500)
    assert collect(got.select("doc_id", "item_id")) == want and len(want) >= 8
    ids = {i for i, _ in want}
    assert {x["doc_id"] for x in contaminated_documents(docs, bench).collect()} == ids
    kept = clean_documents(docs, bench)
    assert kept.columns == docs.columns and sorted(x[0] for x in kept.select("doc_id").collect()) == sorted(i for i, _, _ in rows if i not in ids)
    assert benchmark_matches(docs, bench.where("false")).count() == 0 and benchmark_matches(docs.where("false"), bench).count() == 0


# 10


def brute_bytes(rows, size):
    texts = [(i, (t or "").encode()) for i, t, _ in rows]
    seen = Counter(b[p:p + size] for _, b in texts for p in range(len(b) - size + 1))
    out = []
    for i, b in texts:
        gone = np.zeros(len(b) + 1, int)
        for p in range(len(b) - size + 1):
            if seen[b[p:p + size]] > 1:
                gone[p] += 1
                gone[p + size] -= 1
        gone = np.cumsum(gone[:-1]) > 0
        out.append((i, len(b), int(gone.sum()), int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [False, True])
def test_repeated_bytes(spark, monkeypatch, hot):
    if hot:
        monkeypatch.setattr(suffix_index, "HOT_LEAST", 1)
    rows = some_rows(12, 60, 80)
    rows += [(7000, "ab" * 300, "a"), (7001, "z" * 500, "a"), (7002, "é" * 90, "b"), (None, rows[1][1], "a")]
    rows.append(rows[4])
    docs = corpus(spark, rows).repartition(4)
    got = suffix_index.drop_repeated_bytes(docs, 100, batches=4)
    assert collect(got.drop("kept")) == sorted(brute_bytes(rows, 100), key=repr)
    assert suffix_index.drop_repeated_bytes(docs.where("false"), 100).count() == 0


# All


needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


@needs_tables
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "pages", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    cur = con.execute(entry.oracle_sql()[name])
    order = [[d[0] for d in cur.description].index(c) for c in df.columns]
    assert collect(df) == sorted((tuple(x[i] for i in order) for x in cur.fetchall()), key=repr)


@needs_tables
def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    benchmark = [tuple(x) for x in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    rows = lambda df: [tuple(x) for x in df.select("doc_id", "text", "source").collect()]
    held = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, held, SF)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        before, after = rows(held), rows(out) if name != "token_ids" else None
        if after is not None:
            assert out.columns == docs.columns
        if name == "toxicity":
            toxic = {x[0] for x in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1").select("doc_id").collect()}
            gone = {x[0] for x in before} - {x[0] for x in after}
            assert gone <= toxic | {x[0] for x in before if x[0] not in toxic} and len(gone) < 0.3 * len(before)
        if name == "near_duplicates":
            assert {x[0] for x in after} == {i for i, _, c in brute_groups(before, 5, 80) if i == c} and len(after) == len({x[0] for x in after})
        if name == "decontamination":
            bad = {i for i, _ in brute_items(before, benchmark)}
            assert {x[0] for x in after} == {x[0] for x in before} - bad
        if name == "source_mix":
            taken = {x["doc_id"]: round(x["taken"] / x["size"] + 1e-9) if x["size"] else 0 for x in taken_words(held).collect()}
            assert Counter(x[0] for x in after) == Counter({i: k for i, k in taken.items() if k})
        if name == "token_ids":
            assert out.count() == len(before)
        held = out


def test_parities_bound_the_difference():
    r = np.random.default_rng(4)
    for n, m in ((3, 3), (50, 55), (400, 340), (2000, 2300)):
        a = np.unique(r.integers(0, 2 ** 63, n, dtype=np.uint64))
        b = np.unique(np.concatenate((a[: n // 2], r.integers(0, 2 ** 63, m - n // 2, dtype=np.uint64))))
        x, y = ngram_join.parity_bits(a, 80), ngram_join.parity_bits(b, 80)
        while len(x) != len(y):
            x, y = (x[:len(x) // 2] ^ x[len(x) // 2:], y) if len(x) > len(y) else (x, y[:len(y) // 2] ^ y[len(y) // 2:])
        assert sum(int(v & (2 ** 64 - 1)).bit_count() for v in (x ^ y).tolist()) <= len(np.setxor1d(a, b))


def test_near_copies_under_the_threshold(spark):
    """Copies of one text that each lack other words: few of the many candidate pairs link, sets of unlike sizes meet folded parities."""
    r = random.Random(8)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(60):
        text = list(base)
        for _ in range(r.choice([0, 2, 4, 8])):
            text[r.randrange(len(text))] = f"x{i}"
        rows.append((i, " ".join(text + [f"t{i % 9}"] * r.choice([0, 1, 12])), "a"))
    got = {x["doc_id"]: x["component_id"] for x in ngram_groups(corpus(spark, rows), 4, 85).collect()}
    assert got == {i: low for i, _, low in brute_groups(rows, 4, 85)}
