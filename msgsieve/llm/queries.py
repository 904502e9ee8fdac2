"""Registered queries: every corpus operator over its whole table, with the SQL for its rows where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from msgsieve.llm.chat import every_conversation_pairs, preference_turns
from msgsieve.llm.common import scratch, table
from msgsieve.llm.decontaminate import contaminated_documents
from msgsieve.llm.exact_dedup import exact_duplicates
from msgsieve.llm.html_blocks import extract_pages
from msgsieve.llm.lexical import rank_documents
from msgsieve.llm.merkle import audit, leaf_digest
from msgsieve.llm.mixing import taken_words
from msgsieve.llm.ngram_join import ngram_groups
from msgsieve.llm.substring_dedup import drop_repeated_words
from msgsieve.llm.suffix_index import drop_repeated_bytes
from msgsieve.llm.token_store import read_store, write_store
from msgsieve.llm.toxicity import fit_toxicity, learnable, score_toxicity
from msgsieve.llm.warc import convert_pages

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(job):
        QUERIES[name] = job
        if sql:
            ORACLES[name] = sql
        return job

    return keep


@query("op1_toxicity")
def toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fitted model has no SQL form; tests measure held-out accuracy."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit_toxicity(docs, labels.where(learnable(F.col("doc_id"))))
    scored = score_toxicity(docs.select(F.col("doc_id").cast("long"), "text"), model)
    return scored.select("doc_id", (~learnable(F.col("doc_id"))).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query("op2_ngram_join", """
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents),
g as (
  select doc_id, unnest(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
                             else [array_to_string(w[i:i + 3], ' ') for i in range(1, len(w) - 2)] end) as s from w),
d as (select distinct doc_id, s from g),
n as (select doc_id, count(*) as n from d group by doc_id),
i as (select a.doc_id as a, b.doc_id as b, count(*) as i from d a join d b on a.s = b.s and a.doc_id <> b.doc_id group by 1, 2),
e as (select a, b from i join n x on x.doc_id = a join n y on y.doc_id = b where 100 * i >= 85 * (x.n + y.n - i)),
r(doc_id, c) as (select a, b from e union select r.doc_id, e.b from r join e on r.c = e.a)
select w.doc_id, coalesce(n.n, 0) as n_shingles, least(w.doc_id, coalesce(m.c, w.doc_id)) as component_id
from w left join n using (doc_id) left join (select doc_id, min(c) as c from r group by doc_id) m using (doc_id)
""")
def ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_groups(table(spark, sf_dir, "documents"), size=4, percent=85)


@query("op3_chat_preferences", """
with t as (select conv_id, turn, coalesce(role, 'user') as role, coalesce(text, '') as text from conversations where conv_id is not null and turn is not null
           qualify row_number() over (partition by conv_id, turn order by coalesce(role, 'user'), coalesce(text, '')) = 1),
a as (select *, min(text) over (partition by conv_id) as least, max(text) over (partition by conv_id) as most,
             row_number() over (partition by conv_id order by ('0x' || substr(md5(conv_id || ':' || turn), 1, 8))::bigint, turn) as k
      from t where role = 'assistant'),
e as (select conv_id, turn as last, text as reply, least, most, ('0x' || substr(md5(conv_id::varchar), 1, 8))::bigint as h from a where k = 1),
g as (select *, h % greatest(1, (select count(*) // 64 from e)) as g from e),
n as (select *, coalesce(lead(reply) over w, first_value(reply) over w) as n1, coalesce(lead(least) over w, first_value(least) over w) as n2,
             coalesce(lead(most) over w, first_value(most) over w) as n3 from g window w as (partition by g order by h, conv_id)),
o as (select conv_id, last, coalesce(nullif(n1, reply), nullif(n2, reply), nullif(n3, reply), nullif(least, reply), nullif(most, reply), nullif('', reply), 'no reply') as other from n),
p as (select t.*, o.last, o.other from t left join o using (conv_id))
select conv_id as pair_id, part, turn, '<|' || role || '|>' || chr(10) || said || '<|end|>' || chr(10) as rendered, part <> 'prompt' and role = 'assistant' as loss
from (select conv_id, case when last is null or turn < last then 'prompt' else 'chosen' end as part, turn, role, text as said from p
      union all select conv_id, 'rejected', turn, role, other from p where turn = last)
""")
def chat_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation and turn."""
    chosen, rejected = every_conversation_pairs(table(spark, sf_dir, "conversations"))
    return preference_turns(chosen, rejected)


@query("op4_source_mix")
def source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken_words(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op5_exact_dedup", """
select doc_id, max(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
       doc_id = max(doc_id) over (partition by t) as kept, sha256(t) as text_sha256
from (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents)
""")
def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"), keep="largest")


@query("op6_substring_dedup", """
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents),
s as (select doc_id, unnest(range(1, len(w) - 18)) as p from w),
h as (select s.doc_id, s.p, array_to_string(w.w[s.p:s.p + 19], ' ') as t from s join w using (doc_id)),
l as (select doc_id, p from (select doc_id, p, rank() over (partition by t order by doc_id, p) as k from h) where k > 1),
c as (select distinct doc_id, p + i as p from l, range(20) r(i)),
x as (select doc_id, unnest(range(1, len(w) + 1)) as p, unnest(w) as t from w),
k as (select x.doc_id, string_agg(x.t, ' ' order by x.p) as kept, count(*) as n from x left join c using (doc_id, p) where c.p is null group by 1)
select w.doc_id, len(w.w) as n_words, len(w.w) - coalesce(k.n, 0) as n_removed, sha256(coalesce(k.kept, '')) as kept_sha256
from w left join k using (doc_id)
""")
def substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeated_words(table(spark, sf_dir, "documents"), 20).drop("kept")


@query("op7_token_store")
def token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokenizer has no SQL form; tests compare with its own encoding of whole texts."""
    import public_tokenizers

    path = scratch(spark, "token-store")
    write_store(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), path)
    return read_store(spark, path)


@query("op8_html_extraction")
def html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree over mark-up has no SQL form; tests compare with pages whose article is known."""
    return extract_pages(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


@query("op9_decontamination")
def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold a benchmark passage.  Windows of every size against every item: too slow as SQL; tests use brute force."""
    found = contaminated_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumn("contaminated", F.lit(True))


@query("op10_suffix_index")
def suffix_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per byte is too much for SQL on whole tables; tests use brute force."""
    return drop_repeated_bytes(table(spark, sf_dir, "documents"), 400, batches=4).drop("kept")


@query("op11_merkle_manifest", """
with recursive c as (
  select *, list_reduce(flatten([[4294967295::bigint], flatten([[ord(x)::bigint, -1, -1, -1, -1, -1, -1, -1, -1] for x in string_split(doc_id::varchar, '')])]),
                        lambda a, x: case when x >= 0 then xor(a, x) else xor(a >> 1, (a & 1) * 3988292384) end) as crc
  from documents),
s as (
  select doc_id, lang, n_chars, coalesce(strlen(source) || ':' || source, '-') as src, coalesce(strlen(lang) || ':' || lang, '-') as lng,
         coalesce(strlen(text) || ':' || text, '-') as txt, coalesce(strlen(doc_id::varchar) || ':' || doc_id, '-') as id,
         coalesce(xor(crc, 4294967295) % 7 = 0, false) as tamper
  from c),
l as (
  select doc_id, lang, sha256(id || src || lng || coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-') || txt) as leaf,
         sha256(id || src || lng || coalesce(strlen((n_chars::hugeint + tamper::int)::varchar) || ':' || (n_chars::hugeint + tamper::int), '-') || txt) as other
  from s),
p as (select *, coalesce('=' || lang, '') as g, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as i, count(*) over (partition by lang) as n from l),
t(g, lvl, i, n, h) as (
  select g, 0, i, n, leaf from p
  union all
  select a.g, a.lvl + 1, a.i // 2, (a.n + 1) // 2, sha256(a.h || coalesce(b.h, ''))
  from t a left join t b on a.g = b.g and a.lvl = b.lvl and b.i = a.i + 1 where a.n > 1 and a.i % 2 = 0),
r as (select g, h as subroot, row_number() over (order by encode(g)) - 1 as i, count(*) over () as n from t where n = 1),
u(lvl, i, n, h) as (
  select 0, i, n, subroot from r
  union all
  select a.lvl + 1, a.i // 2, (a.n + 1) // 2, sha256(a.h || coalesce(b.h, ''))
  from u a left join u b on a.lvl = b.lvl and b.i = a.i + 1 where a.n > 1 and a.i % 2 = 0),
w(id, g, top, lvl, i, n, proof, h) as (
  select row_number() over (), g, false, 0, i, n, '', other from p
  union all
  select w.id, w.g, w.top or w.n = 1, case when w.n = 1 then 0 else w.lvl + 1 end, case when w.n = 1 then r.i else w.i // 2 end, case when w.n = 1 then r.n else (w.n + 1) // 2 end,
         case when w.n = 1 then w.proof else w.proof || coalesce(t.h, u.h, '') end,
         case when w.n = 1 then w.h when w.i % 2 = 0 then sha256(w.h || coalesce(t.h, u.h, '')) else sha256(coalesce(t.h, u.h) || w.h) end
  from w left join r on r.g = w.g
         left join t on not w.top and t.g = w.g and t.lvl = w.lvl and t.i = xor(w.i, 1) and w.n > 1
         left join u on w.top and u.lvl = w.lvl and u.i = xor(w.i, 1) and w.n > 1
  where w.n > 1 or not w.top),
f as (select id, sha256(proof) as proof_sha256, h as folded_root from w where top and n = 1)
select p.doc_id, p.leaf, r.subroot, x.h as root, f.proof_sha256, f.folded_root, f.folded_root = x.h as verified
from (select *, row_number() over () as id from p) p join f using (id) join r using (g) cross join (select h from u where n = 1) x
""")
def merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    leaf = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    other = [*leaf[:3], F.col("n_chars").cast("decimal(20)") + 1, leaf[4]]
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    rows = docs.select(F.col("lang").alias("grp"), F.col("doc_id").alias("key"), leaf_digest(*leaf).alias("leaf"), F.when(tampered, leaf_digest(*other)).alias("presented"))
    return audit(rows).withColumnRenamed("key", "doc_id").drop("grp")


@query("op12_warc", """
with p as (select page_id, coalesce(html, '') as h from pages),
d as (select page_id, strlen(h) as payload_bytes, sha256(h) as payload_digest from p),
f as (select *, case when payload_bytes >= 100 then min(page_id) over (partition by payload_digest, payload_bytes) else page_id end as f from d)
select page_id, payload_bytes, payload_digest, case when page_id = f then 'response' else 'revisit' end as record_type, case when page_id <> f then f end as refers_to from f
""")
def warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return convert_pages(table(spark, sf_dir, "pages")).drop("record_id")


@query("op13_ranked_search", """
with t as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as w from documents where text is not null),
d as (select doc_id, len(w)::bigint as n, w from t where len(w) > 0),
s as (select count(*)::bigint as nn, sum(n)::bigint as l from d),
q as (select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as w from benchmark where text is not null),
v as (select distinct w from q),
c as (select doc_id, n, w, count(*)::bigint as tf from (select doc_id, n, unnest(w) as w from d) join v using (w) group by all),
g as (select w, floor(1000 * ln((2 * any_value(nn) + 2)::double / (2 * count(*) + 1)::double))::bigint as g from c cross join s group by w),
k as (select q.item_id, c.doc_id, sum(g.g * ((1000000000 * c.tf) // (1000 * c.tf + 8 * (10 + (90 * c.n * s.nn) // s.l))))::bigint as score from q join c using (w) join g using (w) cross join s group by 1, 2)
select item_id, row_number() over (partition by item_id order by score desc, doc_id) as rank, doc_id, score from k where score > 0
qualify row_number() over (partition by item_id order by score desc, doc_id) <= 10
""")
def ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
