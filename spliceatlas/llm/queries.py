"""The registered queries of this subpackage: each a thin layer over one operator, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, divergence, katz, minhash, packing, pii, secret_scan, substring, topk, toxicity, warc
from ._spans import counted, joined
from ._store import Scratch
from ._vocabularies import tokenizer_file


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _digested(found: DataFrame, kinds: list[str], base_kinds: list[str]) -> DataFrame:
    spans = F.col("spans")
    base = F.sha2(joined(kinds, spans, True).cast("binary"), 256)
    return found.select("doc_id", *[counted(spans, k).alias(f"n_{k}") for k in base_kinds], base.alias("base_sha256"), joined(kinds, spans, False).alias("spans"))


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{Scratch(spark).path}/archives"
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    return warc.read_captures(spark, path, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(table(spark, sf_dir, "documents"))
    return _digested(found, pii.KINDS, pii.KINDS)


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top_k(table(spark, sf_dir, "embeddings"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(table(spark, sf_dir, "documents"))
    return _digested(found, secret_scan.KINDS, secret_scan.KINDS[:3])


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json")))


def op11_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.katz_scores(table(spark, sf_dir, "documents"), katz.held_out("doc_id"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergences(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


OP1_SQL = """
with p as (select page_id, coalesce(html, '') as h, octet_length(encode(coalesce(html, ''))) as n from pages),
d as (select page_id, n, sha1(h) as digest, max(page_id) over (partition by h) as largest from p)
select page_id, n as payload_bytes, digest as payload_digest, case when n >= 1000 and page_id <> largest then 'revisit' else 'response' end as record_type,
  case when n >= 1000 and page_id <> largest then largest end as refers_to from d"""

OP4_SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(1024 * cast(x as double))) as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, v.vec_id, cast(list_inner_product(q.e, v.e) as bigint) as score from v q join v on q.vec_id <> v.vec_id where q.vec_id % 100 = 0),
r as (select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank, vec_id, score from s)
select * from r where rank <= 10"""

_WORDS_SQL = "regexp_extract_all(coalesce({text}, ''), '[^\\x20\\x09-\\x0D]+')"

OP6_SQL = f"""
with d as (select doc_id, {_WORDS_SQL.format(text='text')} as w from documents),
t as (select doc_id, len(w) as n, unnest(w) as word, generate_subscripts(w, 1) as i from d),
k as (select *, case when i + 34 <= n then string_agg(word, ' ') over (partition by doc_id order by i rows between current row and 34 following) end as run from t),
c as (select *, case when run is not null and count(*) over (partition by run) > 1 then 1 else 0 end as again from k),
g as (select *, max(again) over (partition by doc_id order by i rows between 34 preceding and current row) as gone from c),
o as (select doc_id, sum(gone) as removed, string_agg(word, ' ' order by i) filter (gone = 0) as kept from g group by doc_id)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(removed, 0) as bigint) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from d left join o using (doc_id)"""

OP7_SQL = f"""
with recursive d as (select doc_id, {_WORDS_SQL.format(text="translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} as w from documents),
t as (select doc_id, len(w) as n, unnest(w) as word, generate_subscripts(w, 1) as i from d where len(w) >= 3),
s as (select distinct doc_id, sh from (select doc_id, word || ' ' || lead(word, 1) over p || ' ' || lead(word, 2) over p as sh from t window p as (partition by doc_id order by i)) where sh is not null
  union all select doc_id, array_to_string(w, ' ') from d where len(w) between 1 and 2),
z as (select doc_id, count(*) as n from s group by doc_id),
links as (select a, b from (select x.doc_id as a, y.doc_id as b, count(*) as common from s x join s y on x.sh = y.sh and x.doc_id < y.doc_id group by all) p
  join z za on za.doc_id = a join z zb on zb.doc_id = b where 100 * common >= 85 * (za.n + zb.n - common)),
edges as (select a, b from links union select b, a from links),
reach(doc_id, other) as (select a, b from edges union select r.doc_id, e.b from reach r join edges e on r.other = e.a),
roots as (select doc_id, min(other) as root from reach group by doc_id)
select d.doc_id, cast(coalesce(z.n, 0) as bigint) as n_shingles, least(d.doc_id, coalesce(root, d.doc_id)) as component_id, least(d.doc_id, coalesce(root, d.doc_id)) = d.doc_id as kept
from d left join z using (doc_id) left join roots using (doc_id)"""


OP12_SQL = r"""
with d as (select coalesce(lang, '') as lang, coalesce(source, '') as source, row_number() over () as r,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as w from documents),
t as (select lang, source, r, unnest(w) as term from d),
g as (select distinct lang, source from d),
kept as (select lang, term, count(*) as n from t group by all having count(distinct r) >= 3),
size as (select lang, count(*) as v, sum(n) as total from kept group by lang),
c as (select lang, source, term, count(*) as n from t semi join kept using (lang, term) group by all),
own as (select lang, source, sum(n) as total from c group by all),
p as (select g.lang, g.source, kept.term, coalesce(c.n, 0) as n, 1 + (1000000000::hugeint * (coalesce(c.n, 0) + 1)) // (coalesce(own.total, 0) + v)::hugeint as p,
    1 + (1000000000::hugeint * (kept.n + 1)) // (size.total + v)::hugeint as q
  from g join kept using (lang) join size using (lang) left join own on own.lang = g.lang and own.source = g.source left join c on c.lang = g.lang and c.source = g.source and c.term = kept.term),
sums as (select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
pairs as (select a.lang, a.source, b.source as item, coalesce(s.value, 0) as value from g a join g b on a.lang = b.lang and a.source <> b.source
  left join sums s on s.lang = a.lang and s.source = a.source and s.item = b.source),
parts as (select lang, source, 'pair' as part, item, value from pairs union all select lang, source, 'term', term, ((p - q) * (p - q)) // q from p where n > 0 and p > q),
ranked as (select lang, source, part, item, cast(value as bigint) as value, cast(row_number() over (partition by lang, source, part order by value desc, item) as int) as rank from parts)
select * from ranked where part = 'pair' or rank <= 200"""


def oracle_sql() -> dict[str, str]:
    """SQL of the operators it can express. The others are tested against brute force, the tokenizers library or held-out rows."""
    return {"op1_warc": OP1_SQL, "op4_topk": OP4_SQL, "op6_substring_dedup": OP6_SQL, "op7_minhash": OP7_SQL, "op12_divergence": OP12_SQL}
