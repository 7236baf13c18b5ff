"""The queries op1_ to op13_ and pipeline of this subpackage, and the SQL that checks them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import filter_audit, kdtree, licenses, metric_join, mixing, packing, perplexity, quality, secret_scan, simhash, token_counts, url_rules, whitening
from .common import read

# The rules of op7.
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: Powers of the shares that sources, languages and topics have of the tokens: the less, the more even the mix.
POWERS = {"source": 0.5, "lang": 0.8, "topic": 0.8}


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return secret_scan.digest(secret_scan.find_secrets(docs, secret_scan.train(docs)))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 4096)


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_notices, n_confirmed, families (of confirmed notices, sorted and joined by commas) and notices (all, as family:start:end, in order, joined likewise)."""
    docs = read(spark, sf_dir, "documents")
    found = licenses.scan(docs, licenses.fit(docs))
    confirmed = F.filter("notices", lambda n: n["confirmed"])
    families = F.array_join(F.array_sort(F.array_distinct(F.transform(confirmed, lambda n: n["family"]))), ",")
    places = F.transform("notices", lambda n: F.concat_ws(":", n["family"], n["start"].cast("string"), n["end"].cast("string")))
    return found.select("doc_id", F.size("notices").cast("long").alias("n_notices"), F.size(confirmed).cast("long").alias("n_confirmed"), families.alias("families"), F.array_join(places, ",").alias("notices"))


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kdtree.top_k(read(spark, sf_dir, "embeddings"), "vec_id % 50 = 0", k=5)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity.quality_rules(read(spark, sf_dir, "documents")).select(*perplexity.NAMES[:1], *perplexity.NAMES[2:7], "base_failed", "kept")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"), powers=POWERS)


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge_urls(read(spark, sf_dir, "pages"), URL_RULES)


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexadecimal("fp").alias("fingerprint"), "component_id")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scored = quality.score(docs, quality.fit(docs, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", (quality.remainder("doc_id") == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op11_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_join.jaccard_components(read(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(filter_audit.cells(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return whitening.whiten(vectors, whitening.fit(vectors)).withColumn("deviation", F.expr("try_cast(deviation as bigint)"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    named = [op1_secrets, op2_token_counts, op3_licenses, op4_nearest, op5_quality_rules, op6_mixing, op7_url_rules, op8_near_duplicates, op9_quality, op10_packing, op11_jaccard, op12_filter_audit, op13_whitening]
    return {f.__name__: f for f in named} | {"pipeline": pipeline}


def oracle_sql() -> dict[str, str]:
    return {
        "op4_nearest": """
with v as (
  select row_number() over () as r, vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as double)) as v
  from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select q.r, q.vec_id as query_id, c.vec_id, cast(list_dot_product(q.v, c.v) as bigint) as score
  from v q join v c on q.r <> c.r and len(q.v) = len(c.v) and q.vec_id % 50 = 0),
ranked as (select *, row_number() over (partition by r order by score desc, vec_id) as rank from scored)
select query_id, cast(rank as integer) as rank, vec_id, score from ranked where rank <= 5""",
        "op7_url_rules": r"""
with parts as (
  select page_id,
         translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) as path
  from pages),
rules(verdict, suffix, beginning) as (values ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
won as (
  select host, path, arg_max(struct_pack(rule := suffix || beginning, verdict := verdict), length(suffix) * 1000 + length(beginning)) as w
  from (select distinct host, path from parts) p join rules r
    on (p.host = r.suffix or ends_with(p.host, '.' || r.suffix)) and starts_with(p.path, r.beginning)
  group by host, path)
select page_id, p.host, p.path, w.w.rule as rule, coalesce(w.w.verdict, 'allow') as verdict
from parts p left join won w on p.host = w.host and p.path = w.path""",
        "op11_jaccard": r"""
with recursive words as (
  select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
sets as (
  select r, doc_id, case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) end as s
  from words),
each as (select r, len(s) as n, unnest(s) as x from sets),
few as (select x from each group by x having count(*) > 1),
met as (
  select a.r as a, b.r as b, any_value(a.n) as n_a, any_value(b.n) as n_b, count(*) as same
  from each a join each b on a.x = b.x and a.r < b.r and 100 * a.n >= 85 * b.n and 100 * b.n >= 85 * a.n
  where a.x in (select x from few) group by a.r, b.r),
links as (select a, b from met where 100 * same >= 85 * (n_a + n_b - same)),
ways as (select a, b from links union all select b, a from links),
reach as (select r, r as other from sets union select reach.r, ways.b from reach join ways on ways.a = reach.other),
low as (select reach.r, min(sets.doc_id) as component_id from reach join sets on sets.r = reach.other group by reach.r)
select doc_id, cast(len(s) as bigint) as n_shingles, component_id from sets join low using (r)""",
        "op12_filter_audit": r"""
with recursive said as (
  select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic from labels where doc_id is not null group by doc_id),
texts as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
marked as (
  select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic,
         case when len(words) < 50 then 1 else 0 end
         + case when 100 * len(list_distinct(words)) < 65 * len(words) then 2 else 0 end
         + case when 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) then 4 else 0 end
         + case when regexp_matches(text, '[#$%&*|]') then 8 else 0 end
         + case when t.doc_id > min(t.doc_id) over (partition by text) then 16 else 0 end as mask
  from texts t left join said using (doc_id)),
cells as (select part, mask, count(*) as n, sum(good) as good, sum(toxic) as toxic from marked group by part, mask),
letters(letter, bit) as (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders(o, used) as (select '', 0 union all select o || letter, used | bit from orders join letters on used & bit = 0),
places as (
  select o, k as step, bit, (select coalesce(sum(b.bit), 0) from letters b where position(b.letter in substring(o, 1, k - 1)) > 0) as before
  from (select o, unnest(range(1, 6)) as k from orders where length(o) = 5) join letters on letter = substring(o, k, 1)),
rows as (
  select part, o as filter_order, step, bit,
         sum(case when mask & (before::bigint | bit) = 0 then n else 0 end) as kept,
         sum(case when mask & before::bigint = 0 and mask & bit <> 0 then n else 0 end) as removed,
         sum(case when mask & before::bigint <> 0 and mask & bit <> 0 then n else 0 end) as redundant,
         sum(case when mask = bit then n else 0 end) as unique_fails,
         sum(case when mask & before::bigint = 0 and mask & bit <> 0 then good else 0 end) as good_lost,
         sum(case when mask & before::bigint = 0 and mask & bit <> 0 then toxic else 0 end) as toxic_lost
  from cells cross join places group by part, o, step, bit)
select part, filter_order, cast(step as integer) as step, cast(kept as bigint) as kept, cast(removed as bigint) as removed, cast(redundant as bigint) as redundant,
       cast(unique_fails as bigint) as unique_fails, cast(good_lost as bigint) as good_lost, cast(toxic_lost as bigint) as toxic_lost,
       cast(sum(removed) over (partition by part, bit) as bigint) as shapley
from rows""",
    }
