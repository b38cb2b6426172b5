"""The queries of this subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import imatch, mixing, parity_join, pii, quality, shards, suffix_match, toxicity, urls
from tessera.llm.token_counts import Rollup, counted, tidy
from tessera.plans.session import scratch

#: Wanted shares of tokens by language.
TARGETS = {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loads all documents, repeats that load (no effect), takes exact copies away again (one count of every text stays) and revises texts that tidying changes."""
    docs = read(spark, sf_dir, "documents")
    rollup = Rollup(spark, f"{scratch(spark)}/tessera/rollup-{uuid.uuid4().hex}")
    version = "byte_bpe_50k/1"
    rollup.commit("load", counted(docs, version))
    rollup.commit("load", counted(docs, version))
    rollup.commit("copies", rollup.copies())
    untidy = docs.select("doc_id", "source", "lang", F.col("text").alias("old"), tidy(F.col("text")).alias("text")).filter("text <> old")
    rollup.commit("tidied", rollup.revision(untidy, version, old="old"))
    return rollup.totals()


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.extract(read(spark, sf_dir, "documents"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_match.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("matches")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op5_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.edits(read(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return mixing.rates(docs, docs.select("doc_id", F.col("lang").alias("domain")), TARGETS)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(read(spark, sf_dir, "pages"), urls.rule_table(spark))


def op9_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.assign(read(spark, sf_dir, "documents"))


def op10_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity_join.near_classes(read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_pii, op3_decontaminate, op4_quality, op5_imatch, op6_mixing, op7_toxicity, op8_urls, op9_shards, op10_parity_join)}

_WORDS = r"regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES = {
    "op3_decontaminate": f"""
with d as (select row_number() over () as r, doc_id, {_WORDS.format("coalesce(text, '')")} as w from documents),
b as (select coalesce(cast(item_id as varchar), '') as item, {_WORDS.format("coalesce(text, '')")} as w from benchmark),
iw as (select item, least(13, len(w)) as n, unnest(range(1, len(w) - least(13, len(w)) + 2)) as i, w from b where len(w) > 0),
windows as (select distinct item, n, array_to_string(w[i:i + n - 1], ' ') as s from iw),
sizes as (select distinct n from windows),
dw as (select r, n, unnest(range(1, len(w) - n + 2)) as i, w from d, sizes where len(w) >= n),
hit as (select dw.r, dw.i, dw.n, x.item from (select r, n, i, array_to_string(w[i:i + n - 1], ' ') as s from dw) dw join windows x on dw.n = x.n and dw.s = x.s),
words as (select r, count(distinct p) as n_hit from (select r, unnest(range(i, i + n)) as p from hit) group by r),
items as (select r, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as s from hit group by r)
select d.doc_id, cast(len(d.w) as bigint) as n_words, cast(coalesce(words.n_hit, 0) as bigint) as n_hit, cast(coalesce(items.n_items, 0) as bigint) as n_items,
sha256(coalesce(items.s, '')) as items_sha256, coalesce(words.n_hit, 0) > 0 and 20 * coalesce(words.n_hit, 0) >= len(d.w) as contaminated
from d left join words using (r) left join items using (r)""",
    "op8_urls": r"""
with u as (select page_id, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
p as (select row_number() over () as r, page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u),
rules(rh, rp, v) as (values ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
fit as (select r, rh || rp as rule, v, row_number() over (partition by r order by length(rh || rp) desc, length(rh) desc) as k from p join rules on (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp))
select p.page_id, p.host, p.path, fit.rule, coalesce(fit.v, 'allow') as verdict from p left join fit on p.r = fit.r and fit.k = 1""",
    # the table of CRC-32 from its polynomial, then a byte at a time over each text
    "op9_shards": r"""
with d as (select doc_id, coalesce(text, '') as t from documents),
poly as (select list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, n)) as p),
b as (select doc_id, cast(strlen(t) + 1 as bigint) as size, list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda h: cast('0x' || h as bigint)) as bytes from d),
c as (select doc_id, size, xor(list_reduce(bytes, lambda c, x: xor(c >> 8, p[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) as text_crc32 from b, poly),
o as (select *, sum(size) over (order by doc_id nulls first, size, text_crc32 rows unbounded preceding) as last, row_number() over (order by doc_id nulls first, size, text_crc32) as r, sum(size) over () as total from c),
s as (select *, cast(least((last - size + size // 2) * 8 // total, 7) as int) as shard from o)
select doc_id, size, text_crc32, 'bytes' as law, shard, row_number() over (partition by shard order by r) - 1 as slot, cast(null as int) as grown_shard from s""",
    "op10_parity_join": r"""
with recursive w as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select r, doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end as s from w),
e as (select r, len(s) as n, unnest(s) as t from s),
o as (select r, n, t, row_number() over (partition by r order by hash(t), t) as k from e),
c as (select distinct a.r as a, b.r as b from o a join o b on a.t = b.t and a.r < b.r and 4 * a.k <= a.n + 8 and 4 * b.k <= b.n + 8),
l as (select c.a, c.b from c join s x on c.a = x.r join s y on c.b = y.r where 100 * len(list_intersect(x.s, y.s)) >= 75 * (len(x.s) + len(y.s) - len(list_intersect(x.s, y.s)))),
g as (select a, b from l union select b, a from l),
reach(x, y) as (select r, r from s union select reach.x, g.b from reach join g on reach.y = g.a)
select s.doc_id, cast(len(s.s) as bigint) as n_shingles, (select min(t.doc_id) from reach join s t on t.r = reach.y where reach.x = s.r) as component_id from s""",
}
