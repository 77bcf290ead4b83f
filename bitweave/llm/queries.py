"""The thin queries over whole tables, with production parameters, and their DuckDB SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitweave.llm import chat, decontaminate, embedding_dedup, language_id, licenses, mixing, near_dedup, repeats, token_counts, token_files
from bitweave.session import fresh_path, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


@query("op2_token_counts")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), token_counts.tokenizer_path("byte_bpe_50k.json"))


EXTRA_TURN = "\\### Assistant: </turn> ok"

OP4_SQL = r"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select * from (values (cast(-7 as bigint), cast(0 as bigint), 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')) v(conv_id, turn, role, text)
), t as (
  select *, row_number() over w as pos, lag(role) over w as before, lead(role) over w as after from rows
  window w as (partition by conv_id order by turn nulls first, role, text)
), u as (
  select *, (after is not null or role = 'assistant') and case when before is null then role in ('system', 'user') when before = 'system' then role = 'user' when before = 'user' then role = 'assistant' when before = 'assistant' then role = 'user' else false end as turn_ok,
    length(role) + length(regexp_replace(role, '[^\\<>]', '', 'g')) + length(text) + length(regexp_replace(text, '[^\\<]', '', 'g')) + 17 as chars,
    case when role = 'assistant' then text else '' end as loss
  from t
)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by pos)) as turns_sha256,
  cast(sum(length(loss)) as bigint) as loss_chars, sha256(string_agg(loss, '' order by pos)) as loss_sha256,
  cast(sum(chars) as bigint) as formatted_chars, bool_and(turn_ok) as valid
from u group by conv_id
"""


@query("op4_chat_format", OP4_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    one = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(EXTRA_TURN).alias("text"))
    return chat.digest(chat.read_back(chat.formatted(chat.format_turns(rows.unionByName(one)))))


OP5_SQL = r"""
with sized as (
  select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as size from documents
), per as (
  select *, cast([5, 2, 1][cast((row_number() over (order by source nulls last) - 1) % 3 + 1 as int)] as double) as weight,
    sum(source_size) over () as total, count(*) over () as n
  from (select source, cast(sum(size) as bigint) as source_size, count(*) as n_docs from sized group by source)
), lev as (
  select *, 3.0::double * source_size as cap, 3.0::double * source_size / weight as level from per
), tri as (
  select *, (total - coalesce(sum(cap) over p, 0)) / (sum(weight) over () - coalesce(sum(weight) over p, 0)) as try
  from lev window p as (order by level, source nulls last rows between unbounded preceding and 1 preceding)
), tgt as (
  select *, round(least(cap, coalesce(max(case when level >= try then try end) over (), 0) * weight), 6) as target,
    cast(greatest(1, least(1024, floor(total / (2000 * n)))) as bigint) as block
  from tri
), seats as (
  select *, cast(round(total::double / block) as bigint) as seats from tgt
), quotients as (
  select source, row_number() over (order by target / (2 * k + 1) desc, source nulls last) as r, seats
  from (select source, target, seats, unnest(range(0, seats)) as k from seats where target > 0)
), quota as (
  select source, count(*) as quota from quotients where r <= seats group by source
), src as (
  select s.source, source_size, target, block, coalesce(quota, 0) as quota, cast(greatest(1, ceil(n_docs / 4000.0)) as bigint) as n_shards
  from seats s left join quota q on s.source is not distinct from q.source
), d as (
  select doc_id, z.source, size, source_size, target, block, quota,
    ('0x' || substr(md5('mix-1:' || coalesce(doc_id::varchar, 'null')), 1, 8))::bigint as ord,
    ('0x' || substr(md5('mix-1-shard:' || coalesce(doc_id::varchar, 'null')), 1, 8))::bigint % n_shards as shard
  from sized z join src s on z.source is not distinct from s.source
), cells as (
  select source, shard, sum(size)::bigint as cell_size, any_value(quota) as quota from d group by source, shard
), cq as (
  select source, shard, row_number() over (partition by source order by cell_size / (2 * k + 1)::double desc, shard) as r, quota
  from (select source, shard, quota, cell_size, unnest(range(0, quota)) as k from cells where cell_size > 0)
), cellq as (
  select source, shard, count(*) as cell_quota from cq where r <= quota group by source, shard
), e as (
  select d.*, cell_size, coalesce(cell_quota, 0) as cell_quota,
    cast(coalesce(sum(size) over (partition by d.source, d.shard order by ord, doc_id nulls last, size rows between unbounded preceding and 1 preceding), 0) as bigint) as a
  from d join cells c on d.source is not distinct from c.source and d.shard = c.shard
    left join cellq q on d.source is not distinct from q.source and d.shard = q.shard
), f as (
  select *, least(cell_quota * block, 3 * cell_size) as want,
    (('0x' || substr(md5('mix-1-block:' || coalesce(source, '') || ':' || shard), 1, 8))::bigint % cast(greatest(1, ceil(cell_size / block::double)) as bigint)) * block as f
  from e
), g as (
  select *, case when cell_size > 0 then want // cell_size else 0 end as whole from f
), h as (
  select *, f + want - whole * cell_size as fin from g
)
select doc_id, source, size, source_size, target,
  cast(whole * size + greatest(0, least(a + size, least(fin, cell_size)) - greatest(a, f)) + greatest(0, least(a + size, fin - cell_size) - a) as bigint) as taken
from h
"""


@query("op5_mix_sources", OP5_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


# Every link's pairs within a label; only for tables small enough for all pairs, as here. No SQL is registered: on whole
# tables of production size all pairs are too slow, so the tests compare with brute force on a fixture.
@query("op6_embedding_dedup")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


@query("op1_language_id")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


@query("op8_token_files")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "token-files")
    files = token_files.write(table(spark, sf_dir, "documents"), folder, token_counts.tokenizer_path("word_bpe_49k.json"))
    return token_files.read(spark, folder, files, digests=True)


@query("op10_decontaminate")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.where("contaminated").select("doc_id", F.size("items").alias("n_items"), F.element_at("items", 1).alias("item_id"), "edits")


@query("op7_near_dedup")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


@query("op3_suffix_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.dedup(table(spark, sf_dir, "documents"))


@query("op9_license_scan")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    return licenses.documents(found).select("doc_id", F.array_join("licenses", ",").alias("licenses"), "n_blocks", F.round("saved", 4).alias("saved"))
