"""Registered queries of the engine's own operators, with the DuckDB SQL that must give the same rows.

Every query runs over its whole tables. Searches take as queries every row whose id is divisible by 50, against all rows.
Doubles are rounded alike on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitweave.functions import bits, similarity, text
from bitweave.operators import binarize, booleanizer, cluster, clause_machine, graph, hamming, landmarks, metrics, selection, setjoin, simhash, spectral
from bitweave.operators.corex import Corex
from bitweave.operators.pairs import maximum_spanning_tree, multiclass_pairs, numbered, random_pairs
from bitweave.session import stage, table
from bitweave.sources import datasets

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
DIM = 64


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def r6(c, name: str):
    return F.round(c, 6).alias(name)


# ---- shared pieces -------------------------------------------------------------------------------------------------


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("int").alias("label"))


def sign_codes(spark: SparkSession, d: str, n: int = DIM) -> DataFrame:
    return binarize.sign(vectors(spark, d), n).select("id", "code", "label")


def doc_bits(spark: SparkSession, d: str) -> DataFrame:
    """(id, feature): distinct lower-case words of two characters or more; features are words."""
    docs = table(spark, d, "documents")
    return docs.select(F.col("doc_id").alias("id"), F.explode(F.array_distinct(F.filter(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z]+"), F.lit(0)), lambda w: F.length(w) > 1))).alias("feature"))


def words_of(texts: DataFrame) -> DataFrame:
    """(id, features) of (id, text): the words that :func:`doc_bits` has, one row an id."""
    found = F.array_distinct(F.filter(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z]+"), F.lit(0)), lambda w: F.length(w) > 1))
    return texts.where("id is not null").select("id", found.alias("x")).groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("x"))).alias("features"))


def sets_of(texts: DataFrame) -> DataFrame:
    """(id, f) of (id, text): hashes of the words that :func:`doc_bits` has, one row an id."""
    found = F.array_distinct(F.filter(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z]+"), F.lit(0)), lambda w: F.length(w) > 1))
    rows = texts.where("id is not null").select("id", F.transform(found, lambda w: F.xxhash64(w)).alias("f"))
    return rows.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("f"))).alias("f"))


def doc_sets(spark: SparkSession, d: str) -> DataFrame:
    return sets_of(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"))


WORDS = """
docs as (select doc_id as id, lower(coalesce(text, '')) as t from documents),
allbits as (select distinct id, feature from (select id, unnest(regexp_extract_all(t, '[a-z]+')) as feature from docs) where length(feature) > 1),
df as (select feature, count(*) as df from allbits group by feature),
nn as (select count(*) as n from documents),
bits as (select id, feature from allbits)
"""

CODES = """
dims as (select vec_id as id, label, unnest(range(0, 64)) as i, unnest(embedding) as v from embeddings),
codes as (select id, any_value(label) as label, list(case when v >= 0 then 1 else 0 end order by i) as b from dims group by id)
"""
HAM = "list_sum(list_transform(range(1, 65), lambda i: case when x.b[i] <> y.b[i] then 1 else 0 end))"


# ---- codes and Hamming searches ------------------------------------------------------------------------------------


@query("binarize_sign", f"with {CODES} select id, cast(list_sum(b[1:32]) as bigint) as low_ones, cast(list_sum(b[33:64]) as bigint) as high_ones from codes")
def binarize_sign(spark, d):
    c = sign_codes(spark, d)
    return c.select("id", F.bit_count(F.element_at("code", 1)).cast("long").alias("low_ones"), F.bit_count(F.element_at("code", 2)).cast("long").alias("high_ones"))


@query("binarize_median", "with dims as (select vec_id as id, unnest(range(0, 64)) as dim, unnest(embedding)::double as v from embeddings) select cast(dim as int) as dim, round(quantile_cont(v, 0.5), 6) as threshold from dims group by dim")
def binarize_median(spark, d):
    return binarize.median_thresholds(vectors(spark, d)).select("dim", r6("threshold", "threshold"))


@query("binarize_otsu", """
with dims as (select unnest(range(0, 64)) as dim, unnest(embedding)::double as v from embeddings),
span as (select dim, min(v) as lo, max(v) as hi from dims group by dim),
h as (select dim, floor((v - lo) / (hi - lo) * 31) as bin, count(*)::double as c from dims join span using (dim) group by all),
g as (select s.dim, lo, hi, k as bin, coalesce(c, 0) as c, lo + (hi - lo) * (k + 0.5) / 32 as centre from (select *, unnest(range(0, 32)) as k from span) s left join h on h.dim = s.dim and h.bin = k),
w as (select *, sum(c) over (partition by dim) as n, sum(c) over u as c0, sum(c * centre) over u as m0, sum(c * centre) over (partition by dim) as mt from g window u as (partition by dim order by bin rows unbounded preceding)),
s as (select *, c0 / n * ((n - c0) / n) * pow(m0 / c0 - (mt - m0) / (n - c0), 2) as score from w where c0 > 0 and n - c0 > 0 and bin < 31),
best as (select dim, max(round(score, 9)) as score from s group by dim)
select cast(s.dim as int) as dim, round(min(lo + (hi - lo) * (bin + 1) / 32), 6) as threshold, round(any_value(best.score), 6) as score from s join best on s.dim = best.dim and round(s.score, 9) = best.score group by s.dim
""")
def binarize_otsu(spark, d):
    return binarize.otsu_thresholds(vectors(spark, d)).select("dim", r6("threshold", "threshold"), r6("score", "score"))


@query("hamming_topk", f"""
with {CODES}, d as (select x.id as src, y.id as dst, {HAM} as dist from codes x, codes y where x.id % 50 = 0 and x.id <> y.id)
select src, dst, cast(dist as int) as dist, cast(rank as int) as rank from (select *, row_number() over (partition by src order by dist, dst) as rank from d) where rank <= 5
""")
def hamming_topk(spark, d):
    c = hamming.create(sign_codes(spark, d))
    return hamming.exact(c.where("id % 50 = 0"), c, DIM, 5)


@query("hamming_range", f"""
with {CODES}, d as (select x.id as src, y.id as dst, {HAM} as dist from codes x, codes y where x.id % 50 = 0 and x.id <> y.id)
select src, dst, cast(dist as int) as dist, cast(row_number() over (partition by src order by dist, dst) as int) as rank from d where dist <= 20
""")
def hamming_range(spark, d):
    c = hamming.create(sign_codes(spark, d))
    return hamming.exact(c.where("id % 50 = 0"), c, DIM, 0, 0, 20)


#: 6 places, as for a thousand rows or two, probed within 3 bits: the tests hold the recall of the nearest against brute force.
PLACES, RADIUS = [1, 9, 20, 33, 41, 58], 3


@query("ann_probe_topk", f"""
with {CODES}, d as (select x.id as src, y.id as dst, {HAM} as dist from codes x, codes y where x.id % 50 = 0 and x.id <> y.id
  and list_sum(list_transform({[p + 1 for p in PLACES]}, lambda i: case when x.b[i] <> y.b[i] then 1 else 0 end)) <= {RADIUS})
select src, dst, cast(dist as int) as dist, cast(rank as int) as rank from (select *, row_number() over (partition by src order by dist, dst) as rank from d) where rank <= 10
""")
def ann_probe_topk(spark, d):
    c = hamming.create(sign_codes(spark, d))
    return hamming.bucketed(c.where("id % 50 = 0"), c, DIM, 10, PLACES, RADIUS)


@query("hbi_exact_topk", f"""
with {CODES}, d as (select x.id as src, y.id as dst, list_sum(list_transform(range(1, 33), lambda i: case when x.b[i] <> y.b[i] then 1 else 0 end)) as dist from codes x, codes y where x.id % 50 = 0 and x.id <> y.id)
select src, dst, cast(dist as int) as dist, cast(rank as int) as rank from (select *, row_number() over (partition by src order by dist, dst) as rank from d) where rank <= 8
""")
def hbi_exact_topk(spark, d):
    c = sign_codes(spark, d).select("id", F.array(bits.low_bits(F.col("code"), 32)).alias("code"))
    return hamming.exact(c.where("id % 50 = 0"), c, 32, 8)


@query("hbi_mutual_knn", f"""
with {CODES}, d as (select x.id as src, y.id as dst, list_sum(list_transform(range(1, 33), lambda i: case when x.b[i] <> y.b[i] then 1 else 0 end)) as dist from codes x, codes y where x.id <> y.id),
h as (select * from (select *, row_number() over (partition by src order by dist, dst) as rank from d) where rank <= 6),
m as (select a.src, a.dst, least(a.dist, b.dist) as dist from h a join h b on a.src = b.dst and a.dst = b.src), n as (select src from m group by src having count(*) >= 2)
select src, dst, cast(dist as int) as dist, cast(row_number() over (partition by src order by dist, dst) as int) as rank from m where src in (select src from n) and dst in (select src from n)
""")
def hbi_mutual_knn(spark, d):
    c = sign_codes(spark, d).select("id", F.array(bits.low_bits(F.col("code"), 32)).alias("code"))
    return setjoin.mutualize(hamming.exact(c, c, 32, 6), 2)


@query("hamming_by_vecs", f"""
with {CODES}, q as (select id, label, list_reverse(b) as b from codes where id % 50 = 0),
d as (select x.id as src, y.id as dst, {HAM} as dist from q x, codes y)
select src, dst, cast(dist as int) as dist, cast(rank as int) as rank from (select *, row_number() over (partition by src order by dist, dst) as rank from d) where rank <= 3
""")
def hamming_by_vecs(spark, d):
    c = sign_codes(spark, d)
    q = c.where("id % 50 = 0").select("id", bits.pack(F.reverse(bits.unpack(F.col("code"), DIM)), DIM).alias("code"))
    return hamming.exact(q, hamming.create(c), DIM, 3, exclude_self=False)


@query("code_fetch", f"with {CODES}, q as (select id + 250 as id from codes) select q.id, cast(coalesce(list_sum(b), 0) as bigint) as ones from q left join codes using (id)")
def code_fetch(spark, d):
    c = sign_codes(spark, d).select("id", "code")
    got = bits.fetch(c, c.select((F.col("id") + 250).alias("id")), DIM)
    return got.select("id", F.aggregate("code", F.lit(0).cast("long"), lambda s, x: s + F.bit_count(x)).alias("ones"))


@query("literal_bits", f"with {CODES}, l as (select id, list_concat(list_filter(range(0, 64), lambda i: b[i + 1] = 1), list_transform(list_filter(range(0, 64), lambda i: b[i + 1] = 0), lambda i: i + 64)) as l from codes) select id, len(l)::int as n, cast(list_sum(l) as bigint) as total from l")
def literal_bits(spark, d):
    on = F.filter(F.transform(bits.unpack(F.col("code"), DIM), lambda b, i: F.when(b == 1, i.cast("long"))), lambda i: i.isNotNull())
    lit = bits.literals(on, DIM)
    return sign_codes(spark, d).select("id", lit.alias("l")).select("id", F.size("l").alias("n"), F.aggregate("l", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))


@query("mutual_knn", f"""
with {CODES}, d as (select x.id as src, y.id as dst, {HAM} as dist from codes x, codes y where x.id <> y.id and list_sum(list_transform({[p + 1 for p in PLACES]}, lambda i: case when x.b[i] <> y.b[i] then 1 else 0 end)) <= {RADIUS}),
h as (select * from (select *, row_number() over (partition by src order by dist, dst) as rank from d) where rank <= 4)
select a.src, a.dst, cast(least(a.dist, b.dist) as int) as dist, cast(row_number() over (partition by a.src order by least(a.dist, b.dist), a.dst) as int) as rank from h a join h b on a.src = b.dst and a.dst = b.src
""")
def mutual_knn(spark, d):
    c = hamming.create(sign_codes(spark, d))
    return setjoin.mutualize(hamming.bucketed(c, c, DIM, 4, PLACES, RADIUS))


# ---- booleanizer ----------------------------------------------------------------------------------------------------


def eav(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    s = F.struct
    none_s, none_n = F.lit(None).cast("string"), F.lit(None).cast("double")
    each = F.array(
        s(F.lit("segment").alias("attr"), F.col("c_mktsegment").alias("value_str"), none_n.alias("value_num")),
        s(F.lit("nation").alias("attr"), none_s.alias("value_str"), F.col("c_nationkey").cast("double").alias("value_num")),
        s(F.lit("balance").alias("attr"), none_s.alias("value_str"), F.col("c_acctbal").cast("double").alias("value_num")),
    )
    return c.select(F.col("c_custkey").cast("long").alias("id"), F.explode(each).alias("x")).select("id", "x.*")


@query("bool_quantile", "with v as (select distinct c_acctbal::double as v from customer), n as (select distinct c_nationkey::double as v from customer) select 'balance' as attr, round(unnest(quantile_cont(v, [0.2, 0.4, 0.6, 0.8])), 6) as threshold from v union all select 'nation', round(unnest(quantile_cont(v, [0.2, 0.4, 0.6, 0.8])), 6) from n")
def bool_quantile(spark, d):
    b = booleanizer.Booleanizer(n_thresholds=4).fit(eav(spark, d))
    return b.where("kind = 'continuous'").select("attr", r6("threshold", "threshold"))


@query("bool_max_gap", """
with v as (select distinct attr, v from (select 'balance' as attr, c_acctbal::double as v from customer union all select 'nation', c_nationkey::double from customer)),
g as (select attr, v, lag(v) over (partition by attr order by v) as b from v)
select attr, round(coalesce((select (b + v) / 2 from g x where x.attr = g.attr and v - b > 0 order by v - b desc, v limit 1), avg(v)), 6) as threshold from g group by attr
""")
def bool_max_gap(spark, d):
    b = booleanizer.Booleanizer(n_thresholds=0).fit(eav(spark, d))
    return b.where("kind = 'continuous'").select("attr", r6("threshold", "threshold"))


BOOL_BITS = """
seg as (select distinct c_mktsegment as v from customer),
q as (select unnest(quantile_cont(v, [0.25, 0.5, 0.75])) as t from (select distinct c_acctbal::double as v from customer)),
n as (select distinct c_nationkey::double as v from customer),
bits as (select row_number() over (order by attr, kind, v nulls first, t) - 1 as bit, * from (
  select 'balance' as attr, 'continuous' as kind, null as v, t from q union all select 'nation', 'categorical', v::varchar, null from n union all select 'segment', 'categorical', v, null from seg))
"""


@query("bool_encode_eav", f"""
with {BOOL_BITS}
select c_custkey::bigint as id, bit::bigint as bit from customer join bits on (attr = 'segment' and v = c_mktsegment) or (attr = 'nation' and v = c_nationkey::double::varchar) or (attr = 'balance' and c_acctbal::double > t)
""")
def bool_encode_eav(spark, d):
    rows = eav(spark, d)
    b = booleanizer.Booleanizer(n_thresholds=3, categorical=("nation",)).fit(rows)
    return booleanizer.encode(rows, b)


@query("bool_encode_matrix", """
with d as (select vec_id as id, unnest(range(0, 64)) as i, unnest(embedding)::double as v from embeddings), t as (select i, quantile_cont(v, 0.5) as t from (select distinct i, v from d) group by i)
select id, count(*) as n_bits from d join t using (i) where v >= t group by id
""")
def bool_encode_matrix(spark, d):
    rows = booleanizer.matrix(vectors(spark, d), "id", "embedding")
    b = booleanizer.Booleanizer(n_thresholds=1).fit(rows)
    return booleanizer.encode(rows, b, inclusive=True).groupBy("id").agg(F.count(F.lit(1)).alias("n_bits"))


@query("bool_restrict", f"with {BOOL_BITS} select row_number() over (order by bit) - 1 as bit, attr from bits where attr <> 'nation'")
def bool_restrict(spark, d):
    b = booleanizer.Booleanizer(n_thresholds=3, categorical=("nation",)).fit(eav(spark, d))
    return booleanizer.restrict(b, ["balance", "segment"]).select("bit", "attr")


# ---- text, selection, set similarity --------------------------------------------------------------------------------


@query("doc_df_idf", f"with {WORDS} select feature, df, round(ln(n / df), 6) as idf from df, nn where df >= 2")
def doc_df_idf(spark, d):
    b = doc_bits(spark, d)
    return selection.document_frequency(b, table(spark, d, "documents").count(), 2).select("feature", "df", r6("idf", "idf"))


CONT = f"""
with {WORDS}, lab as (select doc_id as id, quality as label from labels where quality is not null), nl as (select label, count(*) as nx1 from lab group by label),
both_ as (select feature, label, count(*) as n11 from bits join lab using (id) group by all), f as (select feature, sum(n11) as n1x from both_ group by feature),
t as (select f.feature, nl.label, coalesce(n11, 0)::double as a, n1x::double as r, nx1::double as c, (select count(*) from lab)::double as n from f, nl left join both_ b on b.feature = f.feature and b.label = nl.label),
e as (select *, r * c / n as e1, r * (n - c) / n as e2, (n - r) * c / n as e3, (n - r) * (n - c) / n as e4 from t)
"""


def label_table(spark, d) -> DataFrame:
    lab = table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("label"))
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    named = texts.join(lab.where("label is not null").select("id").distinct(), "id", "left_semi")  # others count in no cell
    return selection.contingency(words_of(named), lab)


@query("chi2_features", CONT + "select feature, round(max(case when e1 > 0 then pow(a - e1, 2) / e1 else 0 end + case when e2 > 0 then pow(r - a - e2, 2) / e2 else 0 end + case when e3 > 0 then pow(c - a - e3, 2) / e3 else 0 end + case when e4 > 0 then pow(n - r - c + a - e4, 2) / e4 else 0 end), 6) as score from e group by feature")
def chi2_features(spark, d):
    return selection.chi2(label_table(spark, d)).groupBy("feature").agg(r6(F.max("score"), "score"))


@query("mi_features", CONT + "select feature, label, round(case when a > 0 then a / n * ln(a / e1) else 0 end + case when r - a > 0 then (r - a) / n * ln((r - a) / e2) else 0 end + case when c - a > 0 then (c - a) / n * ln((c - a) / e3) else 0 end + case when n - r - c + a > 0 then (n - r - c + a) / n * ln((n - r - c + a) / e4) else 0 end, 6) as score from e")
def mi_features(spark, d):
    return selection.mutual_information(label_table(spark, d)).select("feature", "label", r6("score", "score"))


@query("chi2_per_class", CONT + ", s as (select feature, label, round(case when e1 > 0 then pow(a - e1, 2) / e1 else 0 end + case when e2 > 0 then pow(r - a - e2, 2) / e2 else 0 end + case when e3 > 0 then pow(c - a - e3, 2) / e3 else 0 end + case when e4 > 0 then pow(n - r - c + a - e4, 2) / e4 else 0 end, 6) as score from e) select label, feature, score, cast(rank as int) as rank from (select *, row_number() over (partition by label order by score desc, feature) - 1 as rank from s) where rank < 20")
def chi2_per_class(spark, d):
    s = selection.chi2(label_table(spark, d)).withColumn("score", F.round("score", 6))
    return selection.top_per_label(s, 20)


@query("bit_entropy", f"with {CODES}, p as (select i, avg(case when v >= 0 then 1.0 else 0 end) as p from dims group by i) select cast(i as int) as bit, round(p, 6) as p, round(case when p > 0 and p < 1 then -p * log2(p) - (1 - p) * log2(1 - p) else 0 end, 6) as entropy from p")
def bit_entropy(spark, d):
    return selection.bit_entropy(sign_codes(spark, d), bits.unpack(F.col("code"), DIM)).select("bit", r6("p", "p"), r6("entropy", "entropy"))


def _set_query(name: str, expr: str, c: setjoin.Compare) -> None:
    sql = f"""
with {WORDS}, s as (select id, count(*)::double as s from bits group by id),
m as (select x.id as src, y.id as dst, count(*)::double as i from bits x join bits y using (feature) where x.id % 50 = 0 and x.id <> y.id group by all),
d as (select src, dst, round(1 - {expr}, 9) as dist from m join s sa on sa.id = src join s sb on sb.id = dst)
select src, dst, round(dist, 6) as dist, cast(rank as int) as rank from (select *, row_number() over (partition by src order by dist, dst) as rank from d) where rank <= 5
"""

    def run(spark, d):
        sets = doc_sets(spark, d)
        return setjoin.search_sets(sets.where("id % 50 = 0"), sets, 5, c, digits=9).select("src", "dst", r6("dist", "dist"), "rank")

    query(name, sql)(run)


_set_query("jaccard_topk", "i / (sa.s + sb.s - i)", setjoin.Compare("jaccard"))
_set_query("overlap_topk", "i / least(sa.s, sb.s)", setjoin.Compare("overlap"))
_set_query("dice_topk", "2 * i / (sa.s + sb.s)", setjoin.Compare("dice"))
_set_query("tversky_topk", "i / (i + 1.0 * (sa.s - i) + 0.1 * (sb.s - i))", setjoin.Compare("tversky", 1.0, 0.1))


def ranked_sets(spark, d) -> DataFrame:
    """(id, f, r, w): source and language of a document at rank 0, its words at rank 1, weighed by idf; features by hash."""
    docs = table(spark, d, "documents")
    b = doc_sets(spark, d).select("id", F.explode("f").alias("f"))
    weights = b.groupBy("f").agg(F.log(F.lit(docs.count()) / F.count(F.lit(1))).alias("w"))
    top = F.array(*[F.xxhash64(F.concat(F.lit(f"{kind}:"), F.coalesce(col, F.lit("")))) for kind, col in (("src", "source"), ("lang", "lang"))])
    top = docs.where("doc_id is not null").select(F.col("doc_id").alias("id"), F.explode(top).alias("f"), F.lit(0).alias("r"), F.lit(1.0).alias("w")).distinct()
    rows = b.join(weights, "f").select("id", "f", F.lit(1).alias("r"), "w").unionByName(top)
    x = rows.groupBy("id").agg(F.collect_list(F.struct("f", "r", "w")).alias("x"))
    return stage(x.select("id", "x.f", "x.r", "x.w"), "sets")


RANKED = f"""
with {WORDS}, w as (select feature, ln((select n from nn) / count(*)) as w from bits group by feature),
ix as (select id, feature, 1 as rank, w from bits join w using (feature) union all select doc_id, 'src:' || coalesce(source, ''), 0, 1.0 from documents union all select doc_id, 'lang:' || coalesce(lang, ''), 0, 1.0 from documents),
s as (select id, rank, sum(w) as s from ix group by all),
m as (select x.id as src, y.id as dst, x.rank, sum(x.w) as i from ix x join ix y on x.feature = y.feature where x.id % 50 = 0 and x.id <> y.id group by all),
p as (select src, dst, m.rank, i / (sa.s + sb.s - i) as sim from m join s sa on sa.id = src and sa.rank = m.rank join s sb on sb.id = dst and sb.rank = m.rank)
"""


@query("ranked_jaccard_topk", RANKED + ", d as (select src, dst, round(1 - sum(sim * exp(-rank * 0.5)) / (1 + exp(-0.5)), 9) as dist from p group by src, dst) select src, dst, round(dist, 6) as dist, cast(rank as int) as rank from (select *, row_number() over (partition by src order by dist, dst) as rank from d) where rank <= 5")
def ranked_jaccard_topk(spark, d):
    sets = ranked_sets(spark, d)
    return setjoin.search_sets(sets.where("id % 50 = 0"), sets, 5, setjoin.Compare(decay=0.5, n_ranks=2), digits=9).select("src", "dst", r6("dist", "dist"), "rank")


@query("rank_filtered_topk", RANKED + ", d as (select src, dst, round(1 - sim * exp(-0.5) / (1 + exp(-0.5)), 9) as dist from p where rank = 1) select src, dst, round(dist, 6) as dist, cast(rank as int) as rank from (select *, row_number() over (partition by src order by dist, dst) as rank from d) where rank <= 5")
def rank_filtered_topk(spark, d):
    sets = ranked_sets(spark, d)
    return setjoin.search_sets(sets.where("id % 50 = 0"), sets, 5, setjoin.Compare(rank_filter=1, decay=0.5, n_ranks=2), digits=9).select("src", "dst", r6("dist", "dist"), "rank")


BASKETS = "b as (select distinct l_orderkey as id, l_partkey as f from lineitem), s as (select id, count(*)::double as s from b group by id), m as (select x.id as src, y.id as dst, count(*)::double as i from b x join b y using (f) where x.id <> y.id group by all), d as (select src, dst, round(1 - i / (sa.s + sb.s - i), 9) as dist from m join s sa on sa.id = src join s sb on sb.id = dst)"


def basket_index(spark, d) -> DataFrame:
    return setjoin.create(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("feature")))


@query("index_neighborhoods", f"with {BASKETS} select src, dst, round(dist, 6) as dist, cast(rank as int) as rank from (select *, row_number() over (partition by src order by dist, dst) as rank from d where dist <= 0.8) where rank <= 3")
def index_neighborhoods(spark, d):
    """All rows among themselves: features of baskets are never hot."""
    return setjoin.best(setjoin.near_pairs(basket_index(spark, d), 0.2), 3, 0.0, 0.8).select("src", "dst", r6("dist", "dist"), "rank")


@query("index_neighbors", f"with {BASKETS} select src, dst, round(dist, 6) as dist, cast(row_number() over (order by dist, dst) as int) as rank from d where src = 1")
def index_neighbors(spark, d):
    return setjoin.neighbors(basket_index(spark, d), 1).select("src", "dst", r6("dist", "dist"), "rank")


@query("index_by_vecs", f"""
with {WORDS}, q as (select distinct id, feature from (select item_id as id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+')) as feature from benchmark) where length(feature) > 1),
sq as (select id, count(*)::double as s from q group by id), s as (select id, count(*)::double as s from bits group by id), m as (select x.id as src, y.id as dst, count(*)::double as i from q x join bits y using (feature) group by all),
d as (select src, dst, round(1 - i / least(sq.s, s.s), 9) as dist from m join sq on sq.id = src join s on s.id = dst)
select src, dst, round(dist, 6) as dist, cast(rank as int) as rank from (select *, row_number() over (partition by src order by dist, dst) as rank from d) where rank <= 3
""")
def index_by_vecs(spark, d):
    q = sets_of(table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text"))
    return setjoin.search_sets(q, doc_sets(spark, d), 3, setjoin.Compare("overlap"), exclude_self=False, digits=9).select("src", "dst", r6("dist", "dist"), "rank")


@query("index_remove_keep", f"with {WORDS} select count(distinct id) as size, count(distinct feature) as features, 1::bigint as ranks from bits where id not in (select doc_id from labels where toxic = 1) and id in (select doc_id from labels)")
def index_remove_keep(spark, d):
    ix = setjoin.create(doc_bits(spark, d))
    lab = table(spark, d, "labels").select(F.col("doc_id").alias("id"), "toxic")
    return setjoin.describe(setjoin.keep(setjoin.remove(ix, lab.where("toxic = 1")), lab))


@query("clean_text", "select conv_id, turn, trim(regexp_replace(regexp_replace(array_to_string(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: not regexp_matches(ltrim(x), '^[>|%:]')), chr(10)), '\\S+@\\S+', ' ', 'g'), '(?i)\\b[\\w-]+(\\.[\\w-]+)*\\.(edu|com|org|net|gov)\\b', ' ', 'g')) as cleaned from conversations")
def clean_text(spark, d):
    c = table(spark, d, "conversations")
    return c.select("conv_id", "turn", text.clean_posting(F.coalesce("text", F.lit(""))).alias("cleaned"))


@query("text_features", "with w as (select doc_id, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+'), lambda x: length(x) between 1 and 40) as w from (select item_id as doc_id, regexp_replace(text, '[^ -~]', ' ', 'g') as text from benchmark)) select doc_id, len(list_distinct(list_concat(w, list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1]))))::int as n from w")
def text_features(spark, d):
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), F.regexp_replace("text", "[^ -~]", " ").alias("text"))
    t = F.regexp_replace(F.col("text"), "[^A-Za-z]", " ")
    return b.select("doc_id", F.size(text.tokens(t, ngram=2)).alias("n"))


@query("split_dataset", "with r as (select doc_id, row_number() over (order by doc_id) - 1 as r, count(*) over () as n from documents) select doc_id as id, case when r < floor(n * 0.8) - floor(floor(n * 0.8) * 0.25) then 'train' when r < floor(n * 0.8) then 'validate' else 'test' end as split from r")
def split_dataset(spark, d):
    return datasets.split(table(spark, d, "documents").select(F.col("doc_id").alias("id")), 0.8, 0.25)


@query("classes_index", "with f as (select source, min(doc_id) as f from documents where source is not null group by source), n as (select source, row_number() over (order by f) - 1 as feature from f) select doc_id as id, feature::bigint as feature from documents join n using (source)")
def classes_index(spark, d):
    return datasets.classes_index(table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("class")))


# ---- metrics --------------------------------------------------------------------------------------------------------

CHUNK = "cast(i / 8 as int)"


@query("class_accuracy", "with r as (select cast(label % 10 as int) as e, cast((label + vec_id % 3) % 10 as int) as p from embeddings where label is not null), l as (select unnest(range(0, 10))::int as label), c as (select label, (select count(*) from r where e = label and p = label)::double as tp, (select count(*) from r where p = label) as np, (select count(*) from r where e = label) as ne from l), m as (select label, case when np > 0 then tp / np else 0 end as precision, case when ne > 0 then tp / ne else 0 end as recall from c) select label, round(precision, 6) as precision, round(recall, 6) as recall, round(case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0 end, 6) as f1 from m")
def class_accuracy(spark, d):
    v = vectors(spark, d).where("label is not null").select((F.col("label") % 10).alias("expected"), ((F.col("label") + F.col("id") % 3) % 10).cast("int").alias("predicted"))
    m = metrics.class_accuracy(v, 10)
    return m.select("label", r6("precision", "precision"), r6("recall", "recall"), r6("f1", "f1"))


@query("encoding_accuracy", "with d as (select unnest(range(0, 64)) as i, unnest(embedding)::double as v from embeddings), e as (select i, avg(case when (v >= 0) <> (v >= 0.05) then 1.0 else 0 end) as e from d group by i) select round(1 - avg(e), 6) as mean_hamming, round(1 - min(e), 6) as ber_min, round(1 - max(e), 6) as ber_max, round(stddev_samp(e), 6) as ber_std from e")
def encoding_accuracy(spark, d):
    v = vectors(spark, d)
    rows = v.select(bits.pack(binarize.at_least(F.col("embedding"), [0.0] * DIM), DIM).alias("expected"), bits.pack(binarize.at_least(F.col("embedding"), [0.05] * DIM), DIM).alias("predicted"))
    m = metrics.encoding_accuracy(rows, DIM)
    return m.select(*[r6(c, c) for c in m.columns])


@query("entropy_stats", f"with {CODES}, p as (select i, avg(case when v >= 0 then 1.0 else 0 end) as p from dims group by i), e as (select case when p > 0 and p < 1 then -p * log2(p) - (1 - p) * log2(1 - p) else 0 end as e from p) select round(avg(e), 6) as mean, round(min(e), 6) as min, round(max(e), 6) as max, round(stddev_pop(e), 6) as std from e")
def entropy_stats(spark, d):
    m = metrics.entropy_stats(sign_codes(spark, d), DIM)
    return m.select(*[r6(c, c) for c in m.columns])


def ring(spark, d) -> DataFrame:
    """Edges of each vector to those 1, 2 and 3 ids on, where they exist, weighed 1, 1/2 and 1/3."""
    v = vectors(spark, d).select("id")
    e = v.select(F.col("id").alias("src"), F.explode(F.array(*[F.lit(k) for k in (1, 2, 3)])).alias("k")).select("src", (F.col("src") + F.col("k")).alias("dst"), (1.0 / F.col("k")).alias("weight"))
    return e.join(v.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst", "weight")


RING = "v as (select vec_id as id, label from embeddings), ring as (select a.id as src, a.id + k as dst, 1.0::double / k as weight from (select id, unnest([1, 2, 3]) as k from v) a join v b on b.id = a.id + k)"


@query("clustering_accuracy", f"with {RING}, n as (select src, min(weight) as s from ring join v a on a.id = src join v b on b.id = dst where a.label = b.label and a.label >= 0 group by src) select round(avg(s), 6) as score from n")
def clustering_accuracy(spark, d):
    a = vectors(spark, d).select("id", F.col("label").alias("cluster"))
    return metrics.clustering_accuracy(a, ring(spark, d)).select(r6("score", "score"))


@query("retrieval_mean", f"with {CODES}, {RING}, d as (select src, weight, {HAM} as h from ring join codes x on x.id = src join codes y on y.id = dst), n as (select src, avg(weight) as s from d where h <= 30 group by src) select round(avg(s), 6) as score from n")
def retrieval_mean(spark, d):
    return metrics.retrieval_accuracy(ring(spark, d), sign_codes(spark, d), 30).select(r6("score", "score"))


@query("retrieval_least", f"with {CODES}, {RING}, d as (select src, weight, {HAM} as h from ring join codes x on x.id = src join codes y on y.id = dst), n as (select src, min(weight) as s from d where h <= 30 group by src) select round(avg(s), 6) as score from n")
def retrieval_least(spark, d):
    return metrics.retrieval_accuracy(ring(spark, d), sign_codes(spark, d), 30, "min").select(r6("score", "score"))


@query("retrieval_variance", f"with {CODES}, {RING}, d as (select src, weight, {HAM} as h from ring join codes x on x.id = src join codes y on y.id = dst), a as (select src, var_pop(weight) as v from d group by src), n as (select src, var_pop(weight) as v from d where h <= 30 group by src) select round(avg(case when a.v > 0 then 1 - n.v / a.v else 0 end), 6) as score from n join a using (src)")
def retrieval_variance(spark, d):
    return metrics.retrieval_accuracy(ring(spark, d), sign_codes(spark, d), 30, "variance").select(r6("score", "score"))


@query("ndcg_at_k", f"""
with {CODES}, {RING}, g as (select src, dst, weight, row_number() over (partition by src order by {HAM}, dst) as i, row_number() over (partition by src order by weight desc, dst) as j from ring join codes x on x.id = src join codes y on y.id = dst),
n as (select src, sum(weight / log2(i + 1)) / sum(weight / log2(j + 1)) as s from g group by src) select round(avg(s), 6) as score, count(*) as total_queries from n
""")
def ndcg_at_k(spark, d):
    e = ring(spark, d)
    got = hamming.pair_distances(hamming.create(sign_codes(spark, d)), e, DIM).select("src", "dst", (1 - F.col("dist")).alias("weight"))
    return metrics.score_retrieval(got, e, DIM).select(r6("score", "score"), "total_queries")


@query("spearman_retrieval", f"""
with {CODES}, {RING}, g as (select src, dst, weight, {HAM} as h from ring join codes x on x.id = src join codes y on y.id = dst),
r as (select src, rank() over (partition by src order by -h) + (count(*) over (partition by src, h) - 1) / 2.0 as x, rank() over (partition by src order by weight) + (count(*) over (partition by src, weight) - 1) / 2.0 as y from g),
n as (select src, case when stddev_pop(x) > 0 and stddev_pop(y) > 0 then corr(x, y) else 0 end as s from r group by src) select round(avg(s), 6) as score, count(*) as total_queries from n
""")
def spearman_retrieval(spark, d):
    e = ring(spark, d)
    got = hamming.pair_distances(hamming.create(sign_codes(spark, d)), e, DIM).select("src", "dst", (1 - F.col("dist")).alias("weight"))
    return metrics.score_retrieval(got, e, DIM, "spearman").select(r6("score", "score"), "total_queries")


# ---- graphs ---------------------------------------------------------------------------------------------------------


def doc_graph(spark, d) -> DataFrame:
    """Ring edges with their Hamming distance as a share."""
    e = ring(spark, d).select("src", "dst")
    return hamming.pair_distances(hamming.create(sign_codes(spark, d)), e, DIM).select("src", "dst", "dist")


GRAPH = f"{CODES}, {RING}, e as (select src, dst, {HAM} / 64.0::double as dist from ring join codes x on x.id = src join codes y on y.id = dst)"


@query("graph_weights_sigma", f"""
with {GRAPH}, both_ as (select src, dst, dist from e union all select dst, src, dist from e), s as (select src as id, max(dist) as s from (select *, row_number() over (partition by src order by dist, dst) as r from both_) where r <= 3 group by src)
select src, dst, round(dist, 6) as dist, round(least(1, greatest(1e-8, exp(-dist * dist / (2 * a.s * b.s)))), 6) as weight from e join s a on a.id = src join s b on b.id = dst
""")
def graph_weights_sigma(spark, d):
    w = graph.weights(doc_graph(spark, d), "sigma", 3)
    return w.select("src", "dst", r6("dist", "dist"), r6("weight", "weight"))


@query("graph_weights_linear", f"with {GRAPH} select src, dst, round(least(1, greatest(1e-8, 1 - dist)), 6) as weight from e")
def graph_weights_linear(spark, d):
    return graph.weights(doc_graph(spark, d)).select("src", "dst", r6("weight", "weight"))


@query("graph_knn_edges", f"""
with {CODES}, d as (select x.id as src, y.id as dst, {HAM} as dist from codes x, codes y where x.id % 50 = 0 and x.id <> y.id), h as (select * from (select *, row_number() over (partition by src order by dist, dst) as rank from d) where rank <= 3)
select least(src, dst) as src, greatest(src, dst) as dst, cast(min(dist) as int) as dist from h group by 1, 2
""")
def graph_knn_edges(spark, d):
    c = hamming.create(sign_codes(spark, d))
    return graph.knn_edges(hamming.exact(c.where("id % 50 = 0"), c, DIM, 3), 3, DIM)


@query("graph_components", """
with recursive v as (select vec_id as id, label from embeddings where label is not null), e as (select a.id as src, a.id + 10 as dst from v a join v b on b.id = a.id + 10 where a.label % 3 = b.label % 3),
m as (select id, id as c from v union select case when e.src = m.id then e.dst else e.src end, m.c from m join e on e.src = m.id or e.dst = m.id)
select id, min(c) as component from m group by id
""")
def graph_components(spark, d):
    v = vectors(spark, d).where("label is not null").select("id", "label")
    e = v.select(F.col("id").alias("src"), (F.col("id") + 10).alias("dst"), (F.col("label") % 3).alias("a")).join(v.select(F.col("id").alias("dst"), (F.col("label") % 3).alias("b")), "dst").where("a = b").select("src", "dst")
    return graph.components(e, v)


@query("graph_bridge_mst")
def graph_bridge_mst(spark, d):
    """Thinned ring, bridged: one component, checked in the tests."""
    e = stage(doc_graph(spark, d), "graph")
    nodes = vectors(spark, d).select("id")
    b = graph.bridge_mst(e.where("dist < 0.4"), e, nodes)
    return b.select("src", "dst", r6("dist", "dist"))


@query("graph_cknn_edges")
def graph_cknn_edges(spark, d):
    e = stage(doc_graph(spark, d), "graph")
    h = setjoin.best(graph.symmetric(e), 3)
    return graph.cknn_edges(e, h, 3, 4.0).select("src", "dst", r6("dist", "dist"))


@query("graph_anchor_edges", """
with c as (select vec_id as id, label as category from embeddings where label is not null), h as (select *, row_number() over (partition by category order by ('0x' || substr(md5('anchors:' || category || ':' || id), 1, 8))::bigint, id) as r from c),
m as (select c.id, c.category, h.id as a from c join h using (category) where h.r <= 4 and c.id <> h.id), p as (select *, row_number() over (partition by id, category order by ('0x' || substr(md5('anchors:' || id || ':' || a), 1, 8))::bigint, a) as p from m)
select distinct least(id, a) as src, greatest(id, a) as dst from p where p <= 2
""")
def graph_anchor_edges(spark, d):
    c = vectors(spark, d).where("label is not null").select("id", F.col("label").alias("category"))
    return graph.anchor_edges(c, 4, 2)


@query("random_pairs", "with r as (select id, row_number() over (order by id) - 1 as r, count(*) over () as n from (select distinct vec_id as id from embeddings)), p as (select id, (r + 1 + ('0x' || substr(md5('pairs:' || id || ':' || j), 1, 8))::bigint % (n - 1)) % n as o from (select *, unnest([0, 1]) as j from r)) select distinct least(p.id, r.id) as src, greatest(p.id, r.id) as dst from p join r on r.r = p.o")
def random_pairs_query(spark, d):
    return random_pairs(vectors(spark, d).select("id"), 2)


BOTH = "both_ as (select src, dst, weight from ring union all select dst, src, weight from ring)"


@query("graph_bipartite", "select distinct vec_id as src, label + 10000000::bigint as dst from embeddings where label is not null")
def graph_bipartite(spark, d):
    b = vectors(spark, d).where("label is not null").select("id", F.col("label").alias("feature"))
    return graph.bipartite_edges(b, 10_000_000)


@query("graph_seed_edges", "with r as (select vec_id as id, row_number() over (order by vec_id) - 1 as r, count(*) over () as n from embeddings), p as (select a.id as a, b.id as b from (select *, unnest([1, 7]) as k from r) a join r b on b.r = (a.r + k) % a.n) select distinct least(a, b) as src, greatest(a, b) as dst from p where a <> b")
def graph_seed_edges(spark, d):
    ids = numbered(vectors(spark, d).select("id")).select("row", "id")
    n = ids.count()
    csr = ids.select("row", F.array((F.col("row") + 1) % n, (F.col("row") + 7) % n).alias("neighbors"))
    return graph.seed_edges(csr, ids)


@query("graph_largest", """
with recursive v as (select vec_id as id, label from embeddings where label is not null), e as (select a.id as src, a.id + 10 as dst from v a join v b on b.id = a.id + 10 where a.label % 3 = b.label % 3),
m as (select id, id as c from v union select case when e.src = m.id then e.dst else e.src end, m.c from m join e on e.src = m.id or e.dst = m.id),
c as (select id, min(c) as c from m group by id), top as (select c from c group by c order by count(*) desc, c limit 1)
select src, dst from e join c on c.id = src join top using (c)
""")
def graph_largest(spark, d):
    v = vectors(spark, d).where("label is not null").select("id", "label")
    e = v.select(F.col("id").alias("src"), (F.col("id") + 10).alias("dst"), (F.col("label") % 3).alias("a")).join(v.select(F.col("id").alias("dst"), (F.col("label") % 3).alias("b")), "dst").where("a = b").select("src", "dst")
    return graph.largest(e, v)


@query("graph_rows", f"with {RING}, {BOTH} select src as id, count(*) as n, round(sum(weight), 6) as total, string_agg(dst, ',' order by weight desc, dst) as neighbors from both_ group by src")
def graph_rows(spark, d):
    r = graph.adjacency_rows(ring(spark, d))
    return r.select("id", F.size("neighbors").cast("long").alias("n"), r6(F.aggregate("weights", F.lit(0.0), lambda a, w: a + w), "total"), F.concat_ws(",", F.transform("neighbors", lambda x: x.cast("string"))).alias("neighbors"))


@query("graph_pair_adjacency", f"with {RING}, p as (select src, dst, case when weight > 0.4 then 1.0::double else 0.0::double end as weight from ring where src % 3 <> 0 and dst % 3 <> 0) select src, dst, weight from p union all select dst, src, weight from p")
def graph_pair_adjacency(spark, d):
    e = ring(spark, d)
    return graph.pair_adjacency(vectors(spark, d).where("id % 3 <> 0").select("id"), e.where("weight > 0.4"), e.where("weight <= 0.4"))


@query("graph_hood_adjacency", f"with {CODES}, d as (select x.id as src, y.id as dst, {HAM} as dist from codes x, codes y where x.id % 50 = 0 and x.id <> y.id) select src, dst, round(1 - dist / 64.0::double, 6) as weight from (select *, row_number() over (partition by src order by dist, dst) as rank from d) where rank <= 4")
def graph_hood_adjacency(spark, d):
    c = hamming.create(sign_codes(spark, d))
    return graph.hood_adjacency(hamming.exact(c.where("id % 50 = 0"), c, DIM, 4), DIM).select("src", "dst", r6("weight", "weight"))


@query("graph_edge_weight", f"with {RING}, {BOTH}, p as (select id as src, id + k as dst from (select id, unnest([-2, 1, 5]) as k from v)) select p.src, p.dst, round(coalesce(weight, 0), 6) as weight from p left join both_ b on b.src = p.src and b.dst = p.dst")
def graph_edge_weight(spark, d):
    p = vectors(spark, d).select(F.col("id").alias("src"), F.explode(F.array(*[F.col("id") + k for k in (-2, 1, 5)])).alias("dst"))
    return graph.edge_weight(ring(spark, d), p).select("src", "dst", r6("weight", "weight"))


@query("graph_pooled", f"with {RING}, w as (select src, dst, weight as dist from ring union all select dst, src, weight * (1 + src % 3) / 2.0::double from ring) select least(src, dst) as src, greatest(src, dst) as dst, round(max(dist), 6) as low, round(min(dist), 6) as high from w group by 1, 2")
def graph_pooled(spark, d):
    e = ring(spark, d).withColumnRenamed("weight", "dist")
    w = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), (F.col("dist") * (1 + F.col("src") % 3) / 2.0).alias("dist")))
    low, high = graph.pooled(w, "min").withColumnRenamed("dist", "low"), graph.pooled(w, "max").withColumnRenamed("dist", "high")
    return low.join(high, ["src", "dst"]).select("src", "dst", r6("low", "low"), r6("high", "high"))


@query("blend_distances", "select vec_id as id, round(1 - ((label % 4) / 4.0::double * 1.75 + (vec_id % 10) / 10.0::double * 0.125) / 1.875, 6) as two, round(1 - ((label % 4) / 4.0::double + (vec_id % 10) / 10.0::double * 0.5) / 1.5, 6) as one from embeddings where label is not null")
def blend_distances(spark, d):
    v = vectors(spark, d).where("label is not null")
    category, seen = (F.col("label") % 4) / 4.0, (F.col("id") % 10) / 10.0
    return v.select("id", r6(similarity.blend(category, seen, [1.0, 0.5, 0.25]), "two"), r6(similarity.blend(category, seen, [1.0]), "one"))


@query("multiclass_pairs", """
with l as (select vec_id as id, label, ('0x' || substr(md5('classes:' || vec_id), 1, 8))::bigint as h from embeddings where label is not null),
a as (select id as a, label, row_number() over (partition by label order by h, id) as r from l),
c as (select label, row_number() over (order by label) - 1 as i, count(*) over () as n from (select distinct label from l)),
pos as (select distinct least(l.id, a) as src, greatest(l.id, a) as dst from l join a on a.label = l.label and r <= 3 where l.id <> a),
pick as (select l.id, j + 1 as r, (c.i + ('0x' || substr(md5('classes:' || l.id || ':' || j), 1, 8))::bigint % (c.n - 1) + 1) % c.n as i from l join c using (label), range(2) t(j)),
neg as (select distinct least(p.id, a) as src, greatest(p.id, a) as dst from pick p join c on c.i = p.i join a on a.label = c.label and a.r = p.r)
select src, dst, true as same from pos union all select src, dst, false from neg
""")
def multiclass_pairs_query(spark, d):
    pos, neg = multiclass_pairs(vectors(spark, d), 3, 2)
    return pos.withColumn("same", F.lit(True)).unionByName(neg.withColumn("same", F.lit(False)))


@query("spanning_tree", f"with {RING}, n as (select count(*) as n from v) select n - 1 as edges, (n - 1)::double as weight from n where n > 0")
def spanning_tree(spark, d):
    t = maximum_spanning_tree(ring(spark, d))
    return t.agg(F.count(F.lit(1)).alias("edges"), F.sum("weight").alias("weight"))


@query("graph_adjacency")
def graph_adjacency(spark, d):
    c = hamming.create(sign_codes(spark, d))
    h = hamming.bucketed(c, c, DIM, 8, PLACES, RADIUS).withColumn("dist", F.col("dist") / float(DIM))
    e = graph.adjacency(c.select("id"), graph.Adjacency(knn=5, knn_mode="sigma", random_pairs=1), stage(h, "hoods"), distances=lambda p: hamming.pair_distances(c, p, DIM))
    return e.select("src", "dst", r6("weight", "weight"))


# ---- embeddings, models, clusters -----------------------------------------------------------------------------------


SIM_BITS = 16


@query("simhash_codes", f"""
with docs as (select doc_id as id, lower(coalesce(text, '')) as t from documents),
b as (select distinct id, f from (select id, unnest(regexp_extract_all(t, '[a-z]+')) as f from docs) where length(f) > 1),
s as (select f, bit, case when ('0x' || substr(md5('simhash:' || f || ':' || bit), 1, 8))::bigint % 2 = 0 then 1 else -1 end as s from (select distinct f from b), range({SIM_BITS}) r(bit)),
v as (select id, bit, sum(s) as v from b join s using (f) group by all)
select id, cast(sum(case when v >= 0 then (1::bigint << bit) else 0 end) as bigint) as w0 from v group by id
""")
def simhash_codes(spark, d):
    words = words_of(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"))
    return simhash.encode_sets(words, SIM_BITS).select("id", F.col("code")[0].cast("long").alias("w0"))


@query("binarize_itq")
def binarize_itq(spark, d):
    v = vectors(spark, d)
    mean, rotation = binarize.itq_fit(v, iterations=5)
    return binarize.itq_encode(v, mean, rotation, "id").select("id", F.col("code")[0].alias("w0"), F.col("code")[1].alias("w1"))


@query("spectral_embed")
def spectral_embed(spark, d):
    e = graph.weights(doc_graph(spark, d))
    z, _ = spectral.eigen(e, vectors(spark, d).select("id"), 4, "normalized")
    return z.select("id", F.transform("z", lambda x: F.round(x, 6)).alias("z"))


def landmark_hoods(spark, d) -> DataFrame:
    c = hamming.create(sign_codes(spark, d))
    h = hamming.exact(c.where("id % 50 = 0"), c, DIM, 4)
    return h.withColumn("dist", F.col("dist") / float(DIM))


LAND = f"""
with {CODES}, d as (select x.id as src, y.id as dst, {HAM} as dist from codes x, codes y where x.id % 50 = 0 and x.id <> y.id),
h as (select src, dst, dist / 64.0::double as dist from (select *, row_number() over (partition by src order by dist, dst) as rank from d) where rank <= 4)
"""


@query("landmark_freq", LAND + ", b as (select src, unnest(range(0, 64)) as bit, unnest(b) as b from h join codes on id = dst) select src as id, cast(bit as int) as bit, cast(avg(b) > 0.5 as int) as b from b group by src, bit")
def landmark_freq(spark, d):
    return landmarks.landmark_encode(landmark_hoods(spark, d), sign_codes(spark, d), DIM)


@query("authority", LAND + f", s as (select src, avg({HAM} / 64.0::double) as s from h join codes x on x.id = src join codes y on y.id = dst group by src) select vec_id as id, round(coalesce(s, 64), 6) as score from embeddings left join s on s.src = vec_id")
def authority(spark, d):
    return landmarks.authority_scores(vectors(spark, d).select("id"), landmark_hoods(spark, d), sign_codes(spark, d), DIM).select("id", r6("score", "score"))


@query("select_landmarks", "select id, cluster, score from (select vec_id as id, label as cluster, ((vec_id * 37) % 101)::double as score, row_number() over (partition by label order by (vec_id * 37) % 101, vec_id) as r from embeddings where label >= 0) where r <= 3")
def select_landmarks(spark, d):
    v = vectors(spark, d)
    return landmarks.select_landmarks(v.select("id", ((F.col("id") * 37) % 101).cast("double").alias("score")), v.select("id", F.col("label").alias("cluster")), 3)


@query("centroids", f"with {CODES}, b as (select label as cluster, i, case when v >= 0 then 1 else -1 end as s from dims where label is not null) select cluster, cast(i as int) as bit, cast(sum(s) as bigint) as votes, cast(sum(s) >= 0 as int) as b from b group by all")
def centroids(spark, d):
    c = sign_codes(spark, d)
    return landmarks.centroids(c.select("id", "code"), c.where("label is not null").select("id", F.col("label").alias("cluster")), DIM)


@query("nystrom", LAND + " select src as id, round(sum((1 - dist) * (dst % 7) / 2.0), 6) as z0, round(sum((1 - dist) * (dst % 11) / 4.0), 6) as z1 from h group by src")
def nystrom(spark, d):
    h = landmark_hoods(spark, d)
    v = vectors(spark, d).select("id", F.array((F.col("id") % 7).cast("double"), (F.col("id") % 11).cast("double")).alias("z"))
    z = landmarks.nystrom_encode(h, v, [2.0, 4.0])
    return z.select("id", r6(F.col("z")[0], "z0"), r6(F.col("z")[1], "z1"))


@query("cluster_dendro_cut")
def cluster_dendro_cut(spark, d):
    c = sign_codes(spark, d).select("id", F.array(bits.low_bits(F.col("code"), 16)).alias("code"))
    e = doc_graph(spark, d).where("dist < 0.35")
    initial, merges = cluster.cluster(c, e)
    return cluster.cut(initial, merges, 6)


@query("clause_classify")
def clause_classify(spark, d):
    """Bits of embeddings to labels; learnt on a bounded sample, predicted for all rows."""
    on = F.filter(F.transform(bits.unpack(F.col("code"), DIM), lambda b, i: F.when(b == 1, i)), lambda i: i.isNotNull())
    rows = sign_codes(spark, d).where("label is not null").select("id", on.alias("features"), "label")
    n = (rows.agg(F.max("label")).first()[0] or 0) + 1
    model = clause_machine.create(clause_machine.Settings("classifier", n, DIM, clauses=16, clause_tolerance=16, specificity=4.0, sample=300))
    return clause_machine.predict(rows, clause_machine.train(rows, model, 3))


@query("corex_topics")
def corex_topics(spark, d):
    on = F.filter(F.transform(bits.unpack(F.col("code"), DIM), lambda b, i: F.when(b == 1, i)), lambda i: i.isNotNull())
    rows = sign_codes(spark, d).select("id", on.alias("features"))
    return Corex(DIM, 4).train(rows, 5).compress(rows)
