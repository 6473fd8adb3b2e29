"""Vector, full-text, hybrid retrieval and entity resolution over embeddings, documents and parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphmill.functions import columns as c
from graphmill.operators import retrieval as v
from graphmill.plans.registry import query, table as t

TERMS = ["licensed", "thing", "worthless"]


def query_vector(spark, d):
    """The vector with id 7; without one an empty vector, which is near nothing."""
    row = t(spark, d, "embeddings").where("vec_id = 7").select("embedding").first()
    return row[0] if row and row[0] is not None else []


_probe = query_vector


COS = "list_inner_product(e.embedding::double[], q.v) / (sqrt(list_inner_product(e.embedding::double[], e.embedding::double[])) * sqrt(list_inner_product(q.v, q.v)))"


@query("v1_vector_search", f"with q as (select embedding::double[] as v from embeddings where vec_id = 7) select vec_id, label, round({COS}, 4) as similarity from embeddings e, q order by {COS} desc, vec_id limit 20")
def v1(spark, d):
    return v.vector_search(t(spark, d, "embeddings"), _probe(spark, d), 20).select("vec_id", "label", "similarity")


@query("v2_similarity_cut", f"with q as (select embedding::double[] as v from embeddings where vec_id = 7) select vec_id, round({COS}, 4) as similarity from embeddings e, q where round({COS}, 4) >= 0.2")
def v2(spark, d):
    q = F.array(*(F.lit(float(x)) for x in _probe(spark, d)))
    return t(spark, d, "embeddings").select("vec_id", F.round(c.cosine(F.col("embedding"), q), 4).alias("similarity")).where("similarity >= 0.2")


BM = """w as (select doc_id, list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda x: x <> '') as w from documents), st as (select count(*) as n, avg(len(w)) as avgdl from w),
tf as (select doc_id, len(w) as dl, u.term, count(*) as tf from (select doc_id, w, unnest(w) as term from w) u where term in ('licensed', 'thing', 'worthless') group by 1, 2, 3), df as (select term, count(*) as df from tf group by 1),
bm as (select doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) as score from tf join df using (term), st group by 1)"""


@query("v3_bm25", f"with {BM} select doc_id, round(score, 4) as score from bm order by 2 desc, 1 limit 50")
def v3(spark, d):
    return v.bm25(t(spark, d, "documents"), TERMS).select("doc_id", F.round("score", 4).alias("score")).orderBy(F.desc("score"), "doc_id").limit(50)


@query("v6_hybrid", f"""with {BM}, q as (select embedding::double[] as v from embeddings where vec_id = 7), vr as (select vec_id as doc_id, label, row_number() over (order by s desc, vec_id) - 1 as rank from (select vec_id, label, {COS} as s from embeddings e, q order by 3 desc, 1 limit 80)),
tr as (select doc_id, row_number() over (order by s desc, doc_id) - 1 as rank from (select doc_id, round(score, 4) as s from bm order by 2 desc, 1 limit 80))
select vr.doc_id, round((1.0 / (61 + vr.rank) + coalesce(1.0 / (61 + tr.rank), 0)) * (1 + 0.5 * (label % 3) / 2.0), 6) as adjusted from vr left join tr using (doc_id) order by 2 desc, 1 limit 20""")
def v6(spark, d):
    near = v.ranked(v.vector_search(t(spark, d, "embeddings"), _probe(spark, d), 80).select(F.col("vec_id").alias("doc_id"), "label", "cosine"), [F.desc("cosine"), "doc_id"])
    text = v.ranked(v3_top(spark, d), [F.desc("s"), "doc_id"])
    fused = v.reciprocal_rank_fusion(near, text, "doc_id").join(near.select("doc_id", "label"), "doc_id")
    return fused.select("doc_id", F.round(F.col("rrf") * (1 + 0.5 * (F.col("label") % 3) / 2.0), 6).alias("adjusted")).orderBy(F.desc("adjusted"), "doc_id").limit(20)


def v3_top(spark, d):
    return v.bm25(t(spark, d, "documents"), TERMS).select("doc_id", F.round("score", 4).alias("s")).orderBy(F.desc("s"), "doc_id").limit(80)


@query("v9_cross_check", """with q as (select vec_id, embedding::double[] as v from embeddings), p as (select a.vec_id as a, b.vec_id as b, list_inner_product(a.v, b.v) / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v))) as s from q a join q b on b.vec_id = a.vec_id + 1)
select a, b, round(s, 4) as similarity, case when round(s, 4) < 0.05 then 0.1::double else 0.8::double end as confidence from p""")
def v9(spark, d):
    e = t(spark, d, "embeddings")
    p = e.select(F.col("vec_id").alias("a"), F.col("embedding").alias("va")).join(e.select((F.col("vec_id") - 1).alias("a"), F.col("vec_id").alias("b"), F.col("embedding").alias("vb")), "a")
    s = F.round(c.cosine(F.col("va"), F.col("vb")), 4)
    return p.select("a", "b", s.alias("similarity"), F.when(s < 0.05, 0.1).otherwise(0.8).alias("confidence"))


@query("er1_exact_merge", "select p_brand, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) as label, min(p_partkey) as winner, count(*) as n from part group by 1, 2")
def er1(spark, d):
    return t(spark, d, "part").groupBy("p_brand", c.label_norm(F.col("p_name")).alias("label")).agg(F.min("p_partkey").alias("winner"), F.count("*").alias("n"))


@query("er2_entropy_gate", """with u as (select distinct p_name from part), ch as (select p_name, unnest(string_split(p_name, '')) as ch from u), k as (select p_name, ch, count(*) as n from ch group by 1, 2), s as (select p_name, sum(n) as t from k group by 1)
select p_name from k join s using (p_name) group by 1 having -sum(n / t::double * log2(n / t::double)) >= 2.8""")
def er2(spark, d):
    return t(spark, d, "part").select("p_name").distinct().where(c.entropy(F.col("p_name")) >= 2.8)


@query("er4_verified_pairs")
def er4(spark, d):
    names = t(spark, d, "part").groupBy(F.col("p_name").alias("label")).agg(F.min("p_partkey").alias("id"))
    return v.resolve(names, 0.85)


@query("str5_jaro_winkler", "with u as (select p_name, min(p_partkey) as id from part group by 1) select a.id as a, b.id as b, round(jaro_winkler_similarity(a.p_name, b.p_name), 4) as score from u a join u b on a.id < b.id and split_part(a.p_name, ' ', 1) = split_part(b.p_name, ' ', 1)")
def str5(spark, d):
    u = t(spark, d, "part").groupBy("p_name").agg(F.min("p_partkey").alias("id")).withColumn("w", F.split_part("p_name", F.lit(" "), F.lit(1)))
    p = u.select(F.col("id").alias("a"), F.col("p_name").alias("la"), "w").join(u.select(F.col("id").alias("b"), F.col("p_name").alias("lb"), "w"), "w").where("a < b")
    return p.select("a", "b", F.round(v.jaro_winkler("la", "lb"), 4).alias("score"))


@query("er8_label_survivor", "select o.l_orderkey, o.l_linenumber, w.winner as part from lineitem o join part p on o.l_partkey = p.p_partkey join (select p_name, min(p_partkey) as winner from part group by 1) w on w.p_name = p.p_name")
def er8(spark, d):
    p = t(spark, d, "part")
    w = p.groupBy("p_name").agg(F.min("p_partkey").alias("part"))
    remap = p.join(w, "p_name").select("p_partkey", "part")
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(remap, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_linenumber", "part")


@query("ext_daily_window", "select date_trunc('day', ts)::timestamp as day, event_type as tool, count(*) as calls, count(*) filter (where event_type = 'error') as errors from events group by 1, 2")
def ext_daily(spark, d):
    return v.stream_daily(t(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))).withColumn("day", F.col("day").cast("timestamp_ntz"))
