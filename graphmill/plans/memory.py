"""Queries for the memory of past work: orders stand for entries, customers for projects, events for saves."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphmill.functions import columns as c
from graphmill.operators import memory as m
from graphmill.operators import retrieval as v
from graphmill.operators.relational import first_per
from graphmill.operators.scratch import shares
from graphmill.plans.registry import query, table as t
from graphmill.plans.retrieval import BM, COS, TERMS, query_vector

ENTRIES = """en as (select o_orderkey as id, o_orderpriority || (o_custkey % 40) as pattern, list_distinct(list(l_suppkey)) as citations, count(*) as usage, o_orderstatus = 'P' as negated from orders join lineitem on l_orderkey = o_orderkey group by 1, 2, 5),
ex as (select id, pattern, unnest(citations) as cited from en), sb as (select a.id, count(distinct b.id) as siblings from ex a join ex b on a.pattern = b.pattern and a.cited = b.cited and a.id <> b.id group by 1)"""


def entries(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", F.concat("o_orderpriority", (F.col("o_custkey") % 40).cast("string")).alias("pattern"), (F.col("o_orderstatus") == "P").alias("negated"))
    li = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set("l_suppkey").alias("citations"), F.count("*").alias("usage"))
    return o.join(li, "o_orderkey").withColumnRenamed("o_orderkey", "id")


@query("j21_pattern_siblings", f"with {ENTRIES} select id, siblings from sb")
def j21(spark, d):
    return m.siblings(entries(spark, d))


@query("a20_cross_reference_boost", f"with {ENTRIES} select en.id, round(greatest(0.0::double, least(1.0::double, least(1.0::double, 0.15::double * usage) + least(0.3::double, 0.05::double * coalesce(siblings, 0)) - case when negated then 0.4::double else 0.0::double end)), 6) as boost from en left join sb using (id)")
def a20(spark, d):
    e = entries(spark, d)
    return e.join(m.siblings(e, m.SIBLINGS), "id", "left").select("id", F.round(m.boost(F.col("usage"), F.coalesce("siblings", F.lit(0)), F.col("negated")), 6).alias("boost"))


@query("a17_citation_hubs", f"with {ENTRIES}, sz as (select pattern, count(*) as group_size from en group by 1 having count(*) >= 3), cn as (select pattern, cited, count(*) as n from ex group by 1, 2) select pattern, cited, n, group_size, round(n / group_size::double, 2) as rate from cn join sz using (pattern) where n >= greatest(2.0::double, 0.3::double * group_size)")
def a17(spark, d):
    return m.citation_hubs(entries(spark, d))


@query("st2_confirmed_saves", """with s as (select user_id as key, event_type in ('purchase', 'signup') as confirmed, event_type = 'error' and event_id % 7 = 0 as restored, (event_id % 5)::bigint as count, event_id as pos from events),
b as (select key, max(case when restored then pos end) as f, coalesce(arg_max(count, case when restored then pos end), 0) as base from s group by 1), n as (select s.key, max(base) + count(*) filter (where confirmed and not restored and (f is null or pos > f)) as n from s join b on b.key = s.key group by 1)
select key, n, least(1.0::double, round(0.25 * n, 4)::double) as confidence from n""")
def st2(spark, d):
    i = F.col("event_id")
    s = t(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_type").isin("purchase", "signup").alias("confirmed"), ((F.col("event_type") == "error") & (i % 7 == 0)).alias("restored"), (i % 5).alias("count"), i.alias("at"))
    return m.confirmed(s)


@query("st7_relation_upsert", """with r as (select l_partkey as source, l_suppkey as target, l_returnflag as relation, round(l_discount, 2) as strength, l_orderkey * 10 + l_linenumber as pos, l_extendedprice as p from lineitem where l_partkey <> l_suppkey),
b as (select * from r union all select target, source, relation, strength, pos, p from r) select source, target, relation, max(pos) as newest from b group by 1, 2, 3""")
def st7(spark, d):
    r = t(spark, d, "lineitem").select(F.col("l_partkey").alias("source"), F.col("l_suppkey").alias("target"), F.col("l_returnflag").alias("relation"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at"))
    return m.related(r.withColumn("strength", F.col("at"))).withColumnRenamed("strength", "newest")


@query("st9_pattern_refresh", "with o as (select c_nationkey as project_key, c_mktsegment as pattern, count(*) as n from customer group by 1, 2), w as (select c_nationkey as project_key, 'large' as pattern, count(*) as n from customer where c_acctbal > 5000 and c_nationkey < 12 group by 1) select * from o where project_key not in (select project_key from w) union all select * from w")
def st9(spark, d):
    cu = t(spark, d, "customer").withColumnRenamed("c_nationkey", "project_key")
    old = cu.groupBy("project_key", F.col("c_mktsegment").alias("pattern")).agg(F.count("*").alias("n"))
    new = cu.where("c_acctbal > 5000 and project_key < 12").groupBy("project_key").agg(F.count("*").alias("n")).select("project_key", F.lit("large").alias("pattern"), "n")
    return m.replaced_partition(old, new, "project_key")


@query("st11_guarded_write", "with s as (select p_partkey, p_name as body, case when p_size % 3 = 0 then 'edited' else sha256(p_name) end as digest from part where p_partkey % 2 = 0) select 'skill' || p.p_partkey as name, case when s.p_partkey is null then 'created' when sha256(s.body) <> s.digest then 'skipped_user_edited' else 'updated' end as outcome from part p left join s on s.p_partkey = p.p_partkey")
def st11(spark, d):
    p = t(spark, d, "part").withColumn("name", F.concat(F.lit("skill"), F.col("p_partkey").cast("string")))
    stored = p.where("p_partkey % 2 = 0").select("name", F.col("p_name").alias("body"), F.when(F.col("p_size") % 3 == 0, "edited").otherwise(F.sha2("p_name", 256)).alias("digest"))
    return m.guarded_write(stored, p)


@query("st12_freshness", """with cf as (select distinct l_orderkey as entry, l_partkey as path from lineitem), rc as (select distinct entry, path, md5(p_name) as was from cf join part on p_partkey = path where path % 50 <> 3), cu as (select p_partkey as path, case when p_size = 7 then 'x' else md5(p_name) end as now from part where p_size <> 9),
j as (select entry, was is null or now is null or was <> now as bad from cf left join rc using (entry, path) left join cu using (path)) select entry, count(*) filter (where bad) = 0 as fresh, count(*) filter (where bad) as changed from j group by 1""")
def st12(spark, d):
    cf = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("entry"), F.col("l_partkey").alias("path"))
    p = t(spark, d, "part").select(F.col("p_partkey").alias("path"), F.md5("p_name").alias("digest"), "p_size")
    return m.fresh(cf, cf.repartition(shares(cf), "entry", "path").distinct().join(p, "path").where("path % 50 <> 3").select("entry", "path", "digest"), p.where("p_size <> 9").select("path", F.when(F.col("p_size") == 7, "x").otherwise(F.col("digest")).alias("digest")))


SMART = f"""{BM}, q as (select embedding::double[] as v from embeddings where vec_id = 7), vs as (select vec_id as id, label, round({COS}, 4) as similarity, row_number() over (order by {COS} desc, vec_id) - 1 as rank from embeddings e, q),
vr as (select * from vs where rank < 80 and similarity >= 0.1), tr as (select doc_id as id, row_number() over (order by s desc, doc_id) - 1 as rank from (select doc_id, round(score, 4) as s from bm order by 2 desc, 1 limit 80)),
fu as (select vr.id, label, similarity, 1.0::double / (61 + vr.rank) + coalesce(1.0::double / (61 + tr.rank), 0) as rrf from vr left join tr using (id)),
ad as (select id, similarity, label = 3 as negated, round(rrf * (1.0::double - 0.1::double * (id % 5)) * (1 + 0.5::double * (label / 10.0::double)) * (1 + 0.2::double * (id % 3)), 6) as adjusted from fu)"""


def _memory_rows(spark, d):
    i, lab = F.col("vec_id"), F.col("label")
    return t(spark, d, "embeddings").select(i.alias("id"), F.array(F.concat(F.lit("tag"), lab.cast("string"))).alias("tags"), (1.0 - 0.1 * (i % 5)).alias("decay"), (lab / 10.0).alias("confidence"), (0.2 * (i % 3)).alias("boost"), (lab == 3).alias("negated"))


def _signals(spark, d):
    near = v.ranked(v.vector_search(t(spark, d, "embeddings"), query_vector(spark, d), 80).select(F.col("vec_id").alias("id"), "similarity", "cosine"), [F.desc("cosine"), "id"])
    top = v.bm25(t(spark, d, "documents"), TERMS).select("doc_id", F.round("score", 4).alias("s")).orderBy(F.desc("s"), "doc_id").limit(80)
    return near, v.ranked(top, [F.desc("s"), "doc_id"]).withColumnRenamed("doc_id", "id")


@query("v5_adjusted_scores", f"with {SMART} select id, similarity, adjusted, negated from ad")
def v5(spark, d):
    near, text = _signals(spark, d)
    f = v.reciprocal_rank_fusion(near.where("similarity >= 0.1"), text, "id").join(near.select("id", "similarity"), "id").join(_memory_rows(spark, d), "id")
    return f.select("id", "similarity", m.adjusted(F.col("rrf"), F.col("decay"), F.col("confidence"), F.col("boost")).alias("adjusted"), "negated")


@query("v6b_smart_query", f"""with {SMART}, top as (select * from ad order by adjusted desc, id limit 20), ex as (select vec_id as id, 1.0::double as similarity, false as negated, 'inf'::double as adjusted from embeddings where vec_id = 11 and label <> 3 and vec_id not in (select id from top where not negated)),
al as (select * from top union all by name select * from ex), pl as (select id, case when negated then 'negative' else 'result' end as kind, similarity, case when isinf(adjusted) then 1.0::double else adjusted end as adjusted, row_number() over (partition by negated order by adjusted desc, id)::int as place from al)
select * from pl where kind = 'negative' or place <= 10""")
def v6b(spark, d):
    near, text = _signals(spark, d)
    return m.smart_query(near, text, _memory_rows(spark, d), "11", 10, 0.1)


@query("v7_insight_rows", f"with {SMART} select id, similarity from ad where not negated order by adjusted desc, id limit 10")
def v7(spark, d):
    return v5(spark, d).where("not negated").orderBy(F.desc("adjusted"), "id").limit(10).select("id", "similarity")


@query("j23_function_work_items", """with f as (select p_brand as file, count(*) as n from part where p_name like '%ring%' group by 1 order by n desc, file limit 5)
select file, o_orderkey as item from (select distinct p_brand as file, l_orderkey as o_orderkey from lineitem join part on l_partkey = p_partkey where l_quantity >= 48) join f using (file)""")
def j23(spark, d):
    p = t(spark, d, "part")
    top = p.where("p_name like '%ring%'").groupBy(F.col("p_brand").alias("file")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "file").limit(5).select("file")
    li = t(spark, d, "lineitem").where("l_quantity >= 48").join(p.select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("file")), "l_partkey")
    return li.join(F.broadcast(top), "file").select("file", F.col("l_orderkey").alias("item")).distinct()  # five rows


@query("j25_tracker_projects", "select c_custkey, n_name from customer join nation on upper(n_name) = upper('nation_' || (c_custkey % 25))")
def j25(spark, d):
    n = t(spark, d, "nation").select(F.upper("n_name").alias("k"), "n_name")
    return t(spark, d, "customer").withColumn("k", F.upper(F.concat(F.lit("nation_"), (F.col("c_custkey") % 25).cast("string")))).join(n, "k").select("c_custkey", "n_name")


@query("x9_cached_split", "with h as (select doc_id, sha256(coalesce(text, '')) as h from documents), known as (select h from h where doc_id % 3 = 0) select doc_id, h in (select h from known) as cached from h")
def x9(spark, d):
    h = t(spark, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"))
    known = h.where("doc_id % 3 = 0").select("h").distinct().withColumn("cached", F.lit(True))
    return h.join(known, "h", "left").select("doc_id", F.coalesce("cached", F.lit(False)).alias("cached"))


@query("x15_session_list", "select user_id, max(event_id) as checkpoint, arg_max(event_type, event_id) as state from events group by 1")
def x15(spark, d):
    return t(spark, d, "events").groupBy("user_id").agg(F.max("event_id").alias("checkpoint"), F.max_by("event_type", "event_id").alias("state"))


@query("x17_latest_pipeline", """with p as (select o_custkey as branch, o_orderkey as id, o_orderstatus as status, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as r from orders), j as (select l_orderkey as id, min(l_linenumber) as failed_job from lineitem where l_returnflag = 'R' group by 1)
select branch, p.id, status, case when status = 'F' then failed_job end as failed_job from p left join j using (id) where r = 1""")
def x17(spark, d):
    p = first_per(t(spark, d, "orders").select(F.col("o_custkey").alias("branch"), F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), "o_orderdate"), ["branch"], [F.desc("o_orderdate"), F.desc("id")])
    j = t(spark, d, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("id")).agg(F.min("l_linenumber").alias("failed_job"))
    return p.join(j, "id", "left").select("branch", "id", "status", F.when(F.col("status") == "F", F.col("failed_job")).alias("failed_job"))


@query("x14_deepest_ancestor", "with r as (select 'Brand#' || n_nationkey as root from nation union all select 'Brand#1' union all select 'Brand') select p_partkey, arg_max(root, length(root)) as root from part join (select distinct root from r) on starts_with(p_brand, root) group by 1")
def x14(spark, d):
    roots = t(spark, d, "nation").select(F.concat(F.lit("Brand#"), F.col("n_nationkey").cast("string")).alias("root")).unionByName(spark.createDataFrame([("Brand#1",), ("Brand",)], "root string")).distinct()
    # an ancestor is one of the path's own beginnings, so this is an equi-join
    p = t(spark, d, "part").select("p_partkey", "p_brand")
    starts = p.select("p_brand").distinct().select("p_brand", F.explode(F.transform(F.sequence(F.lit(1), F.length("p_brand")), lambda i: F.substring("p_brand", F.lit(1), i))).alias("root"))
    deepest = starts.join(roots, "root").groupBy("p_brand").agg(F.max_by("root", F.length("root")).alias("root"))
    return p.join(deepest, "p_brand").select("p_partkey", "root").repartition(shares(p), "p_partkey").groupBy("p_partkey").agg(F.max_by("root", F.length("root")).alias("root"))


@query("x28_sampled_staleness", """with m as (select p_partkey as path, p_retailprice as mtime, row_number() over (order by p_partkey) as i, count(*) over () as total from part), s as (select m.*, c.p_retailprice + case when c.p_size > 45 then 5 else 0 end as now from m left join (select * from part where p_size <> 1) c on c.p_partkey = m.path where i <= 500),
e as (select max(total) as total, floor(count(*) filter (where now is null or abs(now - mtime) > 1.0) * max(total) / count(*)::double)::bigint as changed from s) select changed, total, round(changed / total::double * 100, 1) as pct, case when changed / total::double <= 0.2 then 'incremental' else 'stale' end as status from e""")
def x28(spark, d):
    p = t(spark, d, "part")
    total = F.broadcast(p.agg(F.count("*").alias("total")))  # one row
    sample = p.orderBy("p_partkey").limit(500).select("p_partkey", F.col("p_retailprice").alias("mtime"))
    now = p.where("p_size <> 1").select("p_partkey", (F.col("p_retailprice") + F.when(F.col("p_size") > 45, 5).otherwise(0)).alias("now"))
    bad = F.col("now").isNull() | (F.abs(F.col("now") - F.col("mtime")) > 1.0)
    e = sample.join(now, "p_partkey", "left").agg(F.count_if(bad).alias("bad"), F.count("*").alias("n")).join(total).select(F.floor(F.col("bad") * F.col("total") / F.col("n")).alias("changed"), "total")
    pct = F.col("changed") / F.col("total")
    return e.select("changed", "total", F.round(pct * 100, 1).alias("pct"), F.when(pct <= 0.2, "incremental").otherwise("stale").alias("status"))


@query("mth1_cosine_distance", "select a.vec_id, round(1 - list_inner_product(a.embedding::double[], b.embedding::double[]) / (sqrt(list_inner_product(a.embedding::double[], a.embedding::double[])) * sqrt(list_inner_product(b.embedding::double[], b.embedding::double[]))), 6) as distance from embeddings a join embeddings b on b.vec_id = a.vec_id + 1")
def mth1(spark, d):
    e = t(spark, d, "embeddings")
    p = e.select("vec_id", F.col("embedding").alias("a")).join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b")), "vec_id")
    return p.select("vec_id", F.round(c.cosine_distance(F.col("a"), F.col("b")), 6).alias("distance"))


@query("st345_after_events", """with n as (select distinct user_id as key, user_id % 7 as pattern, 0.25::double as confidence from events where user_id is not null),
e as (select user_id as key, (event_id * 7) % 40 as actor, case event_type when 'view' then 'reinforced' when 'click' then 'verified' else 'negated' end as kind, ts, event_id as id from events where user_id is not null and (event_type = 'view' and event_id % 3 = 0 or event_type = 'click' and event_id % 11 = 0 or event_type = 'error' and event_id % 23 = 0)),
u as (select key, actor, min(row(ts, id)) as first from e where kind = 'reinforced' group by 1, 2), c as (select key, count(*) as usage from u group by 1),
o as (select key, count(*) filter (kind = 'verified') as confirmations, count(*) filter (kind = 'negated') as no, max(row(ts, id)) filter (kind = 'verified') as v, max(row(ts, id)) filter (kind = 'negated') as ng, max(row(ts, id)) filter (kind in ('reinforced', 'negated')) as st from e group by 1),
s as (select a.key, count(distinct b.key) as siblings from u a join u b on a.actor = b.actor and a.key <> b.key and a.key % 7 = b.key % 7 group by 1),
h as (select u.actor as key, count(*) as hits from e join u on u.key = e.key left join o on o.key = u.actor where e.kind = 'negated' and u.first < row(e.ts, e.id) and (o.st is null or row(e.ts, e.id) > o.st) group by 1)
select n.key, coalesce(usage, 0) as usage, coalesce(confirmations, 0) as confirmations, greatest(confidence, case when usage >= 10 then 1.0 when usage >= 5 then 0.75 else 0.0 end, least(1.0, 0.25 * coalesce(confirmations, 0)))::double as confidence, coalesce(no, 0) > 0 as negated, v is not null and (ng is null or v > ng) as verified,
  round(greatest(0.0, greatest(0.0, least(1.0, least(1.0, 0.15::double * coalesce(usage, 0)) + least(0.3, 0.05::double * coalesce(siblings, 0)) - case when coalesce(no, 0) > 0 then 0.4 else 0.0 end)) - 0.05::double * coalesce(hits, 0)), 4)::double as boost
from n left join o using (key) left join c using (key) left join s using (key) left join h using (key)""")
def st345(spark, d):
    e = t(spark, d, "events").where("user_id is not null")
    i = F.col("event_id")
    kind = F.when(F.col("event_type") == "view", "reinforced").when(F.col("event_type") == "click", "verified").otherwise("negated")
    chosen = e.where("event_type = 'view' and event_id % 3 = 0 or event_type = 'click' and event_id % 11 = 0 or event_type = 'error' and event_id % 23 = 0")
    events = chosen.select(F.col("user_id").alias("key"), (i * 7 % 40).alias("actor"), kind.alias("kind"), F.col("ts").alias("at"), i.alias("id"))
    entries = e.select(F.col("user_id").alias("key"), (F.col("user_id") % 7).alias("pattern"), F.lit(0.25).alias("confidence")).distinct()
    return m.after_events(entries, events)
