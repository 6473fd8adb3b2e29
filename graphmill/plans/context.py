"""Queries for ranked context: parts stand for files, signals come from their lines and their text."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphmill.operators import context as x
from graphmill.plans.registry import query, table as t

TASK = "small red widget for an ECONOMY ring economy widget"
SIGNALS = """sig as (
  select p_brand || '/' || p_partkey as path, 'seed' as signal, 'changed' as reason from part where p_size = 50
  union all select p_brand || '\\' || l_partkey, 'graph', 'edge' from lineitem join part on l_partkey = p_partkey where l_quantity >= 50
  union all select p_brand || '/' || p_partkey, 'grep', 'name' from part where p_name like '%ring%'
  union all select p_brand || '/' || p_partkey, 'semantic', 'type' from part where p_type = 'ECONOMY'
  union all select p_brand || '/' || p_partkey, 'memory', '' from part where p_retailprice >= 905),
cand as (select replace(path, '\\', '/') as path, list_sort(list(distinct signal)) as signals, list_sort(list(distinct reason) filter (where reason <> '')) as reasons from sig group by 1)"""
SCORED = f"""{SIGNALS}, deg as (select l_partkey, count(*) as n from lineitem group by 1), top as (select max(n) as top from deg),
sc as (select c.path, len(list_filter(signals, lambda s: s <> 'seed')) as k, signals, reasons, coalesce(deg.n / top::double, 0) as c, p_size / 50.0::double as r, (p_type = 'PROMO' or list_contains(signals, 'memory')) as fixed
  from cand c join part on c.path = p_brand || '/' || p_partkey left join deg on deg.l_partkey = p_partkey, top),
scored as (select path, 3.0::double * k + 2.0::double * c + r + 4.0::double * fixed::int as score, case when list_contains(signals, 'seed') then 'seed' when k >= 2 or list_contains(signals, 'graph') then 'high' when list_contains(signals, 'semantic') or fixed then 'medium' else 'low' end as tier, signals, reasons from sc)"""


def _parts(spark, d):
    p = t(spark, d, "part")
    return p.withColumn("path", F.concat_ws("/", "p_brand", "p_partkey"))


def found(spark, d):
    p = _parts(spark, d)
    sig = lambda cond, name, reason: p.where(cond).select("path", F.lit(name).alias("signal"), F.lit(reason).alias("reason"))
    edge = t(spark, d, "lineitem").where("l_quantity >= 50").select(F.col("l_partkey").alias("p_partkey")).join(p, "p_partkey").select(F.concat_ws("\\", "p_brand", "p_partkey").alias("path"), F.lit("graph").alias("signal"), F.lit("edge").alias("reason"))
    rows = sig("p_size = 50", "seed", "changed").unionByName(edge).unionByName(sig("p_name like '%ring%'", "grep", "name")).unionByName(sig("p_type = 'ECONOMY'", "semantic", "type")).unionByName(sig("p_retailprice >= 905", "memory", ""))
    return x.candidates(rows)


def scored(spark, d):
    p = _parts(spark, d)
    n = t(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n"))
    top = n.agg(F.max("n").alias("top"))
    central = n.join(F.broadcast(top)).join(p.select("p_partkey", "path"), "p_partkey").select("path", (F.col("n") / F.col("top")).alias("value"))
    recent = p.select("path", (F.col("p_size") / 50.0).alias("value"))
    return x.fuse_rank(found(spark, d), central, recent, p.where("p_type = 'PROMO'").select("path"))


def _flat(df):
    return df.withColumn("signals", F.array_join("signals", ",")).withColumn("reasons", F.array_join("reasons", ","))


@query("set1b_fan_out", f"with {SIGNALS} select path, array_to_string(signals, ',') as signals, coalesce(array_to_string(reasons, ','), '') as reasons from cand")
def fan_out(spark, d):
    return _flat(found(spark, d))


@query("x1_fused_rank", f"with {SCORED} select path, round(score, 3) as score, tier, array_to_string(signals, ',') as signals, coalesce(array_to_string(reasons, ','), '') as reasons from scored")
def x1(spark, d):
    return _flat(scored(spark, d)).withColumn("score", F.round("score", 3))


@query("x2_tiers", f"with {SCORED} select tier, count(*) as n from scored group by 1")
def x2(spark, d):
    return scored(spark, d).groupBy("tier").agg(F.count("*").alias("n"))


@query("lim6_tier_order", f"with {SCORED} select path, tier, round(score, 3) as score from scored order by case tier when 'seed' then 0 when 'high' then 1 when 'medium' then 2 else 3 end, round(score, 3) desc, path limit 40")
def lim6(spark, d):
    return scored(spark, d).withColumn("score", F.round("score", 3)).orderBy(x.tier_order(F.col("tier")), F.desc("score"), "path").limit(40).select("path", "tier", "score")


DONE = "done as (select p_brand || '/' || p_partkey as path from part where p_name like 'small%' union select p_brand || '/' || p_partkey from part where p_name like 'hot%')"


def _done(spark, d):
    p = _parts(spark, d)
    return p.where("p_name like 'small%'").select("path"), p.where("p_name like 'hot%'").select("path")


@query("x3_miss_check", f"with {SCORED}, {DONE} select path, tier, tier = 'high' as blocking from scored where tier <> 'seed' and path not in (select path from done)")
def x3(spark, d):
    return x.missed(scored(spark, d), *_done(spark, d))


@query("x3b_miss_report", f"with {SCORED}, {DONE}, j as (select tier, path in (select path from done) as ok from scored) select count(*) filter (where tier = 'high' and not ok) = 0 as ok, case when count(*) filter (where tier = 'high') = 0 then 1.0::double else round(count(*) filter (where tier = 'high' and ok) / count(*) filter (where tier = 'high')::double, 3) end as coverage, count(*) filter (where tier <> 'seed' and not ok) as missed, count(*) filter (where tier = 'high' and not ok) as blocking from j")
def x3b(spark, d):
    return x.miss_report(scored(spark, d), *_done(spark, d))


_WORDS = [w for w in TASK.lower().split()]
_HITS = " + ".join(f"regexp_matches(txt, '(^|[^a-z0-9]){w}([^a-z0-9]|$)')::int" for w in _WORDS)
RELEVANCE = f"""nd as (select p_partkey as id, p_name as label, p_brand as source_file, p_type as role_tag, p_type || ' ' || split_part(p_name, ' ', 2) || ' | ' || p_name as ui_text, p_size / 50.0::double as importance from part),
dg as (select l_partkey as id, count(*) as degree, max(round(1 - 5 * l_discount, 2)) as best from lineitem group by 1),
tx as (select nd.*, coalesce(degree, 0) as degree, coalesce(best, 0) as best, lower(label || ' ' || source_file || ' ' || role_tag || ' ' || ui_text) as txt, len(list_filter(string_split(lower(ui_text), ' | '), lambda p: contains(p, ' ') and len(p) >= 12 and contains('{TASK.lower()}', p))) > 0 as phrase from nd left join dg using (id)),
kw as (select *, ({_HITS}) / {len(_WORDS)}.0::double * case when phrase then 3.0::double else 1.0::double end as word from tx),
rel as (select *, case when word * ln(1 + degree) * (0.5 + 0.5 * best) > 0 then word * ln(1 + degree) * (0.5 + 0.5 * best) * (1 + 0.2 * importance) else word * 0.1 * importance end as score from kw)"""


def _relevance(spark, d):
    kind, word = F.col("p_type"), F.element_at(F.split("p_name", " "), 2)
    nodes = t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("label"), F.col("p_brand").alias("source_file"), kind.alias("role_tag"), F.concat(kind, F.lit(" "), word, F.lit(" | "), F.col("p_name")).alias("ui_text"), (F.col("p_size") / 50.0).alias("importance"))
    e = t(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.count("*").alias("degree"), F.max(F.round(1 - 5 * F.col("l_discount"), 2)).alias("best"))
    return x.relevance(nodes, e, e, TASK)


@query("mth5_relevance", f"with {RELEVANCE} select id, round(score, 4) as score from rel where score > 0")
def mth5(spark, d):
    return _relevance(spark, d).where("score > 0").select("id", F.round("score", 4).alias("score"))


@query("str18_phrase_bonus", f"with {RELEVANCE} select id, case when phrase then 3.0::double else 1.0::double end as bonus from rel")
def str18(spark, d):
    kind, word = F.col("p_type"), F.element_at(F.split("p_name", " "), 2)
    return t(spark, d, "part").select(F.col("p_partkey").alias("id"), x.phrase_bonus(F.concat(kind, F.lit(" "), word, F.lit(" | "), F.col("p_name")), TASK).alias("bonus"))


@query("g20_find_context", f"with {RELEVANCE}, b as (select *, row_number() over (partition by source_file order by score desc, id) as k from rel where score > 0) select source_file as file, id as node_id, round(score, 4) as score, degree from b where k = 1")
def g20(spark, d):
    return x.find_context(_relevance(spark, d))


@query("j14_semantic_patterns", """with pat as (select n_nationkey as pid, string_split(lower(n_name), '_') as w, n_regionkey as grp from nation), tk as (select conv_id, list_distinct(list_filter(string_split_regex(lower(string_agg(text, ' ')), '[^a-z]+'), lambda x: x <> '')) as words from conversations group by 1),
pw as (select n_nationkey as pid, unnest(['the', 'of', ['thing', 'and', 'with', 'that'][1 + n_nationkey % 4], ['thly', 'ened', 'ring', 'ther', 'ou'][1 + n_nationkey % 5]]) as word from nation), tw as (select conv_id, unnest(words) as word from tk),
h as (select conv_id, pid, count(*) as hits from (select distinct pid, word from pw) join tw using (word) group by 1, 2 having count(*) >= 2)
select conv_id, min(pid) as pattern from h group by 1""")
def j14(spark, d):
    n = F.col("n_nationkey")
    pick = lambda words, m: F.element_at(F.array(*(F.lit(w) for w in words)), (n % m + 1).cast("int"))
    pw = t(spark, d, "nation").select(n.alias("pattern"), F.explode(F.array_distinct(F.array(F.lit("the"), F.lit("of"), pick(["thing", "and", "with", "that"], 4), pick(["thly", "ened", "ring", "ther", "ou"], 5)))).alias("word"))
    # words meet words by equality: no pair of a ticket and a pattern arises that shares none
    tw = t(spark, d, "conversations").select("conv_id", F.explode(F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda w: w != "")).alias("word")).distinct()
    hits = tw.join(pw, "word").groupBy("conv_id", "pattern").agg(F.count("*").alias("hits")).where("hits >= 2")
    return hits.groupBy("conv_id").agg(F.min("pattern").alias("pattern"))


@query("set2b_ordered_tiers", """with g as (select distinct l_partkey as id, count(*) over (partition by l_partkey) as n from lineitem where l_quantity >= 49), w as (select p_partkey as id from part where p_name like '%ring%'), s as (select p_partkey as id from part where p_size = 50),
u as (select id from g union select id from w union select id from s)
select u.id, case when s.id is not null then 0 when g.id is not null and w.id is not null then 1 when g.id is not null then 2 else 3 end as tier, coalesce(g.n, 0) as hits from u left join g using (id) left join w using (id) left join s using (id)""")
def set2b(spark, d):
    g = t(spark, d, "lineitem").where("l_quantity >= 49").groupBy(F.col("l_partkey").alias("id")).agg(F.count("*").alias("hits"))
    p = t(spark, d, "part")
    rows = g.select("id", "hits", F.lit("g").alias("k")).unionByName(p.where("p_name like '%ring%'").select(F.col("p_partkey").alias("id"), F.lit(0).cast("long").alias("hits"), F.lit("w").alias("k"))).unionByName(p.where("p_size = 50").select(F.col("p_partkey").alias("id"), F.lit(0).cast("long").alias("hits"), F.lit("s").alias("k")))
    by = rows.groupBy("id").agg(F.max("hits").alias("hits"), F.bool_or(F.col("k") == "g").alias("g"), F.bool_or(F.col("k") == "w").alias("w"), F.bool_or(F.col("k") == "s").alias("s"))
    return by.select("id", F.when(F.col("s"), 0).when(F.col("g") & F.col("w"), 1).when(F.col("g"), 2).otherwise(3).alias("tier"), "hits")
