"""Queries over a graph of parts: an edge leads from each part of an order to that of its next line; brands are files, types communities."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from graphmill.functions import columns as c
from graphmill.operators import codegraph as k
from graphmill.operators import context as x
from graphmill.operators import graph as g
from graphmill.operators.community import numbered
from graphmill.operators.scratch import Scratch, shares
from graphmill.plans.registry import query, table as t

NODES = "nodes as (select p_partkey as id, p_name as label, p_brand as file, p_type as community from part)"
EDGES = """edges as (select source, target, min(relation) as relation, max(confidence) as confidence_score from (
  select l_partkey as source, lead(l_partkey) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_discount, l_linestatus) as target, l_linestatus as relation, round(1 - 5 * l_discount, 2) as confidence from lineitem) where target is not null group by 1, 2)"""
DEGREE = "dg as (select node, count(*) as degree from (select source as node from edges union all select target from edges) group by 1)"


def nodes(spark, d):
    return t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("label"), F.col("p_brand").alias("file"), F.col("p_type").alias("community"))


def edges(spark, d):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount", "l_linestatus")
    e = t(spark, d, "lineitem").select(F.col("l_partkey").alias("source"), F.lead("l_partkey").over(w).alias("target"), F.col("l_linestatus").alias("relation"), F.round(1 - 5 * F.col("l_discount"), 2).alias("c"))
    # the relation of a line depends on the line alone, also where two lines tie in the window
    return e.where("target is not null").groupBy("source", "target").agg(F.min("relation").alias("relation"), F.max("c").alias("confidence_score"))


def _with_files(spark, d):
    n = nodes(spark, d)
    at = lambda end: n.select(F.col("id").alias(end), F.col("file").alias(f"{end}_file"), F.col("community").alias(f"{end}_community"))
    return edges(spark, d).select("source", "target").join(at("source"), "source").join(at("target"), "target")


FILES = "ef as (select e.source, e.target, a.file as source_file, b.file as target_file, a.community as source_community, b.community as target_community from edges e join nodes a on a.id = e.source join nodes b on b.id = e.target)"


@query("j1_edge_files", f"with {NODES}, {EDGES}, {FILES} select source_file, target_file, count(*) as n from ef where source_file <> target_file group by 1, 2")
def j1(spark, d):
    return _with_files(spark, d).where("source_file <> target_file").groupBy("source_file", "target_file").agg(F.count("*").alias("n"))


@query("g6_cochange_partners", """with x as (select distinct l_orderkey as grp, p_brand as item from lineitem join part on l_partkey = p_partkey), n as (select item, count(*) as n from x group by 1),
p as (select b.item as partner, count(*) as together from x a join x b on a.grp = b.grp where a.item = 'Brand#13' and b.item <> 'Brand#13' group by 1)
select partner, together, round(together / greatest(m.n, o.n)::double, 4) as strength from p join n m on m.item = partner, (select n from n where item = 'Brand#13') o""")
def g6(spark, d):
    i = t(spark, d, "lineitem").join(t(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("grp"), F.col("p_brand").alias("item")).distinct()
    n = i.groupBy("item").agg(F.count("*").alias("n"))
    own = i.where("item = 'Brand#13'").select("grp")
    p = i.where("item <> 'Brand#13'").join(own, "grp").groupBy(F.col("item").alias("partner")).agg(F.count("*").alias("together"))
    mine = F.broadcast(n.where("item = 'Brand#13'").select(F.col("n").alias("o")))  # one row
    return p.join(n.withColumnRenamed("item", "partner"), "partner").join(mine).select("partner", "together", F.round(F.col("together") / F.greatest("n", "o"), 4).alias("strength"))


@query("g9_subsystem", f"""with {NODES}, {EDGES}, {DEGREE}, own as (select arg_min(community, id) as c from nodes where file = 'Brand#13'), ins as (select * from nodes where community = (select c from own)),
f as (select file, max(coalesce(degree, 0)) as degree from ins left join dg on node = id group by 1), h as (select source as node, target as other from edges union all select target, source from edges)
select 'file' as kind, file from f union all select 'top', file from (select file from f order by degree desc, file limit 10)
union all select distinct 'cross', o.file from h join ins on ins.id = h.node join nodes o on o.id = h.other where o.community <> (select c from own)""")
def g9(spark, d):
    return k.subsystem(nodes(spark, d), edges(spark, d), "Brand#13")


@query("j19_cross_cluster_files", f"with {NODES}, {EDGES}, {FILES} select source_community as community, count(distinct source_file) as files, count(distinct target_file) as cross_files from ef where source_community <> target_community group by 1")
def j19(spark, d):
    return _with_files(spark, d).where("source_community <> target_community").groupBy(F.col("source_community").alias("community")).agg(F.count_distinct("source_file").alias("files"), F.count_distinct("target_file").alias("cross_files"))


RULES = [("*", ["@core"]), ("Brand#1*", ["@one", "@core"]), ("Brand#2*", ["@two"]), ("Brand#2", ["@lead"])]
OWNERS = "ow as (select file, case when file = 'Brand#2' then ['@lead'] when file like 'Brand#2%' then ['@two'] when file like 'Brand#1%' then ['@one', '@core'] else ['@core'] end as owners from (select distinct file from nodes))"


@query("g10_owned_files", f"with {NODES}, {OWNERS} select file from ow where len(list_intersect(owners, (select owners from ow where file = 'Brand#13'))) > 0")
def g10(spark, d):
    return k.ownership(nodes(spark, d), edges(spark, d), "Brand#13", RULES)[0]


@query("g10b_cross_owner_edges", f"""with {NODES}, {EDGES}, {FILES}, {OWNERS}, me as (select owners as mine from ow where file = 'Brand#13')
select source_file, target_file, array_to_string(b.owners, ',') as to_owners, count(*) as n from ef join ow a on a.file = source_file join ow b on b.file = target_file, me
where len(list_intersect(a.owners, mine)) > 0 and len(list_intersect(b.owners, mine)) = 0 and len(list_filter(b.owners, lambda o: not list_contains(mine, o))) > 0 group by 1, 2, 3""")
def g10b(spark, d):
    return k.ownership(nodes(spark, d), edges(spark, d), "Brand#13", RULES)[1].groupBy("source_file", "target_file", "to_owners").agg(F.count("*").alias("n"))


@query("g12_hub_exclusion", f"with {EDGES}, {DEGREE}, r as (select node, degree, row_number() over (order by degree, node) - 1 as i, count(*) over () as n from dg), cut as (select degree as d from r where i = greatest(0, floor(n * 90 / 100.0)::bigint - 1)) select node, degree from dg where degree > (select d from cut)")
def g12(spark, d):
    return k.hubs(g.degree(edges(spark, d)), 90)


@query("g12b_hub_reattach", f"""with {NODES}, {EDGES}, {DEGREE}, r as (select node, degree, row_number() over (order by degree, node) - 1 as i, count(*) over () as n from dg), cut as (select degree as d from r where i = greatest(0, floor(n * 90 / 100.0)::bigint - 1)), hub as (select node from dg where degree > (select d from cut)),
h as (select distinct node, other from (select source as node, target as other from edges union all select target, source from edges)),
v as (select hub.node, community, count(*) as n from hub join h using (node) join nodes o on o.id = h.other where o.id not in (select node from hub) group by 1, 2)
select node as id, arg_min(community, {{'n': -n, 'c': community}}) as community from v group by 1""")
def g12b(spark, d):
    hub = k.hubs(g.degree(edges(spark, d)), 90)
    rest = nodes(spark, d).join(hub.select(F.col("node").alias("id")), "id", "left_anti")
    return k.reattached(hub, edges(spark, d), rest)


@query("g13_community_remap")
def g13(spark, d):
    new = t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.element_at(F.split("p_brand", "#"), 2).cast("long").alias("community"))
    types = numbered(t(spark, d, "part").select("p_type").distinct(), ["p_type"], "_n", Scratch(spark, "types"))
    old = t(spark, d, "part").join(types, "p_type").select(F.col("p_partkey").alias("id"), (F.col("_n") + 1).alias("community"))
    return k.stable_communities(new, old)


@query("lim3_god_nodes", f"with {NODES}, {EDGES}, {DEGREE} select node as id, label, degree from dg join nodes on id = node where not (label like '% ring' or label like 'old%') order by degree desc, id limit 10")
def lim3(spark, d):
    noise = F.col("label").like("% ring") | F.col("label").like("old%")
    return g.degree(edges(spark, d)).join(nodes(spark, d).where(~noise), F.col("node") == F.col("id")).select("id", "label", "degree").orderBy(F.desc("degree"), "id").limit(10)


CONFIDENCE = "case when confidence_score >= 0.8 then 'EXTRACTED' when confidence_score >= 0.4 then 'INFERRED' else 'AMBIGUOUS' end"
SURPRISE = f"""{NODES}, {EDGES}, {DEGREE}, s as (select e.source, e.target, {CONFIDENCE.replace('0.8', '0.95').replace('0.4', '0.8')} as conf, case relation when 'O' then 'calls' else 'semantically_similar_to' end as rel, case when a.label like '%ring' then 'doc' else 'code' end as ku, case when b.label like '%ring' then 'doc' else 'code' end as kv,
  split_part(a.label, ' ', 1) <> split_part(b.label, ' ', 1) as lang, a.file as tu, b.file as tv, a.community as cu, b.community as cv, du.degree as du, dv.degree as dv from edges e join nodes a on a.id = e.source join nodes b on b.id = e.target join dg du on du.node = e.source join dg dv on dv.node = e.target where a.file <> b.file),
p as (select *, conf = 'INFERRED' and rel in ('calls', 'uses') and (lang or list_sort([ku, kv]) = ['code', 'doc']) as pol from s),
q as (select *, case when pol then 0 else case conf when 'AMBIGUOUS' then 3 when 'INFERRED' then 2 else 1 end + case when ku <> kv then 2 else 0 end + case when tu <> tv then 2 else 0 end + case when cu <> cv then 1 else 0 end end as base from p),
surprise as (select *, (case when rel = 'semantically_similar_to' then floor(base * 1.5) else base end + case when least(du, dv) <= 2 and greatest(du, dv) >= 5 then 1 else 0 end)::bigint as score from q)"""


def _surprises(spark, d):
    n, e = nodes(spark, d), edges(spark, d)
    deg = g.degree(e)
    side = lambda end, s: n.join(deg, F.col("id") == F.col("node"), "left").select(F.col("id").alias(end), *(F.col(col).alias(f"{col}_{s}") for col in ("label", "file", "community", "degree")))
    j = e.join(side("source", "u"), "source").join(side("target", "v"), "target").where("file_u <> file_v")
    conf = F.when(F.col("confidence_score") >= 0.95, "EXTRACTED").when(F.col("confidence_score") >= 0.8, "INFERRED").otherwise("AMBIGUOUS")
    rel = F.when(F.col("relation") == "O", "calls").otherwise("semantically_similar_to")
    kind = lambda s: F.when(F.col(f"label_{s}").like("%ring"), "doc").otherwise("code")
    word = lambda s: F.split(f"label_{s}", " ")[0]
    score = k.surprise(conf, rel, kind("u"), kind("v"), word("u") != word("v"), F.col("file_u"), F.col("file_v"), F.col("community_u"), F.col("community_v"), F.col("degree_u"), F.col("degree_v"))
    return j.select("source", "target", conf.alias("conf"), "community_u", "community_v", score.alias("score"))


@query("mth8_surprise_score", f"with {SURPRISE} select source, target, score from surprise")
def mth8(spark, d):
    return _surprises(spark, d).select("source", "target", "score")


@query("g15_surprising_connections", f"with {SURPRISE} select source, target, score from surprise order by score desc, source, target limit 20")
def g15(spark, d):
    return _surprises(spark, d).select("source", "target", "score").orderBy(F.desc("score"), "source", "target").limit(20)


@query("w7_community_pair", f"with {SURPRISE}, r as (select least(cu, cv) as c1, greatest(cu, cv) as c2, source, target, row_number() over (partition by least(cu, cv), greatest(cu, cv) order by case conf when 'AMBIGUOUS' then 0 when 'INFERRED' then 1 else 2 end, source, target) as i from surprise where cu <> cv) select c1, c2, source, target from r where i = 1")
def w7(spark, d):
    s = _surprises(spark, d).where("community_u <> community_v")
    order = F.when(F.col("conf") == "AMBIGUOUS", 0).when(F.col("conf") == "INFERRED", 1).otherwise(2)
    best = s.groupBy(F.least("community_u", "community_v").alias("c1"), F.greatest("community_u", "community_v").alias("c2")).agg(F.min(F.struct(order.alias("o"), "source", "target")).alias("x"))
    return best.select("c1", "c2", "x.source", "x.target")


@query("g16_suggested_questions", f"""with {NODES}, {EDGES}, {DEGREE}, {FILES}, iso as (select id from nodes where id not in (select node from dg)), br as (select source_community as a, target_community as b, count(*) as n from ef where source_community <> target_community group by 1, 2)
select 'ambiguous_edges' as kind, count(*) as n from edges where confidence_score < 0.8 having count(*) > 0 union all select 'bridges', count(*) from br having count(*) > 0 union all select 'isolated', count(*) from iso having count(*) > 0 union all select 'hubs', count(*) from dg where degree >= 30 having count(*) > 0""")
def g16(spark, d):
    e, n = edges(spark, d), nodes(spark, d)
    deg = g.degree(e)
    one = lambda df, kind: df.agg(F.count("*").alias("n")).where("n > 0").select(F.lit(kind).alias("kind"), "n")
    bridges = _with_files(spark, d).where("source_community <> target_community").select("source_community", "target_community").distinct()
    out = one(e.where("confidence_score < 0.8"), "ambiguous_edges").unionByName(one(bridges, "bridges"))
    return out.unionByName(one(n.join(deg, F.col("id") == F.col("node"), "left_anti"), "isolated")).unionByName(one(deg.where("degree >= 30"), "hubs"))


@query("g19_budget_slice", f"""with recursive {NODES}, {EDGES}, r as (select 1::bigint as id, 0 as depth union select e.target, r.depth + 1 from r join edges e on e.source = r.id where r.depth < 2), f as (select id, min(depth) as depth from r group by 1),
s as (select f.id, depth, length(label) as chars, sum(length(label)) over (order by depth, f.id) as used, row_number() over (order by depth, f.id) as i from f join nodes on nodes.id = f.id) select id, depth, chars from s where used <= 400 or i = 1""")
def g19(spark, d):
    f = g.reach(edges(spark, d), spark.range(1, 2), 2).join(nodes(spark, d).select("id", F.length("label").alias("chars")), "id")
    return x.budget_slice(f, "chars", 100).select("id", "depth", "chars")


@query("g1c_betweenness")
def g1c(spark, d):
    n, e = nodes(spark, d), edges(spark, d)
    return k.betweenness(n, e, k.sampled_sources(n)).withColumn("betweenness", F.round("betweenness", 6))


def _importance(spark, d):
    scratch = Scratch(spark, "importance")
    n, e = nodes(spark, d), scratch.keep(edges(spark, d))
    deg = g.degree(e)
    top = F.broadcast(deg.agg(F.max("degree").alias("top")))
    central = deg.join(top).select(F.col("node").alias("id"), (F.col("degree") / F.col("top")).alias("degree_centrality"))
    return k.importance(g.pagerank(n, e), central, k.betweenness(n, e, k.sampled_sources(n)))


@query("g1d_importance")
def g1d(spark, d):
    return _importance(spark, d)


@query("g2_important_nodes")
def g2(spark, d):
    return _importance(spark, d).where("importance > 0").orderBy(F.desc("importance"), "id").limit(20)


RAW = "raw as (select case when l_linenumber % 3 = 0 then 'PART-' || l_partkey when l_linenumber % 3 = 1 then 'part_' || l_partkey else 'part ' || (l_partkey + 100000 * (l_quantity > 45)::int) end as source, 'supp_' || l_suppkey as target, l_orderkey * 10 + l_linenumber as ord, round(l_discount, 2) as weight from lineitem)"


def _raw(spark, d):
    p = F.col("l_partkey").cast("string")
    wild = (F.col("l_partkey") + F.when(F.col("l_quantity") > 45, 100000).otherwise(0)).cast("string")
    src = F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit("PART-"), p)).when(F.col("l_linenumber") % 3 == 1, F.concat(F.lit("part_"), p)).otherwise(F.concat(F.lit("part "), wild))
    return t(spark, d, "lineitem").select(src.alias("source"), F.concat(F.lit("supp_"), F.col("l_suppkey").cast("string")).alias("target"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), F.round("l_discount", 2).alias("weight"))


def _raw_nodes(spark, d):
    p = t(spark, d, "part").select(F.concat(F.lit("part_"), F.col("p_partkey").cast("string")).alias("id"))
    return p.unionByName(t(spark, d, "supplier").select(F.concat(F.lit("supp_"), F.col("s_suppkey").cast("string")).alias("id")))


REPAIRED = f"{RAW}, rn as (select 'part_' || p_partkey as id from part union all select 'supp_' || s_suppkey from supplier), rp as (select trim(regexp_replace(lower(source), '[^a-z0-9]+', '_', 'g'), '_') as source, target, ord, weight from raw where trim(regexp_replace(lower(source), '[^a-z0-9]+', '_', 'g'), '_') in (select id from rn) and target in (select id from rn))"


@query("j8_endpoint_repair", f"with {REPAIRED} select source, target, count(*) as n from rp group by 1, 2")
def j8(spark, d):
    raw = _raw(spark, d)
    return k.repaired_edges(_raw_nodes(spark, d), raw, c.id_norm).select("source", "target").repartition(shares(raw), "source", "target").groupBy("source", "target").agg(F.count("*").alias("n"))


@query("g21_graph_build", f"with {REPAIRED} select source, target, max(ord) as ord from rp group by 1, 2")
def g21(spark, d):
    raw = _raw(spark, d)
    e = k.repaired_edges(_raw_nodes(spark, d), raw, c.id_norm).repartition(shares(raw), "source", "target")
    return k.last_per_key(e.withColumn("at", F.struct("ord", "weight")), ["source", "target"], "at").select("source", "target", "ord")


@query("j10_stub_rewire", f"""with {EDGES}, n as (select p_partkey as id, p_name || p_brand as label, case when p_size <= 40 then p_brand end as file from part), u as (select label, min(id) as real from n where file is not null group by 1 having count(*) = 1), m as (select n.id as old, real from n join u using (label) where file is null)
select coalesce(a.real, source) as source, coalesce(b.real, target) as target, count(*) as n from edges left join m a on a.old = source left join m b on b.old = target group by 1, 2""")
def j10(spark, d):
    n = t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat("p_name", "p_brand").alias("label"), F.when(F.col("p_size") <= 40, F.col("p_brand")).alias("file"))
    return k.rewired_stubs(n, edges(spark, d).select("source", "target")).groupBy("source", "target").agg(F.count("*").alias("n"))


MERGE = f"""{NODES}, {EDGES}, {FILES}, stale as (select distinct file from nodes where file in ('Brand#3', 'Brand#7')), nn as (select id, label, file, community from nodes where file = 'Brand#3' and label like 's%'),
mn as (select * from nodes where file not in (select file from stale) union all select * from nn),
me as (select source, target, source_file, target_file from ef where source_file not in (select file from stale) and target_file not in (select file from stale) union all select source, target, source_file, target_file from ef where source_file = 'Brand#3'),
mm as (select * from me where source in (select id from mn) and target in (select id from mn))"""


def _merge(spark, d):
    n, e = nodes(spark, d), _with_files(spark, d).select("source", "target", "source_file", "target_file")
    stale = spark.createDataFrame([("Brand#3",), ("Brand#7",)], "file string")
    return k.merged_incremental(n, e, n.where("file = 'Brand#3' and label like 's%'"), e.where("source_file = 'Brand#3'"), stale)


@query("set4_incremental_nodes", f"with {MERGE} select id, file from mn")
def set4(spark, d):
    return _merge(spark, d)[0].select("id", "file")


@query("set4b_incremental_edges", f"with {MERGE} select source, target from mm")
def set4b(spark, d):
    return _merge(spark, d)[1].select("source", "target")


@query("set5_grow_merge", "select id, label from (select p_partkey as id, coalesce(case when p_size >= 25 then 'new ' || p_name end, p_name) as label from part where p_brand <> 'Brand#9')")
def set5(spark, d):
    p = t(spark, d, "part")
    old = p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("label"), "p_brand", F.lit(0).alias("ord"))
    new = p.where("p_size >= 25").select(F.col("p_partkey").alias("id"), F.concat(F.lit("new "), F.col("p_name")).alias("label"), "p_brand", F.lit(1).alias("ord"))
    return k.last_per_key(old.unionByName(new), ["id"], "ord").where("p_brand <> 'Brand#9'").select("id", "label")


@query("set7_repo_prefix", f"with {EDGES} select 'repo1::' || source as source, 'repo1::' || target as target from edges where source <> 7 and target <> 7")
def set7(spark, d):
    tag = lambda col: F.concat(F.lit("repo1::"), F.col(col).cast("string")).alias(col)
    return edges(spark, d).where("source <> 7 and target <> 7").select(tag("source"), tag("target"))


LABELLED = "nd as (select case when p_partkey % 5 = 0 then 'n' || p_partkey || '_c' || (p_partkey % 7) else 'n' || p_partkey end as id, p_name || p_brand as grp, p_partkey as ord from part)"


def _labelled(spark, d):
    p = F.col("p_partkey")
    i = F.concat(F.lit("n"), p.cast("string"))
    return t(spark, d, "part").select(F.when(p % 5 == 0, F.concat(i, F.lit("_c"), (p % 7).cast("string"))).otherwise(i).alias("id"), F.concat("p_name", "p_brand").alias("grp"), p.alias("ord"))


WIN = f"{LABELLED}, w as (select grp, arg_min(id, {{'a': regexp_matches(id, '_c[0-9]+$')::int, 'b': length(id), 'c': ord}}) as new from nd group by 1), rm as (select id as old, new from nd join w using (grp) where id <> new)"


@query("er6_winners", f"with {WIN} select old, new from rm")
def er6(spark, d):
    return k.winners(_labelled(spark, d), "grp", "ord")


@query("er7_remap_edges", f"with {WIN}, {EDGES}, e as (select a.id as source, b.id as target from edges join nd a on a.ord = source join nd b on b.ord = target) select coalesce(x.new, source) as source, coalesce(y.new, target) as target from e left join rm x on x.old = source left join rm y on y.old = target where coalesce(x.new, source) <> coalesce(y.new, target)")
def er7(spark, d):
    n = _labelled(spark, d)
    k.one_repository(n.withColumn("repo", F.lit("one")))
    at = lambda end: n.select(F.col("ord").alias(end), F.col("id").alias(f"{end}_id"))
    e = edges(spark, d).join(at("source"), "source").join(at("target"), "target").select(F.col("source_id").alias("source"), F.col("target_id").alias("target"))
    return k.remapped(e, k.winners(n, "grp", "ord"))


#: The pattern in this SQL is the fixed value codegraph.VARIANT.
STEMS = "st as (select p_partkey as id, lower(split_part(p_name, ' ', 2)) || p_size as a, lower(split_part(p_name, ' ', 2)) || (p_size + 1) || case when p_partkey % 2 = 0 then 'x' else '' end as b from part)"


@query("str7_variant_pair", f"with {STEMS} select id, a <> b and greatest(length(a), length(b)) < 12 and regexp_extract(a, '^(.*[a-z])([0-9]+[a-z]*|[a-z]{{2,}})$', 1) = regexp_extract(b, '^(.*[a-z])([0-9]+[a-z]*|[a-z]{{2,}})$', 1) as variant from st")
def str7(spark, d):
    word, p = F.lower(F.split("p_name", " ")[1]), F.col("p_partkey")
    a, b = F.concat(word, F.col("p_size").cast("string")), F.concat(word, (F.col("p_size") + 1).cast("string"), F.when(p % 2 == 0, "x").otherwise(""))
    return t(spark, d, "part").select(p.alias("id"), k.variant_pair(a, b).alias("variant"))


@query("str6_short_label", "select p_partkey as id, greatest(length(p_name), length(b)) < 12 and not (p_size >= 10 and length(p_name) = length(b) and damerau_levenshtein(p_name, b) <= 1) as blocked from (select *, case p_partkey % 3 when 0 then p_name || 's' when 1 then 'x' || substr(p_name, 2) else substr(p_name, 2, 1) || substr(p_name, 1, 1) || substr(p_name, 3) end as b from part)")
def str6(spark, d):
    p, name = F.col("p_partkey"), F.col("p_name")
    b = F.when(p % 3 == 0, F.concat(name, F.lit("s"))).when(p % 3 == 1, F.concat(F.lit("x"), F.substr(name, F.lit(2)))).otherwise(F.concat(F.substring(name, 2, 1), F.substring(name, 1, 1), F.substr(name, F.lit(3))))
    return t(spark, d, "part").select(p.alias("id"), k.short_label_blocked(name, b, F.when(F.col("p_size") >= 10, 98.0).otherwise(90.0)).alias("blocked"))


@query("x8_schema_validation", f"""with {RAW}, n as (select 'part_' || p_partkey as id, case when p_size > 3 then p_name end as label, case p_partkey % 4 when 0 then 'code' when 1 then 'document' when 2 then 'binary' end as file_type, p_partkey as row from part),
e as (select source, case when weight > 0.01 then target end as target, case when weight < 0.05 then 'GUESSED' else 'INFERRED' end as confidence, ord as row from raw)
select row, 'node without label' as problem from n where label is null union all select row, 'unknown file type' from n where file_type not in ('code', 'document', 'concept')
union all select row, 'unknown confidence' from e where confidence not in ('EXTRACTED', 'INFERRED', 'AMBIGUOUS') union all select row, 'edge without target' from e where target is null
union all select row, 'source is no node' from e where source not in (select id from n) union all select row, 'target is no node' from e where target is not null and target not in (select id from n)""")
def x8(spark, d):
    p = F.col("p_partkey")
    n = t(spark, d, "part").select(F.concat(F.lit("part_"), p.cast("string")).alias("id"), F.when(F.col("p_size") > 3, F.col("p_name")).alias("label"), F.when(p % 4 == 0, "code").when(p % 4 == 1, "document").when(p % 4 == 2, "binary").alias("file_type"), p.alias("row"))
    e = _raw(spark, d).select("source", F.when(F.col("weight") > 0.01, F.col("target")).alias("target"), F.when(F.col("weight") < 0.05, "GUESSED").otherwise("INFERRED").alias("confidence"), F.col("ord").alias("row"))
    return k.invalid_rows(n, e, ("code", "document", "concept"), ("EXTRACTED", "INFERRED", "AMBIGUOUS"))


@query("a7_file_outliers", f"with {NODES}, {EDGES}, {DEGREE}, f as (select file || '/' || community as file, max(degree) as degree from dg join nodes on id = node group by 1), s as (select avg(degree) as m, stddev_pop(degree) as sd, count(*) as n from f) select file, degree from f, s where n >= 4 and degree > m + 2.0 * sd order by degree desc, file limit 10")
def a7(spark, d):
    f = g.degree(edges(spark, d)).join(nodes(spark, d), F.col("node") == F.col("id")).groupBy(F.concat_ws("/", "file", "community").alias("file")).agg(F.max("degree").alias("degree"))
    return g.outliers(f, "degree", 2.0).orderBy(F.desc("degree"), "file").limit(10)


@query("j20_chain_attributes", f"with recursive {NODES}, {EDGES}, r as (select 1::bigint as id, 0 as depth union select e.target, r.depth + 1 from r join edges e on e.source = r.id where r.depth < 1 and e.confidence_score >= 0.9), f as (select id, min(depth) as depth from r group by 1) select f.id, depth, label, file from f left join nodes using (id)")
def j20(spark, d):
    e = edges(spark, d).where("confidence_score >= 0.9")
    return g.reach(e, spark.range(1, 2), 1).join(nodes(spark, d).select("id", "label", "file"), "id", "left")


@query("j7_auto_link", """with f as (select distinct p_type || p_brand as id, split_part(p_name, ' ', 2) as item from part), n as (select id, count(*) as n from f group by 1), p as (select a.id as a, b.id as b, count(*) as shared from f a join f b on a.item = b.item and a.id <> b.id group by 1, 2)
select p.a as source, p.b as target, round(shared / greatest(x.n, y.n)::double, 4) as strength from p join n x on x.id = p.a join n y on y.id = p.b where shared / greatest(x.n, y.n)::double >= 0.8""")
def j7(spark, d):
    from graphmill.operators.relational import overlap_links

    one = overlap_links(t(spark, d, "part").select(F.concat("p_type", "p_brand").alias("id"), F.split("p_name", " ")[1].alias("item")), 0.8)
    return one.select(F.col("a").alias("source"), F.col("b").alias("target"), "strength").unionByName(one.select(F.col("b").alias("source"), F.col("a").alias("target"), "strength"))
