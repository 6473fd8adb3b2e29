"""Graph queries over the supply graph: part -> supplier -> nation -> region."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from graphmill.operators import graph as g
from graphmill.plans.registry import query, table

#: Ids of suppliers, nations and regions follow those of parts.
SUPPLIER, NATION, REGION = 1_000_000_000, 2_000_000_000, 3_000_000_000

EDGES = f"""edges as (
  select l_partkey as source, {SUPPLIER} + l_suppkey as target, 'supplied_by' as relation, max(round(1 - 5 * l_discount, 2)) as confidence_score from lineitem group by 1, 2
  union all select {SUPPLIER} + s_suppkey, {NATION} + s_nationkey, 'located_in', 1.0 from supplier
  union all select {NATION} + n_nationkey, {REGION} + n_regionkey, 'located_in', 1.0 from nation)"""
NODES = f"""nodes as (
  select p_partkey as id, p_brand as grp from part
  union all select {SUPPLIER} + s_suppkey, 'supplier' from supplier
  union all select {NATION} + n_nationkey, 'nation' from nation
  union all select {REGION} + r_regionkey, 'region' from region)"""


def edges(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    e = t("lineitem").groupBy(F.col("l_partkey").alias("source"), (F.lit(SUPPLIER) + F.col("l_suppkey")).alias("target")).agg(F.max(F.round(1 - 5 * F.col("l_discount"), 2)).alias("confidence_score")).select("source", "target", F.lit("supplied_by").alias("relation"), "confidence_score")
    s = t("supplier").select((F.lit(SUPPLIER) + F.col("s_suppkey")).alias("source"), (F.lit(NATION) + F.col("s_nationkey").cast("long")).alias("target"), F.lit("located_in").alias("relation"), F.lit(1.0).alias("confidence_score"))
    n = t("nation").select((F.lit(NATION) + F.col("n_nationkey").cast("long")).alias("source"), (F.lit(REGION) + F.col("n_regionkey").cast("long")).alias("target"), F.lit("located_in").alias("relation"), F.lit(1.0).alias("confidence_score"))
    return e.unionAll(s).unionAll(n)


def nodes(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    p = t("part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("grp"))
    for name, key, base in (("supplier", "s_suppkey", SUPPLIER), ("nation", "n_nationkey", NATION), ("region", "r_regionkey", REGION)):
        p = p.unionAll(t(name).select((F.lit(base) + F.col(key).cast("long")).alias("id"), F.lit(name).alias("grp")))
    return p


def _pagerank_sql(rounds: int = 20) -> str:
    parts = [f"with {EDGES}, {NODES}", "e as (select source, target from edges where source <> target)", "o as (select source, count(*) as n_out from e group by 1)", "l as (select source, target, n_out from e join o using (source))", "n as (select count(*)::double as n from nodes)"]
    parts.append("r0 as (select id, 1.0 / (select n from n) as r from nodes)")
    for i in range(rounds):
        parts.append(f"g{i} as (select target as id, sum(r / n_out) as got from l join r{i} on r{i}.id = l.source group by 1)")
        parts.append(f"r{i + 1} as materialized (select r{i}.id, 0.15 / (select n from n) + 0.85 * (select coalesce(sum(r), 0) from r{i} where id not in (select source from o)) / (select n from n) + 0.85 * coalesce(got, 0) as r from r{i} left join g{i} using (id))")
    return ", ".join(parts) + f" select id, round(r / (select max(r) from r{rounds}), 6) as pagerank from r{rounds}"


@query("g1_pagerank", _pagerank_sql())
def pagerank(spark, sf_dir):
    return g.pagerank(nodes(spark, sf_dir), edges(spark, sf_dir)).select("id", F.round("pagerank", 6).alias("pagerank"))


@query("g1b_degree", f"with {EDGES} select node, count(*) as degree, round(count(*) / (max(count(*)) over ())::double, 6) as degree_centrality from (select source as node from edges union all select target from edges) group by 1")
def degree(spark, sf_dir):
    d = g.degree(edges(spark, sf_dir))
    top = F.broadcast(d.agg(F.max("degree").alias("_top")))
    return d.join(top).select("node", "degree", F.round(F.col("degree") / F.col("_top"), 6).alias("degree_centrality"))


@query("g3_impact", f"""with recursive {EDGES}, x as (select * from edges where confidence_score >= 0.6), up as (
  select {NATION} + 3 as id, 0 as depth union select x.source, up.depth + 1 from up join x on x.target = up.id),
f as (select id, min(depth) as depth from up group by 1),
b as (select x.source as id, max(x.confidence_score) as best from x join f a on a.id = x.source join f t on t.id = x.target where a.depth = t.depth + 1 group by 1)
select id, depth, case when depth = 1 then 'direct' else 'transitive' end as kind, case when best >= 0.85 then 'high' when best >= 0.6 then 'medium' else 'low' end as tier from f join b using (id) where depth > 0""")
def impact(spark, sf_dir):
    start = spark.range(1).select((F.lit(NATION) + 3).cast("long").alias("id"))
    return g.impact(edges(spark, sf_dir), start, 0.6)


@query("g4_call_chain", f"""with recursive {EDGES}, d as (select 1::bigint as id, 0 as depth union select e.target, d.depth + 1 from d join edges e on e.source = d.id where e.confidence_score >= 0.5 and d.depth < 3)
select id, min(depth) as depth from d group by 1""")
def call_chain(spark, sf_dir):
    e = edges(spark, sf_dir)
    return g.reach(e.where(g.edge_confidence(e) >= 0.5), spark.range(1, 2), 3)


@query("g5_blast_radius", f"""with recursive {EDGES}, {NODES}, h as (select distinct source as a, target as b from edges where confidence_score >= 0.9 and relation = 'supplied_by' union select target, source from edges where confidence_score >= 0.9 and relation = 'supplied_by'),
d as (select id, 0 as depth from nodes where id in (1, 2) union select h.b, d.depth + 1 from d join h on h.a = d.id where d.depth < 2),
f as (select id, min(depth) as depth from d group by 1)
select depth, count(*) as affected, round(count(*) / (select count(*) from nodes)::double, 4) as risk from f group by 1""")
def blast_radius(spark, sf_dir):
    e = edges(spark, sf_dir).where("confidence_score >= 0.9 and relation = 'supplied_by'")
    n = nodes(spark, sf_dir)
    f = g.reach(e, n.where("id in (1, 2)"), 2, undirected=True)
    all_nodes = F.broadcast(n.agg(F.count("*").alias("_all")))
    return f.groupBy("depth").agg(F.count("*").alias("affected")).join(all_nodes).select("depth", "affected", F.round(F.col("affected") / F.col("_all"), 4).alias("risk"))


@query("g8_dead_code", f"with {EDGES}, {NODES} select id, grp from nodes where id not in (select target from edges) and grp <> 'region'")
def dead_code(spark, sf_dir):
    return nodes(spark, sf_dir).where("grp <> 'region'").join(edges(spark, sf_dir).select(F.col("target").alias("id")).distinct(), "id", "left_anti").select("id", "grp")


#: Ids of orders come first; those of suppliers and customers follow.
CUSTOMER = 2_000_000_000


@query("g18_components", f"""with recursive e as (select o_orderkey as a, {CUSTOMER} + o_custkey as b from orders union select l_orderkey, {SUPPLIER} + l_suppkey from lineitem),
h as (select a, b from e union select b, a from e), w(id, component) using key (id) as (select a, least(a, min(b)) from h group by 1
  union select h.b, min(w.component) from w join h on h.a = w.id join recurring.w as k on k.id = h.b where w.component < k.component group by 1)
select id, component from w""")
def connected(spark, sf_dir):
    bought = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("source"), (F.lit(CUSTOMER) + F.col("o_custkey")).alias("target"))
    supplied = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("source"), (F.lit(SUPPLIER) + F.col("l_suppkey")).alias("target"))
    return g.components(bought.unionByName(supplied))


@query("g11_label_propagation")
def communities(spark, sf_dir):
    return g.label_propagation(edges(spark, sf_dir), 5)


@query("g7_cycles")
def cycles(spark, sf_dir):
    # part -> part of the next line of the same order, over all orders
    x = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("source"))
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "source")
    return g.strongly_connected(x.withColumn("target", F.lead("source").over(w)).where("target is not null").select("source", "target"))


@query("a10_cohesion", f"""with {EDGES}, {NODES}, p as (select distinct least(source, target) as a, greatest(source, target) as b from edges where source <> target),
m as (select id, case when id >= {REGION} then id - {REGION} when id >= {NATION} then n_regionkey when id >= {SUPPLIER} then -2 else -1 end as community from nodes left join nation on id = {NATION} + n_nationkey),
s as (select community, count(*) as n from m group by 1), i as (select x.community, count(*) as inner_edges from p join m x on x.id = a join m y on y.id = b where x.community = y.community group by 1)
select s.community, n, coalesce(inner_edges, 0) as inner_edges, case when n <= 1 then 1.0 else round(coalesce(inner_edges, 0) / (n * (n - 1) / 2), 6) end as cohesion from s left join i using (community)""")
def cohesion(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").select((F.lit(NATION) + F.col("n_nationkey").cast("long")).alias("id"), F.col("n_regionkey").cast("long").alias("r"))
    m = nodes(spark, sf_dir).join(nation, "id", "left").select("id", F.when(F.col("id") >= REGION, F.col("id") - REGION).when(F.col("id") >= NATION, F.col("r")).when(F.col("id") >= SUPPLIER, -2).otherwise(-1).alias("community"))
    return g.cohesion(edges(spark, sf_dir), m)


@query("a5_degree_outliers", f"""with {EDGES}, d as (select node, count(*) as degree from (select source as node from edges union all select target from edges) group by 1), s as (select avg(degree) as m, stddev_pop(degree) as sd, count(*) as n from d)
select node, degree from d, s where n >= 4 and degree > m + 2.0 * sd""")
def degree_outliers(spark, sf_dir):
    return g.outliers(g.degree(edges(spark, sf_dir)), "degree", 2.0)


@query("a11_edge_fusion", """with e as (select l_partkey as source, l_suppkey as target, l_returnflag as family, l_linestatus as resolver, round(1 - 9 * l_discount, 2) as c from lineitem)
select source, target, family, case when family in ('A', 'R') then round(least(0.98, sum(c::decimal(10,4))::double), 4) else max(c) end as confidence_score, array_to_string(list_sort(list(distinct resolver)), ',') as resolvers from e group by 1, 2, 3""")
def edge_fusion(spark, sf_dir):
    e = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("source"), F.col("l_suppkey").alias("target"), F.col("l_returnflag").alias("family"), F.col("l_linestatus").alias("resolver"), F.round(1 - 9 * F.col("l_discount"), 2).alias("confidence_score"))
    return g.fuse_edges(e, ("A", "R")).withColumn("resolvers", F.array_join("resolvers", ","))


@query("a12_cochange", """with x as (select distinct l_orderkey as grp, l_suppkey as item from lineitem), n as (select item, count(*) as n from x group by 1),
p as (select a.item as a, b.item as b, count(*) as together from x a join x b on a.grp = b.grp and a.item < b.item group by 1, 2 having count(*) >= 3),
s as (select p.*, together / greatest(na.n, nb.n)::double as raw from p join n na on na.item = a join n nb on nb.item = b)
select a, b, together, round(raw, 4) as strength, round(least(0.9, 0.5 + 0.5 * raw), 4) as confidence from s where raw >= 0.02""")
def cochange(spark, sf_dir):
    return g.cochange(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("grp"), F.col("l_suppkey").alias("item")), 3, 0.02)


@query("g17_graph_diff", """with o as (select distinct least(l_partkey, l_suppkey) as a, greatest(l_partkey, l_suppkey) as b from lineitem where l_linenumber <= 3), n as (select distinct least(l_partkey, l_suppkey) as a, greatest(l_partkey, l_suppkey) as b from lineitem where l_linenumber >= 3)
(select a, b, 'added' as change from (select * from n except select * from o)) union all (select a, b, 'removed' from (select * from o except select * from n))""")
def graph_diff(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").select("l_linenumber", F.least("l_partkey", "l_suppkey").alias("a"), F.greatest("l_partkey", "l_suppkey").alias("b"))
    return g.graph_diff(x.where("l_linenumber <= 3"), x.where("l_linenumber >= 3"), ["a", "b"])


@query("f16_prune_dangling", "select l_orderkey as source, l_partkey as target from lineitem where l_orderkey in (select o_orderkey from orders where o_orderstatus <> 'P') and l_partkey in (select p_partkey from part where p_size > 10)")
def prune(spark, sf_dir):
    e = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("source"), F.col("l_partkey").alias("target"))
    o = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("source"))
    p = table(spark, sf_dir, "part").where("p_size > 10").select(F.col("p_partkey").alias("target"))
    ends = o.select(F.col("source").alias("id"), F.lit("source").alias("end")).unionByName(p.select(F.col("target").alias("id"), F.lit("target").alias("end")))
    return g.prune_dangling(ends, e).select("source", "target")


@query("a8_cross_cluster", f"""with {EDGES}, m as (select {SUPPLIER} + s_suppkey as id, s_nationkey as c from supplier), k as (select a.target as s1, b.target as s2 from edges a join edges b on a.source = b.source and a.target < b.target where a.relation = 'supplied_by' and b.relation = 'supplied_by')
select least(x.c, y.c) as c1, greatest(x.c, y.c) as c2, count(*) as n from k join m x on x.id = s1 join m y on y.id = s2 where x.c <> y.c group by 1, 2 order by n desc, c1, c2 limit 20""")
def cross_cluster(spark, sf_dir):
    e = edges(spark, sf_dir).where("relation = 'supplied_by'")
    s = table(spark, sf_dir, "supplier").select((F.lit(SUPPLIER) + F.col("s_suppkey")).alias("target"), F.col("s_nationkey").alias("c"))
    # the suppliers of a part are few: a part is counted by its nations, then pairs of nations by products of counts
    per = e.join(s, "target").groupBy("source", "c").agg(F.count("*").alias("n"))
    p = per.select("source", F.col("c").alias("c1"), F.col("n").alias("n1")).join(per.select("source", F.col("c").alias("c2"), F.col("n").alias("n2")), "source").where("c1 < c2")
    return p.groupBy("c1", "c2").agg(F.sum(F.col("n1") * F.col("n2")).alias("n")).orderBy(F.desc("n"), "c1", "c2").limit(20)
