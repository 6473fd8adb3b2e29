"""Queries over what a quality service and a tracker land: pages of findings, component trees, duplicated lines, rich text."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphmill.operators.scratch import Scratch
from graphmill.plans.registry import query, table as t
from graphmill.sources import findings as fd

FINDINGS = """f as (select 'o' || o_orderkey as key, case o_orderkey % 3 when 0 then 'BUG' when 1 then 'CODE_SMELL' else 'SECURITY_HOTSPOT' end as type, o_orderpriority as severity, case o_orderstatus when 'O' then 'OPEN' when 'F' then 'CLOSED' else 'CONFIRMED' end as status,
  'c' || o_custkey as file, o_orderkey % 500 as line from orders)"""


def _landed(spark, d):
    """The orders as findings on pages of about 500, a number of them in a file, read back by the data source."""
    k = F.col("o_orderkey")
    kind = F.when(k % 3 == 0, "BUG").when(k % 3 == 1, "CODE_SMELL").otherwise(fd.HOTSPOT)
    status = F.when(F.col("o_orderstatus") == "O", "OPEN").when(F.col("o_orderstatus") == "F", "CLOSED").otherwise("CONFIRMED")
    issue = F.struct(F.concat(F.lit("o"), k.cast("string")).alias("key"), kind.alias("type"), F.col("o_orderpriority").alias("severity"), status.alias("status"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("file"), (k % 500).alias("line"))
    o = t(spark, d, "orders")
    page = o.groupBy(F.expr("o_orderkey div 500").alias("page")).agg(F.to_json(F.struct(F.collect_list(issue).alias("issues"))).alias("value"))
    folder = f"{Scratch(spark, 'findings').root}/pages"
    page.select("value").write.option("maxRecordsPerFile", fd.PAGES).text(folder)
    return fd.findings(spark, folder)


@query("src14_findings_scan", f"with {FINDINGS}, s as (select * from f where type in ('BUG', 'CODE_SMELL') and status in ('OPEN', 'CONFIRMED', 'REOPENED') and severity = (select min(o_orderpriority) from orders)) select key, type, file, line, (select count(*) from s) as total, (select count(*) from s) > 200 as truncated from s order by key limit 200")
def src14(spark, d):
    least = t(spark, d, "orders").agg(F.min("o_orderpriority")).first()[0]
    rows = fd.in_scope(_landed(spark, d), ["BUG", "CODE_SMELL", fd.HOTSPOT], [least])
    return fd.capped(rows, 200).select("key", "type", "file", "line", "total", "truncated")


@query("src15_hotspot_files", f"with {FINDINGS} select key, file, line from f where type = 'SECURITY_HOTSPOT' and file in ('c1', 'c2', 'c3', 'c5', 'c8', 'c13') order by key limit 10000")
def src15(spark, d):
    return fd.hotspots(_landed(spark, d), ["c1", "c2", "c3", "c5", "c8", "c13"]).select("key", "file", "line")


@query("src16_tree_totals", """with recursive c as (select p_partkey as key, case when p_partkey > 1 then p_partkey // 3 end as parent from part), k as (select c.key, p.key as parent from c left join c p on p.key = c.parent),
a as (select key, key as above from k union all select a.key, k.parent from a join k on k.key = a.above where k.parent is not null and k.parent <> k.key),
m as (select l_partkey as key, l_returnflag as metric, sum(l_linenumber)::bigint as value from lineitem group by 1, 2), s as (select above as key, metric, sum(value)::bigint as total, count(*) as n from a join m using (key) group by 1, 2)
select s.key, s.metric, m.value as own, total, n from s left join m using (key, metric)""")
def src16(spark, d):
    c = t(spark, d, "part").select(F.col("p_partkey").alias("key"), F.when(F.col("p_partkey") > 1, F.expr("p_partkey div 3")).alias("parent"))
    m = t(spark, d, "lineitem").select(F.col("l_partkey").alias("key"), F.col("l_returnflag").alias("metric"), F.col("l_linenumber").cast("long").alias("value"))
    return fd.tree_totals(c, m)


@query("src18_duplicated_lines", f"with {FINDINGS}, b as (select 'c' || o_custkey as file, o_orderkey % 400 as start, l_linenumber * 9 as length from lineitem join orders on l_orderkey = o_orderkey where l_quantity > 48) select f.key, f.file, f.line, count(*) as n_blocks from f join b on b.file = f.file and f.line >= b.start and f.line < b.start + b.length group by 1, 2, 3")
def src18(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("file"))
    b = t(spark, d, "lineitem").where("l_quantity > 48").join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("file", (F.col("o_orderkey") % 400).alias("start"), (F.col("l_linenumber") * 9).alias("length"))
    return fd.duplicated_lines(b, o.select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("key"), "file", (F.col("o_orderkey") % 500).alias("line")))


@query("src21_rich_text", """with w as (select row_number() over () as r, conv_id, turn, string_split(text, '. ') as s from conversations where text is not null and conv_id is not null and turn is not null)
select conv_id, turn, regexp_replace(array_to_string(list_transform(s, lambda x: x || chr(10)), ''), '^\\s+|\\s+$', '', 'g') as text from w""")
def src21(spark, d):
    c = t(spark, d, "conversations").where("text is not null and conv_id is not null and turn is not null")
    leaf = lambda x: F.struct(F.lit("text").alias("type"), x.alias("text"))
    line = lambda x: F.struct(F.lit("paragraph").alias("type"), F.array(leaf(x)).alias("content"))
    tree = F.to_json(F.struct(F.lit("doc").alias("type"), F.transform(F.split("text", "[.] ", -1), line).alias("content")))
    docs = c.select(F.struct("conv_id", "turn", F.monotonically_increasing_id().alias("i")).alias("id"), tree.alias("doc"))
    return fd.rich_text(Scratch(spark, "trees").keep(docs)).select("id.conv_id", "id.turn", "text")
