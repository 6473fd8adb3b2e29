"""Queries for rules over texts, rows and reports: normal forms, classes, gates, checklists and plans."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from graphmill.functions import rules as r
from graphmill.operators.graph import reach
from graphmill.operators.relational import cluster_labels, filter_or_all, first_per, link_plan, re_exports
from graphmill.plans.registry import query, table as t


@query("str10_url_strip", "select page_id, regexp_replace('see ' || url || ' for more', '(?i)https?://\\S+', ' ', 'g') as s from pages")
def str10(spark, d):
    return t(spark, d, "pages").select("page_id", r.strip_urls(F.concat(F.lit("see "), F.col("url"), F.lit(" for more"))).alias("s"))


@query("str11_diacritics", "select doc_id, strip_accents(lower(text)) as s from documents where text is not null")
def str11(spark, d):
    return t(spark, d, "documents").where("text is not null").select("doc_id", r.strip_diacritics(F.lower("text")).alias("s"))


@query("str12_keys_and_hosts", "select page_id, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) as host, regexp_extract(upper('fix proj-' || page_id || ' now'), '([A-Z][A-Z0-9_]*-[0-9]+)', 1) as key from pages")
def str12(spark, d):
    return t(spark, d, "pages").select("page_id", r.host(F.col("url")).alias("host"), r.issue_key(F.concat(F.lit("fix proj-"), F.col("page_id").cast("string"), F.lit(" now"))).alias("key"))


@query("str16_slugs", "select p_partkey, trim(regexp_replace(lower(p_name || ' / ' || p_brand), '[^a-z0-9]+', '-', 'g'), '-') as slug, replace(replace(p_name || '''s', '\\', '\\\\'), '''', '\\''') as escaped, regexp_replace(p_brand || ':' || p_name, '[^A-Za-z0-9._-]+', '_', 'g') as file from part")
def str16(spark, d):
    return t(spark, d, "part").select("p_partkey", r.slug(F.concat("p_name", F.lit(" / "), "p_brand")).alias("slug"), r.cypher_escape(F.concat("p_name", F.lit("'s"))).alias("escaped"), r.safe_file_name(F.concat("p_brand", F.lit(":"), "p_name")).alias("file"))


SELECTORS = "sel as (select p_partkey as id, case p_partkey % 5 when 0 then '#' || p_name when 1 then '[data-testid=\"' || p_name || '\"]' when 2 then '[name=\"x\"]' when 3 then '.' || p_name else p_name end as s from part)"


def _selectors():
    p, n = F.col("p_partkey"), F.col("p_name")
    return F.when(p % 5 == 0, F.concat(F.lit("#"), n)).when(p % 5 == 1, F.concat(F.lit('[data-testid="'), n, F.lit('"]'))).when(p % 5 == 2, F.lit('[name="x"]')).when(p % 5 == 3, F.concat(F.lit("."), n)).otherwise(n)


@query("str20_selectors", f"with {SELECTORS} select id, replace(regexp_replace(lower(trim(s)), '\\s+', '', 'g'), '\"', '''') as norm, case when s like '%data-testid%' then 0 when s like '#%' then 1 when s like '%[name=%' then 2 when s like '.%' then 3 else 4 end as specificity from sel")
def str20(spark, d):
    s = _selectors()
    return t(spark, d, "part").select(F.col("p_partkey").alias("id"), r.selector_norm(s).alias("norm"), r.specificity(s).alias("specificity"))


@query("str24_embed_text", "select conv_id, turn, concat_ws(' ', nullif(role, ''), case when turn % 2 = 0 then 'k' || turn end, nullif(left(text, 1000), '')) as s from conversations")
def str24(spark, d):
    return t(spark, d, "conversations").select("conv_id", "turn", r.embed_text([F.col("role"), F.when(F.col("turn") % 2 == 0, F.concat(F.lit("k"), F.col("turn").cast("string")))], F.col("text")).alias("s"))


@query("cls3_risk_tier", "with x as (select conv_id, turn, lower(text) as s, role from conversations) select conv_id, turn, case when contains(s, 'thoug') or contains(s, 'secret') then 'critical' when (contains(s, 'ent') or contains(s, 'query'))::int + (contains(s, 'route') or contains(s, 'tion'))::int + (contains(s, 'hab') or contains(s, 'form'))::int + (role = 'system')::int >= 2 then 'high' else 'medium' end as tier from x")
def cls3(spark, d):
    return t(spark, d, "conversations").select("conv_id", "turn", r.risk_tier(F.lower("text"), ["thoug", "secret"], [["ent", "query"], ["route", "tion"], ["hab", "form"]], F.col("role") == "system").alias("tier"))


@query("cls5_file_flags", "select page_id, case when regexp_matches(html, '<form|<button|<nav') then 'frontend' when contains(html, '<code') then 'backend' else 'shared' end as layer, contains(html, '<') as renderable, regexp_matches(html, 'data-testid|id=\"') as has_stable_selector, contains(html, 'href=\"/') as has_route from pages")
def cls5(spark, d):
    return t(spark, d, "pages").select("page_id", *r.file_flags(F.col("html")))


@query("x19_compat_verdict", """with f as (select page_id, case when regexp_matches(html, '<form|<button|<nav') then 'frontend' when contains(html, '<code') then 'backend' else 'shared' end as layer, contains(html, '<') as renderable, regexp_matches(html, 'data-testid|id="') as sel from pages)
select page_id, layer <> 'backend' and not (layer = 'shared' and not renderable) and sel as ui_ok, case when layer = 'backend' then 'backend file' when layer = 'shared' and not renderable then 'no markup' when not sel then 'no stable selector' else '' end as reason from f""")
def x19(spark, d):
    f = t(spark, d, "pages").select("page_id", *r.file_flags(F.col("html")))
    return f.select("page_id", *r.ui_verdict(F.col("layer"), F.col("renderable"), F.col("has_stable_selector")))


@query("cls6_persona", "with x as (select doc_id, regexp_replace(lower(text), '(?i)https?://\\S+', ' ', 'g') as s, source from documents) select doc_id, case when regexp_matches(s, '\\bthoug\\w*') or contains(s, 'null pointer') then 'backend' when regexp_matches(s, '\\bform\\w*') or regexp_matches(s, '\\bwhint\\w*') then 'frontend' when source = 'web' then 'architect' end as persona from x")
def cls6(spark, d):
    return t(spark, d, "documents").select("doc_id", r.keyword_class(r.strip_urls(F.lower("text")), [("backend", ["thoug", "null pointer"]), ("frontend", ["form", "whint"])], F.when(F.col("source") == "web", "architect")).alias("persona"))


@query("cls7_merge_status", "select o_orderkey, case when s is null then 'UNKNOWN' when s in ('checking', 'unchecked', 'preparing') then 'CHECKING' when s in ('can_be_merged', 'mergeable') then 'MERGEABLE' when s in ('cannot_be_merged', 'cannot_be_merged_recheck', 'conflict') then 'CONFLICTED' when s = 'unknown' then 'UNKNOWN' else 'BLOCKED' end as bucket from (select o_orderkey, ['checking', 'mergeable', 'conflict', 'not_approved', 'unknown', null][1 + o_orderkey % 6] as s from orders)")
def cls7(spark, d):
    s = F.get(F.array(*(F.lit(x) for x in ("checking", "mergeable", "conflict", "not_approved", "unknown", None))), (F.col("o_orderkey") % 6).cast("int"))
    return t(spark, d, "orders").select("o_orderkey", r.merge_status(s).alias("bucket"))


@query("cls9_attachments", "with f as (select l_orderkey, list('f' || l_linenumber || ['.png', '.MP4', '.pdf', '.exe'][1 + l_suppkey % 4] order by l_linenumber, l_suppkey, l_partkey) as n from lineitem group by 1) select l_orderkey, array_to_string(list_filter(n, lambda x: lower(x) like '%.png'), ',') as images, array_to_string(list_filter(n, lambda x: lower(x) like '%.mp4'), ',') as media, array_to_string(list_filter(n, lambda x: lower(x) like '%.pdf'), ',') as documents, array_to_string(list_filter(n, lambda x: lower(x) like '%.exe'), ',') as unsupported from f")
def cls9(spark, d):
    ext = F.get(F.array(*(F.lit(x) for x in (".png", ".MP4", ".pdf", ".exe"))), (F.col("l_suppkey") % 4).cast("int"))
    f = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey", "l_partkey", ext.alias("e")))), lambda x: F.concat(F.lit("f"), x["l_linenumber"].cast("string"), x["e"])).alias("n"))
    return f.select("l_orderkey", *(F.array_join(c, ",").alias(k) for k, c in r.attachment_classes(F.col("n")).items()))


@query("cls10_verdict", "select o_orderkey, case when s >= 0.72 then 'seen_before' when o_orderkey % 4 = 0 or o_orderkey % 7 = 0 then 'pattern_match' else 'novel' end as verdict, case when s >= 0.72 then s when o_orderkey % 4 = 0 then 0.6::double when o_orderkey % 7 = 0 then 0.55::double else 0.0::double end as confidence, s >= 0.80 and o_orderstatus = 'F' as skip_diagnosis from (select *, round(o_totalprice / 500000, 4) as s from orders)")
def cls10(spark, d):
    o = F.col("o_orderkey")
    return t(spark, d, "orders").withColumn("s", F.round(F.col("o_totalprice") / 500000, 4)).select("o_orderkey", *r.verdict(F.col("s"), o % 4 == 0, o % 7 == 0, F.col("o_orderstatus") == "F"))


@query("dt3_staleness", "select s_suppkey, changed, changed > 0 as is_stale, changed = 0 or changed <= 20 or changed / greatest(total, 1)::double < 0.1 as serve_existing from (select l_suppkey as s_suppkey, count(*) filter (where l_quantity > 30) as changed, count(*) as total from lineitem group by 1)")
def dt3(spark, d):
    x = t(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count_if(F.col("l_quantity") > 30).alias("changed"), F.count("*").alias("total"))
    return x.select("s_suppkey", "changed", (F.col("changed") > 0).alias("is_stale"), r.serve_existing(F.col("changed"), F.col("total"), 20, 0.1).alias("serve_existing"))


@query("map2_metric_pivot", "select user_id, max(case when event_type = 'view' then value end) as view, max(case when event_type = 'click' then value end) as click, max(case when event_type = 'error' then value end) as error from (select user_id, event_type, max(value) as value from events group by 1, 2) group by 1")
def map2(spark, d):
    e = t(spark, d, "events").groupBy("user_id", "event_type").agg(F.max("value").alias("value"))
    m = e.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "value"))).alias("m"))
    return m.select("user_id", *(F.element_at("m", k).alias(k) for k in ("view", "click", "error")))


@query("arr1_dimension_merge")
def arr1(spark, d):
    dims = F.split("text", "[.!?]+ *")
    return t(spark, d, "conversations").select("conv_id", "turn", F.array_join(r.merged_dimensions(["correctness of the result", "security of inputs"], dims, 6), " | ").alias("dims"))


@query("lim12_capped_dedup", "with w as (select conv_id, turn, list_filter(list_transform(string_split(text, '.'), lambda x: trim(x)), lambda x: len(x) >= 4) as d from conversations), n as (select conv_id, turn, d, list_transform(d, lambda x: trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g'))) as k from w) select conv_id, turn, array_to_string((list_filter(d, lambda x, i: list_position(k, k[i]) = i))[1:5], ' | ') as dims from n")
def lim12(spark, d):
    return t(spark, d, "conversations").select("conv_id", "turn", F.array_join(r.capped_dedup(F.split("text", "[.]"), 5), " | ").alias("dims"))


@query("a26_heal_trend", "select event_id // 100 as run, count(*) filter (where event_type = 'signup') as heals from events group by 1 order by 1")
def a26(spark, d):
    return t(spark, d, "events").groupBy(F.expr("event_id div 100").alias("run")).agg(F.count_if(F.col("event_type") == "signup").alias("heals")).orderBy("run")


@query("a28_test_gaps", "select p_brand, p_type from part group by 1, 2 having count(*) filter (where p_size > 40) = 0")
def a28(spark, d):
    return t(spark, d, "part").groupBy("p_brand", "p_type").agg(F.count_if(F.col("p_size") > 40).alias("covered")).where("covered = 0").select("p_brand", "p_type")


LAYERS = {"F": ["unit", "integration", "security"], "O": ["unit", "integration"], "P": ["unit"]}


@query("a31_confidence_report", "with l as (select l_orderkey as o, count(*) as total, count(*) filter (where l_returnflag <> 'A' and l_quantity > 10 and l_tax > 0) as complete, list_distinct(list(case l_linestatus when 'F' then 'unit' else 'integration' end)) as run from lineitem group by 1) select o_orderkey, round(complete / total::double, 2) as confidence, array_to_string(list_sort(list_filter(case o_orderstatus when 'F' then ['unit', 'integration', 'security'] when 'O' then ['unit', 'integration'] else ['unit'] end, lambda x: not list_contains(run, x))), ',') as remaining from orders join l on o = o_orderkey")
def a31(spark, d):
    li = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(r.confidence_score((F.col("l_returnflag") != "A"), F.col("l_quantity") > 10, F.col("l_tax") > 0).alias("confidence"), F.collect_set(F.when(F.col("l_linestatus") == "F", "unit").otherwise("integration")).alias("run"))
    return t(spark, d, "orders").join(li, "o_orderkey").select("o_orderkey", "confidence", F.array_join(F.array_sort(r.remaining_layers(F.col("o_orderstatus"), LAYERS, F.col("run"))), ",").alias("remaining"))


@query("set8_remaining_layers", "select o_orderstatus, array_to_string(list_sort(list_filter(case o_orderstatus when 'F' then ['unit', 'integration', 'security'] when 'O' then ['unit', 'integration'] else ['unit'] end, lambda x: x <> 'unit')), ',') as remaining from (select distinct o_orderstatus from orders)")
def set8(spark, d):
    return t(spark, d, "orders").select("o_orderstatus").distinct().select("o_orderstatus", F.array_join(F.array_sort(r.remaining_layers(F.col("o_orderstatus"), LAYERS, F.array(F.lit("unit")))), ",").alias("remaining"))


@query("a34_census_reconciliation", "with c as (select p_brand, p_type as category, count(*) filter (where p_size > 25) as mapped, count(*) filter (where p_size <= 25) as unmapped, count(*) as total from part group by 1, 2) select p_brand, category, mapped + unmapped = total as consistent, round(mapped / total::double, 4) as coverage, mapped / total::double < 0.3 as error from c")
def a34(spark, d):
    c = t(spark, d, "part").groupBy("p_brand", F.col("p_type").alias("category")).agg(F.count_if(F.col("p_size") > 25).alias("mapped"), F.count_if(F.col("p_size") <= 25).alias("unmapped"), F.count("*").alias("total"))
    share = F.col("mapped") / F.col("total")
    return c.select("p_brand", "category", (F.col("mapped") + F.col("unmapped") == F.col("total")).alias("consistent"), F.round(share, 4).alias("coverage"), (share < 0.3).alias("error"))


ISSUES = "iss as (select p_partkey as id, case p_partkey % 3 when 0 then 'bug' when 1 then 'story' else 'task ' end as kind, case when p_size > 5 then p_name end as summary, case when p_size % 2 = 0 then p_type end as description, case when p_size % 3 = 0 then 'step' end as steps, case when p_size % 5 <> 0 then 'e' end as expected, case when p_size % 7 <> 0 then 'a' end as actual, case when p_size > 30 then p_brand end as impact, case when p_size % 4 = 0 then 'ac' end as criteria, p_partkey % 11 = 0 as no_schema, p_partkey % 2 = 0 as due from part)"


def _issues(spark, d):
    p, z = F.col("p_partkey"), F.col("p_size")
    return t(spark, d, "part").select(
        p.alias("id"), F.when(p % 3 == 0, "bug").when(p % 3 == 1, "story").otherwise("task ").alias("kind"), F.when(z > 5, F.col("p_name")).alias("summary"), F.when(z % 2 == 0, F.col("p_type")).alias("description"),
        F.when(z % 3 == 0, "step").alias("steps"), F.when(z % 5 != 0, "e").alias("expected"), F.when(z % 7 != 0, "a").alias("actual"), F.when(z > 30, F.col("p_brand")).alias("impact"), F.when(z % 4 == 0, "ac").alias("criteria"), (p % 11 == 0).alias("no_schema"), (p % 2 == 0).alias("due"),
    )


_HAS = "({0} is not null)::int"
_SUM = lambda *c: "(" + " + ".join(_HAS.format(x) for x in c) + f") / {len(c)}.0::double"
COMPLETE = f"case kind when 'bug' then round({_SUM('summary', 'description', 'steps', 'expected', 'actual', 'impact')}, 2) when 'story' then round({_SUM('summary', 'description', 'criteria', 'impact')}, 2) else round({_SUM('summary', 'description', 'impact')}, 2) end"


@query("a35_completeness", f"with {ISSUES} select id, case when kind = 'story' and no_schema and {COMPLETE} >= 0.80 then 0.79::double else {COMPLETE} end as score from iss")
def a35(spark, d):
    return _issues(spark, d).select("id", r.completeness(F.col("kind"), (F.col("kind") == "story") & F.col("no_schema")).alias("score"))


@query("x4_missing_information", f"with {ISSUES} select id, array_to_string(list_filter([case when description is null then 'detailed_description' end, case when impact is null then 'impact' end, case when kind = 'bug' and steps is null then 'reproduction_steps' end, case when kind = 'bug' and expected is null then 'expected_behavior' end, case when kind = 'bug' and actual is null then 'actual_behavior' end, case when kind = 'story' and criteria is null then 'acceptance_criteria' end, case when kind = 'story' and no_schema then 'missing_schema' end, case when not due then 'due_date' end], lambda x: x is not null), ',') as missing from iss")
def x4(spark, d):
    return _issues(spark, d).select("id", F.array_join(r.missing_information(), ",").alias("missing"))


@query("a36_mutation_gate", "select l_suppkey, killed, total, case when total = 0 then 0.0::double else round(killed / total::double, 4) end as score, total > 0 and killed / total::double >= 0.6 as passed from (select l_suppkey, count(*) filter (where l_returnflag <> 'N') as killed, count(*) filter (where l_returnflag <> 'N' or l_linestatus = 'O') as total from lineitem group by 1)")
def a36(spark, d):
    x = t(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count_if(F.col("l_returnflag") != "N").alias("killed"), F.count_if((F.col("l_returnflag") != "N") | (F.col("l_linestatus") == "O")).alias("total"))
    return x.select("l_suppkey", "killed", "total", *r.mutation_gate(F.col("killed"), F.col("total"), 0.6))


@query("f12_lean_projection", "select doc_id, lang, source from documents where n_chars > 500")
def f12(spark, d):
    return t(spark, d, "documents").where("n_chars > 500").select("doc_id", "lang", "source")


@query("f17_merged_branches", """with recursive up as (select 900::bigint as id union select p.parent from up join (select o_orderkey as id, o_orderkey // 2 as parent from orders where o_orderkey > 0 union all select o_orderkey, o_orderkey - 32 from orders where o_orderkey % 5 = 0 and o_orderkey > 32) p using (id))
select o_orderkey as branch from orders where o_orderkey in (select id from up) and o_orderdate < timestamp '1996-01-01'""")
def f17(spark, d):
    o = t(spark, d, "orders")
    k = F.col("o_orderkey")
    parents = o.where("o_orderkey > 0").select(k.alias("source"), F.expr("o_orderkey div 2").alias("target")).unionByName(o.where("o_orderkey % 5 = 0 and o_orderkey > 32").select(k.alias("source"), (k - 32).alias("target")))
    up = reach(parents, spark.range(900, 901))
    return o.where("o_orderdate < timestamp_ntz '1996-01-01'").join(up.select(F.col("id").alias("o_orderkey")), "o_orderkey", "left_semi").select(k.alias("branch"))


@query("x16_unique_commits", """with recursive p as (select o_orderkey as id, o_orderkey // 2 as parent from orders where o_orderkey > 0), a as (select 900::bigint as id union select parent from a join p using (id)), b as (select 901::bigint as id union select parent from b join p using (id)) select id from a where id not in (select id from b)""")
def x16(spark, d):
    e = t(spark, d, "orders").where("o_orderkey > 0").select(F.col("o_orderkey").alias("source"), F.expr("o_orderkey div 2").alias("target"))
    return reach(e, spark.range(900, 901)).select("id").join(reach(e, spark.range(901, 902)).select("id"), "id", "left_anti")


@query("f18_quoted_predicate", "select p_partkey from part where p_name || '''s' = 'red ring''s'")
def f18(spark, d):
    return t(spark, d, "part").where(F.concat("p_name", F.lit("'s")) == F.lit("red ring's")).select("p_partkey")


@query("j13_duplication_refs", "with b as (select l_orderkey as blk, unnest(list_distinct(list(l_partkey))) as ref from lineitem group by 1), f as (select o_orderkey as id, o_orderkey as blk from orders where o_orderstatus = 'P') select f.id, count(p_partkey) as refs from f left join b using (blk) left join part on p_partkey = ref and p_size > 10 group by 1")
def j13(spark, d):
    b = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("p_partkey")).distinct()
    f = t(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("id"))
    return f.join(b, "id", "left").join(t(spark, d, "part").where("p_size > 10").select("p_partkey", F.lit(1).alias("hit")), "p_partkey", "left").groupBy("id").agg(F.count("hit").alias("refs"))


@query("lim7_files_by_metric", "select p_brand as file, round(avg(p_size), 4) as metric from part group by 1 order by metric, file limit 7")
def lim7(spark, d):
    return t(spark, d, "part").groupBy(F.col("p_brand").alias("file")).agg(F.round(F.avg("p_size"), 4).alias("metric")).orderBy("metric", "file").limit(7)


@query("lim10_structured_tags", "with s as (select p_brand as skill, list_distinct(list(p_type)) as tags, list_distinct(list(split_part(p_name, ' ', 1))) as patterns from part group by 1) select skill, len(list_filter(tags, lambda x: x in ('ECONOMY', 'PROMO', 'LARGE'))) + list_contains(patterns, 'red')::int as score from s where len(list_filter(tags, lambda x: x in ('ECONOMY', 'PROMO', 'LARGE'))) + list_contains(patterns, 'red')::int > 0 order by score desc, skill limit 5")
def lim10(spark, d):
    s = t(spark, d, "part").groupBy(F.col("p_brand").alias("skill")).agg(F.collect_set("p_type").alias("tags"), F.collect_set(F.split("p_name", " ")[0]).alias("patterns"))
    score = F.size(F.array_intersect("tags", F.array(*(F.lit(x) for x in ("ECONOMY", "PROMO", "LARGE"))))) + F.array_contains("patterns", "red").cast("int")
    return s.select("skill", score.alias("score")).where("score > 0").orderBy(F.desc("score"), "skill").limit(5)


@query("x5_done_rows", "with a as (select l_orderkey as id, list_sort(list_distinct(list('step ' || l_linenumber))) as steps from lineitem where l_quantity > 25 group by 1) select o_orderkey as id, case when o_orderstatus = 'F' and steps is not null then 'Reproduce then confirm resolved: ' || s when o_orderstatus <> 'F' and steps is not null then 'Acceptance criterion satisfied: ' || s else 'Run the affected path and observe: ' || o_orderpriority end as item from orders left join a on a.id = o_orderkey, unnest(coalesce(steps, ['x'])) as u(s)")
def x5(spark, d):
    a = t(spark, d, "lineitem").where("l_quantity > 25").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_set(F.concat(F.lit("step "), F.col("l_linenumber").cast("string")))).alias("steps"))
    j = t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_orderstatus", "o_orderpriority").join(a, "id", "left")
    return j.select("id", F.explode(r.done_items(F.col("o_orderstatus") == "F", F.col("steps"), F.col("o_orderpriority"))).alias("item"))


@query("x6_evidence", "select l_orderkey as id, bool_and(l_tax > 0.01 and l_quantity > 5 and l_returnflag <> 'A') as accepted, count(*) filter (where not l_tax > 0.01) + count(*) filter (where not l_quantity > 5) + count(*) filter (where l_returnflag = 'A') as missing from lineitem group by 1")
def x6(spark, d):
    bad = [F.col("l_tax") <= 0.01, F.col("l_quantity") <= 5, F.col("l_returnflag") == "A"]
    missing = F.count_if(bad[0]) + F.count_if(bad[1]) + F.count_if(bad[2])
    return t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg((missing == 0).alias("accepted"), missing.alias("missing"))


@query("x7_low_confidence", "select o_orderkey, o_totalprice / 500000 < 0.2 or (o_orderkey % 3 = 0 and coalesce(chars, 0) < 40) or (o_orderstatus = 'F' and o_orderkey % 10 = 0) as low from orders left join (select l_orderkey, sum(l_quantity) as chars from lineitem where l_linestatus = 'F' group by 1) on l_orderkey = o_orderkey")
def x7(spark, d):
    c = t(spark, d, "lineitem").where("l_linestatus = 'F'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").alias("chars"))
    o = F.col("o_orderkey")
    return t(spark, d, "orders").join(c, "o_orderkey", "left").select("o_orderkey", r.low_confidence(F.col("o_totalprice") / 500000, 0.2, o % 3 == 0, F.coalesce("chars", F.lit(0)), 40, (F.col("o_orderstatus") == "F") & (o % 10 == 0)).alias("low"))


@query("x10_symbol_table", "select p_brand as file, array_to_string(list_sort(list_distinct(list(p_name))), ',') as symbols from part group by 1")
def x10(spark, d):
    return t(spark, d, "part").groupBy(F.col("p_brand").alias("file")).agg(F.array_join(F.array_sort(F.collect_set("p_name")), ",").alias("symbols"))


@query("x11_file_imports", "with im as (select distinct l_orderkey as file, p_brand as module, p_name as symbol from lineitem join part on l_partkey = p_partkey where l_quantity > 45), de as (select p_brand as module, p_name as symbol, min(p_partkey) as node from part group by 1, 2) select file, node from im join de using (module, symbol)")
def x11(spark, d):
    p = t(spark, d, "part").select("p_partkey", F.col("p_brand").alias("module"), F.col("p_name").alias("symbol"))
    im = t(spark, d, "lineitem").where("l_quantity > 45").join(p, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("file"), "module", "symbol").distinct()
    return im.join(p.groupBy("module", "symbol").agg(F.min("p_partkey").alias("node")), ["module", "symbol"]).select("file", "node")


@query("x12_re_exports", "with recursive x as (select p_partkey as m, p_partkey // 3 as via from part where p_partkey > 0 and p_size % 2 = 0), d as (select p_partkey as m, p_name as symbol from part where p_type = 'PROMO'), e as (select m, symbol from d union select x.m, e.symbol from x join e on e.m = x.via) select m, symbol from e")
def x12(spark, d):
    p = t(spark, d, "part")
    via = p.where("p_partkey > 0 and p_size % 2 = 0").select(F.expr("p_partkey div 3").alias("via"), F.col("p_partkey").alias("m"))
    return re_exports(p.where("p_type = 'PROMO'").select(F.col("p_partkey").alias("m"), F.col("p_name").alias("symbol")), via)


@query("x13_extension_merge", "with n as (select p_partkey as id, p_name || p_type as label, p_size % 3 = 0 as ext from part), b as (select label, min(id) as base from n where not ext group by 1) select id, base as merged_into from n join b using (label) where ext")
def x13(spark, d):
    n = t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat("p_name", "p_type").alias("label"), (F.col("p_size") % 3 == 0).alias("ext"))
    return n.where("ext").join(n.where("not ext").groupBy("label").agg(F.min("id").alias("merged_into")), "label").select("id", "merged_into")


@query("x18_pin_staleness", "with p as (select l_orderkey as manifest, l_partkey as dep, max(l_linenumber) as pin from lineitem where l_quantity > 40 group by 1, 2), r as (select p_partkey as dep, p_size % 5 + 1 as ref from part where p_size <> 13) select manifest, dep, case when ref is null then 'unknown' when pin = ref then 'current' when pin < ref then 'behind' else 'ahead' end as state from p left join r using (dep)")
def x18(spark, d):
    p = t(spark, d, "lineitem").where("l_quantity > 40").groupBy(F.col("l_orderkey").alias("manifest"), F.col("l_partkey").alias("dep")).agg(F.max("l_linenumber").alias("pin"))
    ref = t(spark, d, "part").where("p_size <> 13").select(F.col("p_partkey").alias("dep"), (F.col("p_size") % 5 + 1).alias("ref"))
    state = F.when(F.col("ref").isNull(), "unknown").when(F.col("pin") == F.col("ref"), "current").when(F.col("pin") < F.col("ref"), "behind").otherwise("ahead")
    return p.join(ref, "dep", "left").select("manifest", "dep", state.alias("state"))


@query("x20_framework", "select l_orderkey, coalesce(max(case when p_type = 'PROMO' then 'promo' end), max(case when p_type = 'LARGE' then 'large' end), max(case when p_name like '%ring' then 'ring' end), 'generic') as framework from lineitem join part on l_partkey = p_partkey group by 1")
def x20(spark, d):
    j = t(spark, d, "lineitem").join(t(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return j.groupBy("l_orderkey").agg(r.first_hit([("promo", F.col("p_type") == "PROMO"), ("large", F.col("p_type") == "LARGE"), ("ring", F.col("p_name").endswith("ring"))], "generic").alias("framework"))


@query("x22_test_category", "select p_partkey, case when starts_with(lower(p_name), 'small') or starts_with(lower(p_name), 'large') then 'boundary' when starts_with(lower(p_name), 'red') then 'security' else 'functional' end as category from part")
def x22(spark, d):
    return t(spark, d, "part").select("p_partkey", r.prefix_class(F.col("p_name"), [("boundary", ["small", "large"]), ("security", ["red"])], "functional").alias("category"))


@query("x24_header_audit", "with q as (select unnest(['ECONOMY', 'PROMO', 'LARGE']) as name), h as (select p_brand as site, p_type as name, min(p_name) as v from part where p_size > 20 group by 1, 2), s as (select distinct p_brand as site from part) select site, q.name, h.v is not null and not (q.name = 'PROMO' and h.v not like '%ring%') as passed, case when q.name = 'ECONOMY' then 'high' else 'medium' end as severity from s cross join q left join h using (site, name)")
def x24(spark, d):
    p = t(spark, d, "part")
    h = p.where("p_size > 20").groupBy(F.col("p_brand").alias("site"), F.col("p_type").alias("name")).agg(F.min("p_name").alias("v"))
    need = p.select(F.col("p_brand").alias("site")).distinct().select("site", F.explode(F.array(*(F.lit(x) for x in ("ECONOMY", "PROMO", "LARGE")))).alias("name"))
    j = need.join(h, ["site", "name"], "left")
    return j.select("site", "name", (F.col("v").isNotNull() & ~((F.col("name") == "PROMO") & ~F.coalesce(F.col("v").like("%ring%"), F.lit(False)))).alias("passed"), F.when(F.col("name") == "ECONOMY", "high").otherwise("medium").alias("severity"))


@query("x25_endpoint_cases", "with c as (select unnest(['no_token', 'bad_token', 'injection', 'oversize']) as kind) select page_id, kind, case when kind in ('no_token', 'bad_token') then 401 else 400 end as expected from pages cross join c where not (kind = 'injection' and not contains(url, '?'))")
def x25(spark, d):
    p = t(spark, d, "pages").select("page_id", F.explode(F.array_compact(F.array(F.lit("no_token"), F.lit("bad_token"), F.when(F.contains("url", F.lit("?")), "injection"), F.lit("oversize")))).alias("kind"))
    return p.select("page_id", "kind", F.when(F.col("kind").isin("no_token", "bad_token"), 401).otherwise(400).alias("expected"))


@query("x26_link_plan", "select url, case when contains(lower(url), '/browse/') or contains(lower(url), '/fr') then 'jira' when contains(lower(url), 'sonar') then 'sonarqube' else 'web' end as target, case when contains(lower(url), '/browse/') or contains(lower(url), '/fr') then 'tool' when contains(lower(url), 'sonar') then 'connect_needed' else 'agent_fetch' end as status from (select distinct url from pages)")
def x26(spark, d):
    return link_plan(t(spark, d, "pages").select("url"), [("jira", ["/browse/", "/fr"]), ("sonarqube", ["sonar"])], ["jira"])


@query("x27_narrow_connections", "select s_suppkey from supplier where starts_with(s_name, 'Supplier#00000000') or not exists (select 1 from supplier where starts_with(s_name, 'Supplier#00000000'))")
def x27(spark, d):
    return filter_or_all(t(spark, d, "supplier"), F.col("s_name").startswith("Supplier#00000000")).select("s_suppkey")


@query("x29_summary_tiers", "select doc_id, case when n <= 400 then 'pass' when n <= 4000 then 'single' else 'map_reduce' end as mode, case when n <= 4000 then 1 else ceil(n / 2000.0)::bigint end as chunks from (select doc_id, length(coalesce(text, '')) as n from documents)")
def x29(spark, d):
    return t(spark, d, "documents").select("doc_id", *r.summary_tier(F.length(F.coalesce("text", F.lit(""))), 400, 4000, 2000))


@query("x30_cluster_prompts", "with c as (select p_type as cluster, p_brand as file, count(*) as n from part group by 1, 2), k as (select *, row_number() over (partition by cluster order by n desc, file) as i from c) select cluster, string_agg(file, ',' order by i) as files from k where i <= 5 group by 1")
def x30(spark, d):
    c = t(spark, d, "part").groupBy(F.col("p_type").alias("cluster"), F.col("p_brand").alias("file")).agg(F.count("*").alias("n"))
    top = first_per(c, ["cluster"], [F.desc("n"), "file"], "i", 5)
    return top.groupBy("cluster").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "file"))), lambda x: x["file"]), ",").alias("files"))


@query("a9_cluster_label", "with w as (select p_type as cluster, split_part(p_name, ' ', 2) as word, count(*) as n from part group by 1, 2) select cluster, arg_max(word, {'n': n, 'w': word}) as label from w where word not in ('ring') group by 1")
def a9(spark, d):
    return cluster_labels(t(spark, d, "part").select(F.col("p_type").alias("cluster"), F.col("p_name").alias("name")), ["ring"])


@query("w12_greedy_matching")
def w12(spark, d):
    from graphmill.plans.codegraph import g13

    return g13(spark, d).withColumnRenamed("community", "new").withColumnRenamed("final", "kept_as")


@query("x23_report_ledger", "select user_id, event_id, (json_extract(props, '$.k'))::int as k from events where (json_extract(props, '$.k'))::int >= 90 order by event_id desc limit 50")
def x23(spark, d):
    e = t(spark, d, "events").select("user_id", "event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))
    return e.where("k >= 90").orderBy(F.desc("event_id")).limit(50)


@query("x21_census_lint", "with f as (select l_orderkey as screen, l_linenumber as field, case when l_discount > 0.01 then 's' || l_suppkey end as selector, l_quantity as max_len from lineitem) select screen, field, 'no selector' as problem from f where selector is null union all select screen, field, 'duplicate selector' from (select *, count(*) over (partition by screen, selector) as n from f where selector is not null) where n > 1 union all select screen, field, 'length' from f where max_len < 2")
def x21(spark, d):
    f = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("screen"), F.col("l_linenumber").alias("field"), F.when(F.col("l_discount") > 0.01, F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))).alias("selector"), F.col("l_quantity").alias("max_len"))
    problem = lambda df, text: df.select("screen", "field", F.lit(text).alias("problem"))
    twice = f.where("selector is not null").withColumn("n", F.count("*").over(Window.partitionBy("screen", "selector"))).where("n > 1")
    return problem(f.where("selector is null"), "no selector").unionByName(problem(twice, "duplicate selector")).unionByName(problem(f.where("max_len < 2"), "length"))
