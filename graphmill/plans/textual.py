"""Scalar functions and classifiers over pages, parts, documents and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphmill.functions import columns as c
from graphmill.plans.registry import query, table as t


@query("str1_label_norm", "select p_partkey, trim(regexp_replace(lower(p_name || '--' || p_brand), '[^a-z0-9]+', ' ', 'g')) as label from part")
def str1(spark, d):
    return t(spark, d, "part").select("p_partkey", c.label_norm(F.concat("p_name", F.lit("--"), "p_brand")).alias("label"))


@query("str2_id_norm", "select p_partkey, regexp_replace(regexp_replace(lower(p_brand || ' ' || p_name), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') as node_id from part")
def str2(spark, d):
    return t(spark, d, "part").select("p_partkey", c.id_norm(F.concat_ws(" ", "p_brand", "p_name")).alias("node_id"))


@query("str3_shingles", "select p_name, count(*) as n from (select distinct p_name, unnest(list_transform(range(1, greatest(length(p_name) - 1, 2)), lambda i: substr(p_name, i, 3))) as s from part) group by 1")
def str3(spark, d):
    return t(spark, d, "part").select("p_name").distinct().select("p_name", F.size(c.shingles(F.col("p_name"))).cast("long").alias("n"))


@query("str4_entropy", """with u as (select distinct p_name from part), ch as (select p_name, unnest(string_split(p_name, '')) as ch from u), k as (select p_name, ch, count(*) as n from ch group by 1, 2), s as (select p_name, sum(n) as t from k group by 1)
select p_name, round(-sum(n / t::double * log2(n / t::double)), 4) as entropy from k join s using (p_name) group by 1""")
def str4(spark, d):
    return t(spark, d, "part").select("p_name").distinct().select("p_name", F.round(c.entropy(F.col("p_name")), 4).alias("entropy"))


URL = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*', ''), '[?#].*$', ''), '/(\\d+|\\{[^}]*\\}|:[a-z_]+)', '/*', 'g'), '/+', '/', 'g'), '/$', '')"


@query("str8_url_path", f"select page_id, case when {URL} = '' then '/' else {URL} end as path from pages")
def str8(spark, d):
    return t(spark, d, "pages").select("page_id", c.url_path(F.col("url")).alias("path"))


@query("str9_host_class", "select page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) as host, case when regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) like 'm.%' then 'mobile' when url like '%.net%' then 'net' else 'web' end as kind from pages")
def str9(spark, d):
    host = F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1)
    return t(spark, d, "pages").select("page_id", host.alias("host"), F.when(host.like("m.%"), "mobile").when(F.col("url").like("%.net%"), "net").otherwise("web").alias("kind"))


@query("str13_version_compare", "select p_partkey, list_transform(regexp_extract_all(p_brand || '.' || p_size, '(\\d+)', 1), lambda x: x::int) < [15, 20] as is_older from part")
def str13(spark, d):
    from graphmill.operators.relational import version_tuple

    return t(spark, d, "part").select("p_partkey", (version_tuple(F.concat_ws(".", "p_brand", F.col("p_size").cast("string"))) < F.array(F.lit(15), F.lit(20))).alias("is_older"))


@query("str14_spec_class", "with x as (select n_nationkey, case n_nationkey % 4 when 0 then '==1.' || n_nationkey when 1 then '>=2.0' when 2 then '^3' else '*' end as spec from nation) select n_nationkey, spec, case when regexp_matches(spec, '^={2}[0-9.]+$') then 'exact' when regexp_matches(spec, '^(>=|<=|~|\\^|>|<)') then 'ranged' else 'unpinned' end as kind from x")
def str14(spark, d):
    k = F.col("n_nationkey")
    spec = F.when(k % 4 == 0, F.concat(F.lit("==1."), k.cast("string"))).when(k % 4 == 1, ">=2.0").when(k % 4 == 2, "^3").otherwise("*")
    x = t(spark, d, "nation").select("n_nationkey", spec.alias("spec"))
    return x.select("n_nationkey", "spec", F.when(F.col("spec").rlike("^={2}[0-9.]+$"), "exact").when(F.col("spec").rlike("^(>=|<=|~|\\^|>|<)"), "ranged").otherwise("unpinned").alias("kind"))


@query("str15_tag_parse", "select p_partkey, regexp_extract(p_brand, '^Brand#(\\d)(\\d*)$', 1)::int as major, regexp_extract(p_brand, '^Brand#(\\d)(\\d*)$', 2) as minor from part where regexp_matches(p_brand, '^Brand#(\\d)(\\d*)$')")
def str15(spark, d):
    p = "^Brand#(\\d)(\\d*)$"
    return t(spark, d, "part").where(F.col("p_brand").rlike(p)).select("p_partkey", F.regexp_extract("p_brand", p, 1).cast("int").alias("major"), F.regexp_extract("p_brand", p, 2).alias("minor"))


@query("str17_whole_term", "select p_partkey from part where regexp_matches(lower(p_name || '_' || p_type), '(^|[^a-z0-9])red([^a-z0-9]|$)')")
def str17(spark, d):
    return t(spark, d, "part").where(F.lower(F.concat_ws("_", "p_name", "p_type")).rlike("(?<![a-z0-9])red(?![a-z0-9])")).select("p_partkey")


@query("str19_ui_text")
def str19(spark, d):
    return t(spark, d, "pages").select("page_id", c.visible_text(F.col("html")).alias("ui_text"))


@query("str21_line_window", "select doc_id, array_to_string(string_split(text, chr(10))[2:4], chr(10)) as lines from documents")
def str21(spark, d):
    return t(spark, d, "documents").select("doc_id", F.array_join(F.slice(F.split("text", "\n", -1), 2, 3), "\n").alias("lines"))


@query("str22_token_estimate", "select doc_id, case when length(text) = 0 then 0 else greatest(1, length(text) // 4) end as tokens from documents")
def str22(spark, d):
    return t(spark, d, "documents").select("doc_id", c.token_estimate(F.col("text")).cast("long").alias("tokens"))


@query("str23_keywords", "select conv_id, turn, len(list_distinct(list_filter(list_transform(string_split_regex(lower(text), '[\\s]+'), lambda x: regexp_replace(x, '[.,;:!?]+$', '')), lambda x: length(x) >= 2))) as keywords from conversations")
def str23(spark, d):
    words = F.transform(F.split(F.lower("text"), "[\\s]+"), lambda x: F.regexp_replace(x, "[.,;:!?]+$", ""))
    return t(spark, d, "conversations").select("conv_id", "turn", F.size(F.array_distinct(F.filter(words, lambda x: F.length(x) >= 2))).cast("long").alias("keywords"))


@query("str25_path_parts", "select page_id, string_split(regexp_replace(url, '^[a-z]+://', ''), '/')[1] as top, len(string_split(regexp_replace(url, '^[a-z]+://', ''), '/')) as depth from pages")
def str25(spark, d):
    parts = F.split(F.regexp_replace("url", "^[a-z]+://", ""), "/", -1)
    return t(spark, d, "pages").select("page_id", F.element_at(parts, 1).alias("top"), F.size(parts).cast("long").alias("depth"))


@query("cls1_archetype", "select conv_id, turn, case when regexp_matches(lower(text), '(^|[^a-z])(fix|bug|error)') then 'bugfix' when regexp_matches(lower(text), '(^|[^a-z])(add|create|new)') then 'feature' when ends_with(trim(text), '?') then 'question' else 'other' end as archetype from conversations")
def cls1(spark, d):
    x = F.lower("text")
    return t(spark, d, "conversations").select("conv_id", "turn", F.when(x.rlike("(^|[^a-z])(fix|bug|error)"), "bugfix").when(x.rlike("(^|[^a-z])(add|create|new)"), "feature").when(F.trim("text").endswith("?"), "question").otherwise("other").alias("archetype"))


@query("cls2_trivial", "select conv_id, turn, length(text) <= 20 or regexp_matches(lower(trim(text)), '^(ok|okay|thanks|yes|no)[.!]*$') as trivial from conversations")
def cls2(spark, d):
    return t(spark, d, "conversations").select("conv_id", "turn", ((F.length("text") <= 20) | F.lower(F.trim("text")).rlike("^(ok|okay|thanks|yes|no)[.!]*$")).alias("trivial"))


@query("cls4_role_tag", "select page_id, case when url like '%/en/%' then 'controller' when url like '%/fr/%' then 'service' when url like '%?%' then 'query' else 'other' end as role from pages")
def cls4(spark, d):
    u = F.col("url")
    return t(spark, d, "pages").select("page_id", F.when(u.like("%/en/%"), "controller").when(u.like("%/fr/%"), "service").when(u.like("%?%"), "query").otherwise("other").alias("role"))


@query("cls8_line_rules", """with l as (select doc_id, unnest(string_split(text, chr(10))) as line from documents) select doc_id, rule, count(*) as n from (select doc_id, case when regexp_matches(line, 'password *=') then 'hardcoded' when regexp_matches(line, 'AKIA[A-Z0-9]{16}') then 'cloud-key' when contains(line, 'Licensed under') then 'license' end as rule from l) where rule is not null group by 1, 2""")
def cls8(spark, d):
    x = t(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n", -1)).alias("line"))
    rule = F.when(F.col("line").rlike("password *="), "hardcoded").when(F.col("line").rlike("AKIA[A-Z0-9]{16}"), "cloud-key").when(F.contains("line", F.lit("Licensed under")), "license")
    return x.select("doc_id", rule.alias("rule")).where("rule is not null").groupBy("doc_id", "rule").agg(F.count("*").alias("n"))


@query("mth4_edge_weight", "select l_orderkey, l_linenumber, round((1 + 2 * greatest(0.0, least(1.0, round(1 - 9 * l_discount, 2)))) * case when l_returnflag = 'R' then 1.5 else 1.0 end, 4) as weight from lineitem")
def mth4(spark, d):
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(c.edge_weight(F.round(1 - 9 * F.col("l_discount"), 2), F.col("l_returnflag") == "R"), 4).alias("weight"))


@query("mth6_effort", "with x as (select p_partkey, (p_size % 3) || 'd' || (p_size % 8) || 'h' || p_size || 'min' as effort from part) select p_partkey, effort, regexp_extract(effort, '(\\d+)d', 1)::int * 480 + regexp_extract(effort, '(\\d+)h', 1)::int * 60 + regexp_extract(effort, '(\\d+)min', 1)::int as minutes from x")
def mth6(spark, d):
    s = F.col("p_size")
    x = t(spark, d, "part").select("p_partkey", F.concat((s % 3).cast("string"), F.lit("d"), (s % 8).cast("string"), F.lit("h"), s.cast("string"), F.lit("min")).alias("effort"))
    return x.select("p_partkey", "effort", c.effort_minutes(F.col("effort")).alias("minutes"))


@query("mth7_rating", "select p_partkey, case p_size % 6 when 1 then 'A' when 2 then 'B' when 3 then 'C' when 4 then 'D' when 5 then 'E' end as rating from part")
def mth7(spark, d):
    return t(spark, d, "part").select("p_partkey", F.when(F.col("p_size") % 6 > 0, c.rating_letter(F.greatest(F.col("p_size") % 6, F.lit(1)))).alias("rating"))


@query("mth9_confidence_class", "select l_orderkey, l_linenumber, case when round(1 - 9 * l_discount, 2) >= 0.8 then 'EXTRACTED' when round(1 - 9 * l_discount, 2) >= 0.4 then 'INFERRED' else 'AMBIGUOUS' end as confidence from lineitem")
def mth9(spark, d):
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", c.confidence_class(F.round(1 - 9 * F.col("l_discount"), 2)).alias("confidence"))


@query("dt1_age_days", "select event_id, greatest(0, floor((epoch_us(timestamp '2024-02-01') - epoch_us(ts)) / 86400000000))::bigint as age from events")
def dt1(spark, d):
    return t(spark, d, "events").select("event_id", c.age_days(F.expr("timestamp '2024-02-01 00:00:00'"), F.col("ts").cast("timestamp")).cast("long").alias("age"))


@query("dt2_zone_shift", "select event_id, ts + interval 330 minute as local_ts from events")
def dt2(spark, d):
    return t(spark, d, "events").select("event_id", (F.col("ts") + F.expr("interval 330 minutes")).alias("local_ts"))


@query("mth3_decay", """with x as (select event_id, greatest(0, floor((epoch_us(timestamp '2024-02-01') - epoch_us(ts)) / 86400000000)) as days, user_id % 30 as uses, (value % 10) / 10 as drift from events)
select event_id, round(greatest(0.2, exp(-0.02 * (1 - least(0.8, 0.2 * floor(uses / 5))) * days) - case when drift > 0.4 then least(0.3, drift - 0.4) else 0.0 end), 4) as decay from x""")
def mth3(spark, d):
    x = t(spark, d, "events").select("event_id", c.age_days(F.expr("timestamp '2024-02-01 00:00:00'"), F.col("ts").cast("timestamp")).alias("days"), (F.col("user_id") % 30).alias("uses"), ((F.col("value") % 10) / 10).alias("drift"))
    return x.select("event_id", c.decay(F.col("days"), F.lit(0.02), F.col("uses"), F.col("drift")).alias("decay"))


@query("hsh_digests", "select doc_id, sha256(text) as sha, left(sha256(text), 12) as short, md5(text) as md5 from documents")
def hsh(spark, d):
    s = F.sha2("text", 256)
    return t(spark, d, "documents").select("doc_id", s.alias("sha"), F.left(s, F.lit(12)).alias("short"), F.md5("text").alias("md5"))


@query("map1_json", "select event_id, (props->>'k')::int as k from events")
def map1(spark, d):
    return t(spark, d, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("arr2_dedup_lines", "select doc_id, len(list_distinct(string_split(text, chr(10)))) as n from documents")
def arr2(spark, d):
    return t(spark, d, "documents").select("doc_id", F.size(F.array_distinct(F.split("text", "\n", -1))).cast("long").alias("n"))
