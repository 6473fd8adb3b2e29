"""Aggregations over events, findings and histories."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from graphmill.plans.registry import query, table as t

MONEY = "decimal(18,2)"


@query("a21_tool_daily", """select cast(ts as date) as day, event_type as tool, count(*) as calls, count(*) filter (where event_type = 'error') as errors, sum(value::decimal(18,2))::double as total_ms, sum(value::decimal(18,2))::double / count(*) as avg_ms from events group by 1, 2""")
def a21(spark, d):
    total = F.sum(F.col("value").cast(MONEY)).cast("double")
    return t(spark, d, "events").groupBy(F.to_date("ts").alias("day"), F.col("event_type").alias("tool")).agg(F.count("*").alias("calls"), F.count_if(F.col("event_type") == "error").alias("errors"), total.alias("total_ms"), (total / F.count("*")).alias("avg_ms"))


@query("a22_flakiness", """with c as (select user_id, event_type, count(*) as n from events group by 1, 2), s as (select user_id, max(n) as m, sum(n) as n, count(*) as k from c group by 1)
select user_id, case when n < 2 or k = 1 then 0.0::double else round(1 - m / n::double, 4) end as flakiness from s""")
def a22(spark, d):
    c = t(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    s = c.groupBy("user_id").agg(F.max("n").alias("m"), F.sum("n").alias("n"), F.count("*").alias("k"))
    return s.select("user_id", F.when((F.col("n") < 2) | (F.col("k") == 1), 0.0).otherwise(F.round(1 - F.col("m") / F.col("n"), 4)).alias("flakiness"))


@query("a23_suite_flakiness", "with c as (select user_id, count(distinct event_type) as k from events group by 1) select round(count(*) filter (where k > 1) / count(*)::double, 4) as suite_flakiness from c")
def a23(spark, d):
    c = t(spark, d, "events").groupBy("user_id").agg(F.countDistinct("event_type").alias("k"))
    return c.agg(F.round(F.count_if(F.col("k") > 1) / F.count("*"), 4).alias("suite_flakiness"))


@query("a24_pass_trend", "select cast(ts as date) as day, count(*) as total, round(count(*) filter (where event_type <> 'error') / count(*)::double, 4) as pass_rate from events group by 1")
def a24(spark, d):
    return t(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("total"), F.round(F.try_divide(F.count_if(F.col("event_type") != "error"), F.count("*")), 4).alias("pass_rate"))


@query("a25_slowest", "select user_id, sum(value::decimal(18,2))::double / count(*) as mean_ms from events group by 1 order by 2 desc, 1 limit 10")
def a25(spark, d):
    return t(spark, d, "events").groupBy("user_id").agg((F.sum(F.col("value").cast(MONEY)).cast("double") / F.count("*")).alias("mean_ms")).orderBy(F.desc("mean_ms"), "user_id").limit(10)


@query("a27_findings_summary", "select l_returnflag as type, l_linestatus as severity, count(*) as n from lineitem group by grouping sets ((), (l_returnflag), (l_linestatus))")
def a27(spark, d):
    t(spark, d, "lineitem").createOrReplaceTempView("_findings")
    return spark.sql("select l_returnflag as type, l_linestatus as severity, count(*) as n from _findings group by grouping sets ((), (l_returnflag), (l_linestatus))")


@query("a29_security_summary", "select l_suppkey, count(*) filter (where l_returnflag = 'R') as critical, count(*) filter (where l_returnflag = 'A') as high, count(*) filter (where l_returnflag = 'N') as low, count(*) filter (where l_returnflag in ('R', 'A')) > 0 as gate_failed from lineitem group by 1")
def a29(spark, d):
    f = F.col("l_returnflag")
    return t(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count_if(f == "R").alias("critical"), F.count_if(f == "A").alias("high"), F.count_if(f == "N").alias("low"), (F.count_if(f.isin("R", "A")) > 0).alias("gate_failed"))


@query("a30_coverage", "select p_brand, case when count(*) filter (where p_size > 25) = 0 then 1.0::double else round(count(*) filter (where p_size > 25 and p_retailprice > 1000) / (count(*) filter (where p_size > 25))::double, 3) end as coverage from part group by 1")
def a30(spark, d):
    high = F.count_if(F.col("p_size") > 25)
    return t(spark, d, "part").groupBy("p_brand").agg(F.when(high == 0, 1.0).otherwise(F.round(F.try_divide(F.count_if((F.col("p_size") > 25) & (F.col("p_retailprice") > 1000)), high), 3)).alias("coverage"))


@query("a32_benchmark_groups", """with x as (select d.lang, d.source, l.quality, l.toxic from documents d join labels l using (doc_id)) select lang, source, count(*) as n, round(avg(quality), 4) as raw, round(avg(1 - toxic), 4) as boosted, round(avg(1 - toxic) - avg(quality), 4) as gain from x group by grouping sets ((), (lang), (source))""")
def a32(spark, d):
    graded = t(spark, d, "documents").join(t(spark, d, "labels"), "doc_id")
    raw, boosted = F.avg("quality"), F.avg(1 - F.col("toxic"))
    sets = graded.groupingSets([[], [F.col("lang")], [F.col("source")]], F.col("lang"), F.col("source"))
    return sets.agg(F.count("*").alias("n"), F.round(raw, 4).alias("raw"), F.round(boosted, 4).alias("boosted"), F.round(boosted - raw, 4).alias("gain"))


@query("a33_rubric_grade", "select doc_id, round((3 * (contains(lower(text), 'the'))::int + 2 * (contains(lower(text), 'tion') or contains(lower(text), 'ung'))::int + (contains(lower(text), 'license'))::int) / 6.0::double, 4) as grade from documents")
def a33(spark, d):
    has = lambda *w: F.exists(F.array(*map(F.lit, w)), lambda x: F.contains(F.lower("text"), x)).cast("int")
    return t(spark, d, "documents").select("doc_id", F.round((3 * has("the") + 2 * has("tion", "ung") + has("license")) / 6.0, 4).alias("grade"))


@query("a37_perf_regression", """with a as (select l_suppkey, sum(l_quantity::decimal(18,2)) as q from lineitem where l_shipdate < timestamp '1998-01-01' group by 1), b as (select l_suppkey, sum(l_quantity::decimal(18,2)) as q from lineitem where l_shipdate >= timestamp '1998-01-01' group by 1)
select l_suppkey, case when a.q = 0 then case when b.q = 0 then 0.0::double else 100.0::double end else round((b.q::double - a.q::double) / a.q::double * 100, 2) end as pct, (b.q::double - a.q::double) / a.q::double * 100 <= 10 as passed from a join b using (l_suppkey)""")
def a37(spark, d):
    l = t(spark, d, "lineitem")  # noqa: E741
    old = F.col("l_shipdate") < F.expr("timestamp_ntz '1998-01-01'")
    q = F.col("l_quantity").cast(MONEY)
    s = l.groupBy("l_suppkey").agg(F.sum(F.when(old, q)).cast("double").alias("a"), F.sum(F.when(~old, q)).cast("double").alias("b")).where("a is not null and b is not null")
    pct = F.when(F.col("a") == 0, F.when(F.col("b") == 0, 0.0).otherwise(100.0)).otherwise((F.col("b") - F.col("a")) / F.col("a") * 100)
    return s.select("l_suppkey", F.round(pct, 2).alias("pct"), (pct <= 10).alias("passed"))


@query("a38_cost", "select lang, sum(greatest(1, length(text) // 4)) as tokens, round(sum(greatest(1, length(text) // 4)) * 0.000003, 6) as cost from documents group by 1")
def a38(spark, d):
    n = F.sum(F.greatest(F.lit(1), F.expr("length(text) div 4")))
    return t(spark, d, "documents").groupBy("lang").agg(n.alias("tokens"), F.round(n * 0.000003, 6).alias("cost"))


@query("a39_group_counts", "select p_type as module, count(*) as tools from part group by 1")
def a39(spark, d):
    return t(spark, d, "part").groupBy(F.col("p_type").alias("module")).agg(F.count("*").alias("tools"))


@query("a40_newest_tag", "select p_type as environment, max(p_size) as major, arg_max(p_brand, (p_size, p_partkey)) as tag from part group by 1")
def a40(spark, d):
    return t(spark, d, "part").groupBy(F.col("p_type").alias("environment")).agg(F.max("p_size").alias("major"), F.max_by("p_brand", F.struct("p_size", "p_partkey")).alias("tag"))


@query("a41_recent_pairs", "select user_id, event_type, max(ts) as last_use, count(*) as n from events where ts >= timestamp '2024-01-20' group by 1, 2 order by last_use desc, user_id, event_type limit 30")
def a41(spark, d):
    return t(spark, d, "events").where("ts >= timestamp_ntz '2024-01-20'").groupBy("user_id", "event_type").agg(F.max("ts").alias("last_use"), F.count("*").alias("n")).orderBy(F.desc("last_use"), "user_id", "event_type").limit(30)


@query("a13_item_density", "select l_partkey, count(distinct l_orderkey) as orders, array_to_string(list_sort(list(distinct l_returnflag)), ',') as flags from lineitem group by 1 order by 2 desc, 1 limit 40")
def a13(spark, d):
    return t(spark, d, "lineitem").groupBy("l_partkey").agg(F.countDistinct("l_orderkey").alias("orders"), F.array_join(F.array_sort(F.collect_set("l_returnflag")), ",").alias("flags")).orderBy(F.desc("orders"), "l_partkey").limit(40)


@query("a14_frequent_files", """with x as (select l_returnflag as grp, l_orderkey, p_type as file from lineitem join part on l_partkey = p_partkey), n as (select grp, count(distinct l_orderkey) as total from x group by 1), c as (select grp, file, count(distinct l_orderkey) as k from x group by 1, 2)
select grp, file, k, round(k / total::double, 4) as share from (select c.*, total, row_number() over (partition by grp order by k desc, file) as r from c join n using (grp) where k >= 0.3 * total) where r <= 5""")
def a14(spark, d):
    x = t(spark, d, "lineitem").join(t(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_returnflag").alias("grp"), "l_orderkey", F.col("p_type").alias("file")).distinct()
    n = x.select("grp", "l_orderkey").distinct().groupBy("grp").agg(F.count("*").alias("total"))
    c = x.groupBy("grp", "file").agg(F.count("*").alias("k"))
    w = Window.partitionBy("grp").orderBy(F.desc("k"), "file")
    return c.join(n, "grp").where("k >= 0.3 * total").withColumn("r", F.row_number().over(w)).where("r <= 5").select("grp", "file", "k", F.round(F.col("k") / F.col("total"), 4).alias("share"))


@query("a15_dominant_tags", "with n as (select count(*) as total from documents) select lang as tag, count(*) as n, round(count(*) / (select total from n)::double, 4) as share from documents group by 1 having count(*) >= 0.1 * (select total from n)")
def a15(spark, d):
    x = t(spark, d, "documents").groupBy(F.col("lang").alias("tag")).agg(F.count("*").alias("n"))
    total = F.broadcast(x.agg(F.sum("n").alias("_all")))
    return x.join(total).where("n >= 0.1 * _all").select("tag", "n", F.round(F.col("n") / F.col("_all"), 4).alias("share"))


@query("a16_top_type", "with c as (select p_brand, p_type, count(*) as n from part group by 1, 2), s as (select p_brand, max(n) as n, sum(n) as total, arg_max(p_type, (n, p_type)) as top from c group by 1) select p_brand, top, round(n / total::double, 4) as share from s where n > 0.25 * total")
def a16(spark, d):
    c = t(spark, d, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("n"))
    s = c.groupBy("p_brand").agg(F.max("n").alias("m"), F.sum("n").alias("total"), F.max_by("p_type", F.struct("n", "p_type")).alias("top"))
    return s.where("m > 0.25 * total").select("p_brand", "top", F.round(F.col("m") / F.col("total"), 4).alias("share"))


@query("a18_signal_words", """with w as (select distinct doc_id, source, unnest(string_split_regex(lower(text), '[^a-z]+')) as word from documents), n as (select source, count(distinct doc_id) as n from documents group by 1),
c as (select source, word, count(*) as df from w where length(word) > 3 and word not in ('with', 'from', 'that', 'this') group by 1, 2)
select source, word, df from (select c.*, row_number() over (partition by source order by df desc, word) as r from c join n using (source) where df >= greatest(2, 0.6 * n.n)) where r <= 5""")
def a18(spark, d):
    x = t(spark, d, "documents")
    words = F.array_distinct(F.split(F.lower("text"), "[^a-z]+"))
    c = x.select("source", F.explode(words).alias("word")).where("length(word) > 3 and word not in ('with', 'from', 'that', 'this')").groupBy("source", "word").agg(F.count("*").alias("df"))
    n = x.groupBy("source").agg(F.count("*").alias("n"))
    w = Window.partitionBy("source").orderBy(F.desc("df"), "word")
    return c.join(n, "source").where("df >= greatest(2, 0.6 * n)").withColumn("r", F.row_number().over(w)).where("r <= 5").select("source", "word", "df")


@query("a19_status", "select count(*) as entries, count(*) filter (where toxic = 1) as flagged, coalesce(round(avg(quality), 4), 0) as avg_quality from labels")
def a19(spark, d):
    return t(spark, d, "labels").agg(F.count("*").alias("entries"), F.count_if(F.col("toxic") == 1).alias("flagged"), F.coalesce(F.round(F.avg("quality"), 4), F.lit(0.0)).alias("avg_quality"))


@query("a4_blast_risk", "select p_brand, round(least(1.0, case when count(*) filter (where p_size > 40) > 0 then count(*) filter (where p_size > 40 and p_retailprice > 1200) / (count(*) filter (where p_size > 40))::double else count(*) filter (where p_retailprice > 1200) / count(*)::double end), 4) as risk from part group by 1")
def a4(spark, d):
    important, hit = F.count_if(F.col("p_size") > 40), F.col("p_retailprice") > 1200
    ratio = F.when(important > 0, F.try_divide(F.count_if((F.col("p_size") > 40) & hit), important)).otherwise(F.count_if(hit) / F.count("*"))
    return t(spark, d, "part").groupBy("p_brand").agg(F.round(F.least(F.lit(1.0), ratio), 4).alias("risk"))


@query("a6_file_degree", "with d as (select l_partkey, count(*) as n from lineitem group by 1) select p_brand as file, max(n) as degree from d join part on l_partkey = p_partkey group by 1")
def a6(spark, d):
    n = t(spark, d, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"))
    return n.join(t(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("p_brand").alias("file")).agg(F.max("n").alias("degree"))


@query("a2_max_confidence", "select l_partkey as id, max(round(1 - 9 * l_discount, 2)) as best from lineitem group by 1")
def a2(spark, d):
    return t(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.max(F.round(1 - 9 * F.col("l_discount"), 2)).alias("best"))


@query("st3_reinforce", "select user_id, count(distinct event_type || cast(cast(ts as date) as varchar)) as citations, case when count(distinct event_type || cast(cast(ts as date) as varchar)) >= 60 then 1.0::double when count(distinct event_type || cast(cast(ts as date) as varchar)) >= 50 then 0.75::double else 0.5::double end as confidence from events group by 1")
def st3(spark, d):
    e = t(spark, d, "events").select("user_id", "event_type", F.to_date("ts").alias("day")).distinct().groupBy("user_id").agg(F.count("*").alias("citations"))
    return e.select("user_id", "citations", F.when(F.col("citations") >= 60, 1.0).when(F.col("citations") >= 50, 0.75).otherwise(0.5).alias("confidence"))


@query("st4_verify_fold", "select user_id, count(*) filter (where event_type = 'signup') as n, least(1.0, 0.25 * count(*) filter (where event_type = 'signup'))::double as confidence from events group by 1")
def st4(spark, d):
    n = F.count_if(F.col("event_type") == "signup")
    return t(spark, d, "events").groupBy("user_id").agg(n.alias("n"), F.least(F.lit(1.0), 0.25 * n).alias("confidence"))


@query("st5_negate_fold", "with e as (select user_id, count(*) filter (where event_type = 'error') as neg, count(*) as n from events group by 1) select user_id, neg > 0 as negated, round(greatest(0.0, least(1.0, least(1.0, 0.15 * n) - case when neg > 0 then 0.4 else 0 end - 0.05 * least(neg, 5)))::double, 4) as boost from e")
def st5(spark, d):
    e = t(spark, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("neg"), F.count("*").alias("n"))
    b = F.least(F.lit(1.0), 0.15 * F.col("n")) - F.when(F.col("neg") > 0, 0.4).otherwise(0.0) - 0.05 * F.least(F.col("neg"), F.lit(5))
    return e.select("user_id", (F.col("neg") > 0).alias("negated"), F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), b)), 4).alias("boost"))


@query("st6_audit_trail", "select event_id, ts, event_type from events where user_id = 8 order by ts desc, event_id desc limit 20")
def st6(spark, d):
    return t(spark, d, "events").where("user_id = 8").select("event_id", "ts", "event_type").orderBy(F.desc("ts"), F.desc("event_id")).limit(20)


@query("st8_delete_cascade", "select l_orderkey, l_linenumber from lineitem where l_orderkey not in (select o_orderkey from orders where o_orderstatus = 'F')")
def st8(spark, d):
    return t(spark, d, "lineitem").join(t(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_anti").select("l_orderkey", "l_linenumber")


@query("st13_session_purge", "select user_id, max(ts) as newest from events group by 1 having max(ts) < timestamp '2024-01-30 12:00:00'")
def st13(spark, d):
    return t(spark, d, "events").groupBy("user_id").agg(F.max("ts").alias("newest")).where("newest < timestamp_ntz '2024-01-30 12:00:00'")
