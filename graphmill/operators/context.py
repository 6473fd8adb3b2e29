"""Ranked context: candidates of several signals, tiers, misses, and relevance of nodes to a task."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weights of agreement, centrality, recency and a prior fix.
WEIGHTS = (3.0, 2.0, 1.0, 4.0)
PHRASE_BONUS, PHRASE_CHARS = 3.0, 12


def candidates(signals: DataFrame) -> DataFrame:
    """(path, signals, reasons) from rows (path, signal, reason): one row a path, separators made equal, each signal and reason once."""
    s = signals.withColumn("path", F.translate("path", "\\", "/")).where("path <> ''")
    return s.groupBy("path").agg(F.array_sort(F.collect_set("signal")).alias("signals"), F.array_sort(F.collect_set(F.when(F.col("reason") != "", F.col("reason")))).alias("reasons"))


def tier(signals: Column, prior_fix: Column) -> Column:
    """seed; high by two signals or a graph tie; medium by a semantic hit or a prior fix; else low."""
    other = F.size(F.array_remove(signals, "seed"))
    return (
        F.when(F.array_contains(signals, "seed"), "seed")
        .when((other >= 2) | F.array_contains(signals, "graph"), "high")
        .when(F.array_contains(signals, "semantic") | prior_fix, "medium")
        .otherwise("low")
    )


def fuse_rank(found: DataFrame, centrality: DataFrame, recency: DataFrame, prior_fix: DataFrame, weights: tuple[float, float, float, float] = WEIGHTS) -> DataFrame:
    """(path, score, tier, signals, reasons, rank): seeds first, then tiers, then by score, then by path.

    centrality and recency: path, value in 0..1; prior_fix: path. Three equi-joins on path;
    rank comes from the caller's order (see ordered()).
    """
    j = found.join(centrality.select("path", F.col("value").alias("_c")), "path", "left").join(recency.select("path", F.col("value").alias("_r")), "path", "left")
    j = j.join(prior_fix.select("path").distinct().withColumn("_p", F.lit(True)), "path", "left")
    fixed = F.coalesce("_p", F.lit(False)) | F.array_contains("signals", "memory")
    a, c, r, p = weights
    score = a * F.size(F.array_remove("signals", "seed")) + c * F.coalesce("_c", F.lit(0.0)) + r * F.coalesce("_r", F.lit(0.0)) + p * fixed.cast("double")
    return j.select("path", score.alias("score"), tier(F.col("signals"), fixed).alias("tier"), "signals", "reasons")


def tier_order(t: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(x for i, k in enumerate(("seed", "high", "medium", "low")) for x in (F.lit(k), F.lit(i)))), t), F.lit(9))


def missed(scored: DataFrame, chosen: DataFrame, justified: DataFrame) -> DataFrame:
    """(path, tier, blocking) of scored files that are neither seeds nor chosen nor justified; high ones block."""
    done = chosen.select("path").unionByName(justified.select("path")).distinct()
    return scored.where("tier <> 'seed'").join(done, "path", "left_anti").select("path", "tier", (F.col("tier") == "high").alias("blocking"))


def miss_report(scored: DataFrame, chosen: DataFrame, justified: DataFrame) -> DataFrame:
    """One row: ok, coverage (share of high-tier files that are chosen or justified, 1 if there are none), missed, blocking."""
    done = chosen.select("path").unionByName(justified.select("path")).distinct().withColumn("_done", F.lit(True))
    j = scored.join(done, "path", "left").select("tier", F.coalesce("_done", F.lit(False)).alias("done"))
    high, open_ = F.count_if(F.col("tier") == "high"), F.count_if((F.col("tier") == "high") & ~F.col("done"))
    return j.agg(
        (open_ == 0).alias("ok"),
        F.when(high == 0, 1.0).otherwise(F.round((high - open_) / high, 3)).alias("coverage"),
        F.count_if((F.col("tier") != "seed") & ~F.col("done")).alias("missed"),
        open_.alias("blocking"),
    )


def term_pattern(term: str) -> str:
    """The term as a whole word of letters and digits; an underscore is a boundary."""
    return "(?<![a-z0-9])" + re.sub(r"([^a-z0-9_ ])", r"\\\1", term) + "(?![a-z0-9])"


def phrase_bonus(ui_text: Column, task: str) -> Column:
    """PHRASE_BONUS if one of the phrases, of several words and PHRASE_CHARS characters at least, stands in the task; else 1."""
    phrases = F.split(F.lower(F.coalesce(ui_text, F.lit(""))), " \\| ")
    hit = F.exists(phrases, lambda p: p.contains(" ") & (F.length(p) >= PHRASE_CHARS) & F.lit(task.lower()).contains(p))
    return F.when(hit, PHRASE_BONUS).otherwise(1.0)


def relevance(nodes: DataFrame, degree: DataFrame, best: DataFrame, task: str) -> DataFrame:
    """nodes with degree and score: share of the task's words that the node's texts hold x phrase bonus x ln(1 + degree) x (0.5 + 0.5 best confidence) x (1 + 0.2 importance).

    Without edges the score is a tenth of the word share times importance. nodes: id, label,
    source_file, role_tag, ui_text, importance; degree: id, degree; best: id, best.
    """
    terms = task.lower().split()
    text = F.lower(F.concat_ws(" ", *(F.coalesce(c, F.lit("")) for c in ("label", "source_file", "role_tag", "ui_text"))))
    hits = F.lit(0)
    for t in terms:
        hits = hits + text.rlike(term_pattern(t)).cast("int")
    word = hits / F.lit(float(max(len(terms), 1))) * phrase_bonus(F.col("ui_text"), task)
    j = nodes.join(degree.select("id", F.col("degree").alias("degree")), "id", "left").join(best.select("id", "best"), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    importance = F.coalesce("importance", F.lit(0.0))
    base = word * F.log(1 + F.col("degree")) * (0.5 + 0.5 * F.coalesce("best", F.lit(0.0)))
    return j.withColumn("score", F.when(base > 0, base * (1 + 0.2 * importance)).otherwise(word * 0.1 * importance))


def find_context(scored: DataFrame) -> DataFrame:
    """(file, node_id, score, degree): of each file the node of the best score, the first of equals; files by score."""
    x = scored.where("score > 0 and source_file is not null and source_file <> ''")
    best = x.groupBy(F.col("source_file").alias("file")).agg(F.max(F.struct("score", (-F.col("id")).alias("i"), "degree")).alias("b"))
    return best.select("file", (-F.col("b.i")).alias("node_id"), F.round("b.score", 4).alias("score"), F.col("b.degree").alias("degree"))


def budget_slice(levels: DataFrame, cost: str, tokens: int) -> DataFrame:
    """Rows of levels(id, depth, cost...) in order of depth and id until 4 x tokens characters are used; the first row stays at least.

    A running sum over the whole slice needs one order; costs are first summed by level and only
    the level that crosses the budget is ordered row by row.
    """
    most = 4 * tokens
    per = levels.groupBy("depth").agg(F.sum(cost).alias("_level"))
    before = per.select("depth", F.coalesce(F.sum("_level").over(Window.orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    x = levels.join(before, "depth").where(F.col("_before") <= most)
    own = Window.partitionBy("depth").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("_sum", F.col("_before") + F.sum(cost).over(own))
    first = Window.partitionBy("depth").orderBy("id")
    x = x.withColumn("_n", F.row_number().over(first))
    return x.where((F.col("_sum") <= most) | ((F.col("_before") == 0) & (F.col("_n") == 1))).drop("_before", "_sum", "_n")
