"""Quality rules by hashed n-gram log-likelihood ratios, in DataFrame functions only.

Words and pairs of words are hashed into BUCKETS buckets. Two multinomials are counted: one
over every document of the corpus, one over trusted documents. A document's score is the
sum over its n-grams of the log ratio of the two, divided by their number (plus PRIOR, so
that a few words can't carry a score far). One threshold decides on every document: the cut
that judges the fewest labelled documents wrongly among those that pass the base rules. Where
labels give no cut (none with label 0, or none that scores below all trusted ones), it lies
FENCE interquartile ranges below the first quartile of the trusted scores.

The trusted side is every document with label 1, and the cut sees every labelled document.
Documents meet their labels by doc_id in a join, for which texts are dealt once. All
documents are scored once, and the few numbers of each are written, so the cut reads those and no text. Only BUCKETS numbers and counts of scores in steps of 1 / STEPS
reach the driver.

Nulls and odd cases: null or empty text has no words and fails the base rules; a null
doc_id is judged like any other; without trusted documents no score is below the
threshold; repeated rows are judged each by itself; an empty table gives no row; columns besides doc_id and
text are ignored. Labels that contradict each other for one doc_id count on both sides. A very
long text is one row like any other: its words and their hashes are arrays in memory.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphmill.operators.scratch import Scratch

BUCKETS, PRIOR, FENCE, STEPS = 10_000, 20, 2.0, 2000
GAP = "[\\x20\\x09-\\x0D]+"
LEAST_WORDS, MOST_REPEATED = 10, 20


def words(text: Column) -> Column:
    """The words `[^\\x20\\x09-\\x0D]+` of a text; null: none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP, -1), lambda w: w != "")


def with_words(docs: DataFrame) -> DataFrame:
    """doc_id, text, _w (words), _h (their hashes) and _f (buckets of words and of pairs of words)."""
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("_w", words(F.col("text")))
    d = d.withColumn("_h", F.transform("_w", lambda w: F.xxhash64(w)))
    bucket = lambda h: F.pmod(h, F.lit(BUCKETS)).cast("int")
    pairs = F.zip_with(F.slice("_h", 1, F.greatest(F.size("_h") - 1, F.lit(0))), F.slice("_h", 2, F.greatest(F.size("_h") - 1, F.lit(0))), lambda a, b: bucket(F.xxhash64(a, b)))
    return d.withColumn("_f", F.concat(F.transform("_h", bucket), pairs))


def trusted_ids(labels: DataFrame, quality: int = 1) -> DataFrame:
    """Every doc_id with this quality, once."""
    ids = labels.where(F.col("quality") == quality).where("doc_id is not null")
    return ids.select(F.col("doc_id").alias("_trusted")).distinct()


def log_ratios(docs: DataFrame, labels: DataFrame) -> list[float]:
    """log P(bucket | trusted) / P(bucket | corpus) with add-one smoothing, from one scan of the corpus."""
    # dealt by doc_id at every size; an outer explode, as the filter of an inner one would split each text before the join too
    d = docs.select("doc_id", "text").join(trusted_ids(labels).hint("shuffle_hash"), F.col("doc_id") == F.col("_trusted"), "left")
    d = with_words(d.select(F.struct("doc_id", F.col("_trusted").isNotNull().cast("int").alias("_t")).alias("doc_id"), "text"))
    counts = d.select(F.col("doc_id._t").alias("t"), F.explode_outer("_f").alias("b")).groupBy("b").agg(F.count("*").alias("n"), F.sum("t").alias("k")).where("b is not null").collect()
    n, k = [1] * BUCKETS, [1] * BUCKETS
    for r in counts:
        n[r["b"]] += r["n"]
        k[r["b"]] += r["k"]
    if sum(k) == BUCKETS:
        return [0.0] * BUCKETS
    return [round(math.log(k[i] / sum(k)) - math.log(n[i] / sum(n)), 6) for i in range(BUCKETS)]


def mean_ratio(ratios: list[float]) -> Column:
    """Length-normalised sum of the ratios of column _f; the table is one literal of BUCKETS numbers."""
    table = F.from_json(F.lit(json.dumps(ratios)), "array<double>")
    return F.aggregate("_f", F.lit(0.0), lambda s, b: s + F.get(table, b)) / (F.size("_f") + PRIOR)


def best_cut(counts: list[tuple[int, float, float]]) -> float | None:
    """The cut of least junk kept plus good lost, from (step, good, junk); halfway to the occupied step below, and None where nothing lies below."""
    below, (lost, kept) = None, (0.0, sum(x[2] for x in counts))
    best = kept, None
    for step, good, junk in sorted(counts):
        if below is not None and lost + kept < best[0]:
            best = lost + kept, (below + 1 + step) / 2 / STEPS
        below, lost, kept = step, lost + good, kept - junk
    return best[1]


def threshold(scored: DataFrame, labels: DataFrame, fence: float = FENCE) -> float:
    """The cut from scored(doc_id, llr, base_failed) and all labels."""
    ids = trusted_ids(labels).withColumn("_good", F.lit(True)).unionByName(trusted_ids(labels, 0).withColumn("_good", F.lit(False)))
    own = scored.select("doc_id", "llr", "base_failed").join(ids, F.col("doc_id") == F.col("_trusted"))
    per = own.where("not base_failed").groupBy(F.floor(F.col("llr") * STEPS).alias("step")).agg(F.count_if("_good").alias("good"), F.count_if(~F.col("_good")).alias("junk")).collect()
    cut = best_cut([(x["step"], x["good"], x["junk"]) for x in per])
    if cut is not None:
        return cut
    q = own.where("_good").agg(F.percentile("llr", F.array(F.lit(0.25), F.lit(0.75))).alias("q")).first()["q"]
    return q[0] - fence * (q[1] - q[0]) if q else -math.inf


def base_failed() -> Column:
    """Whether the base counts of a row rule it out."""
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def with_base(d: DataFrame) -> DataFrame:
    """doc_id, _f and the base counts.

    Windows of five words are compared by hashes. Equal hashes are neighbours once sorted;
    of the places found, each adds the words up to the next place, five at most.
    """
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    d = d.withColumn("_lines", lines)
    n = F.size("_h")
    grams = F.when(n >= 5, F.transform(F.sequence(F.lit(0), F.greatest(n - 5, F.lit(0))), lambda i: F.xxhash64(*(F.get("_h", i + j) for j in range(5))))).otherwise(F.array().cast("array<bigint>"))
    d = d.withColumn("_g", grams)
    d = d.withColumn("_again", F.size(F.array_distinct("_g")) < F.size("_g"))
    ordered = F.when(F.col("_again"), F.sort_array(F.transform("_g", lambda g, i: F.struct(g.alias("g"), i.alias("i")))))
    d = d.withColumn("_s", ordered)
    same = F.filter(F.transform("_s", lambda x, i: F.when((F.get("_s", i - 1)["g"] == x["g"]) | (F.get("_s", i + 1)["g"] == x["g"]), x["i"])), lambda i: i.isNotNull())
    d = d.withColumn("_p", F.sort_array(same))
    covered = F.aggregate(F.transform("_p", lambda p, i: F.least(F.coalesce(F.get("_p", i + 1) - p, F.lit(5)), F.lit(5))), F.lit(0), lambda s, x: s + x)
    return d.select(
        "doc_id",
        "_f",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("_again"), covered).otherwise(0).cast("long").alias("n_repeat_words"),
    )


def judge(docs: DataFrame, labels: DataFrame, fence: float = FENCE) -> DataFrame:
    """doc_id, the base counts, base_failed, llr, threshold and kept of every row."""
    ratios = log_ratios(docs, labels)
    d = with_base(with_words(docs)).withColumn("llr", mean_ratio(ratios)).drop("_f")
    scored = Scratch(docs.sparkSession, "quality").keep(d.withColumn("base_failed", base_failed()))
    bar = F.lit(float(threshold(scored, labels, fence)))
    return scored.withColumn("threshold", bar).withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= bar))
