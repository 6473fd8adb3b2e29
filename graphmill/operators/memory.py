"""Memory of past work: boosts, confirmations, relations, guarded writes, freshness and the hybrid query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphmill.operators.scratch import shares


#: So many siblings give the whole share of a boost; more change nothing.
SIBLINGS = 6


def siblings(entries: DataFrame, most: int | None = None) -> DataFrame:
    """(id, siblings): how many other entries of the same pattern share a citation; with `most`, the smaller of that and `most`. entries: id, pattern, citations.

    Entries meet by (pattern, citation), and are counted once for each other entry. Where only
    counts up to `most` matter, a meeting of more than `most` entries gives each of them `most` at once, so only
    smaller ones make pairs: at most `most` rows for each citation, not the square of a meeting.
    """
    x = entries.select("id", "pattern", F.explode(F.array_distinct("citations")).alias("cited"))
    if most is None:
        small, full = x, None
    else:
        sized = x.distinct().join(x.distinct().groupBy("pattern", "cited").agg(F.count("*").alias("_n")), ["pattern", "cited"])
        small = sized.where(F.col("_n") <= most).select("id", "pattern", "cited")
        full = sized.where(F.col("_n") > most).select("id", F.lit(most).cast("long").alias("siblings"))
    other = small.select(F.col("id").alias("other"), "pattern", "cited")
    met = small.join(other, ["pattern", "cited"]).where("id <> other").select("id", "other").distinct().groupBy("id").agg(F.count("*").alias("siblings"))
    if full is None:
        return met
    return met.unionByName(full).groupBy("id").agg(F.least(F.max("siblings"), F.lit(most).cast("long")).alias("siblings"))


def boost(usage: Column, related: Column, negated: Column) -> Column:
    """0.15 for each use up to 1, 0.05 for each sibling up to 0.3, less 0.4 if negated; within 0..1."""
    raw = F.least(F.lit(1.0), 0.15 * usage) + F.least(F.lit(0.3), 0.05 * related) - F.when(negated, 0.4).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))


def confirmed(saves: DataFrame) -> DataFrame:
    """(key, n, confidence) from saves(key, confirmed, restored, count, at): a confirmed save adds one to what the last restored save brought; confidence is a quarter of it, at most 1."""
    last = F.max_by(F.col("count"), F.when(F.col("restored"), F.col("at")))
    start = saves.groupBy("key").agg(F.max(F.when(F.col("restored"), F.col("at"))).alias("_from"), F.coalesce(last, F.lit(0)).alias("_base"))
    j = saves.join(start, "key")
    n = F.max("_base") + F.count_if(F.col("confirmed") & ~F.col("restored") & (F.col("_from").isNull() | (F.col("at") > F.col("_from"))))
    return j.groupBy("key").agg(n.alias("n")).withColumn("confidence", F.least(F.lit(1.0), F.round(0.25 * F.col("n"), 4)))


def related(relations: DataFrame) -> DataFrame:
    """(source, target, relation, strength) both ways from relations(source, target, relation, strength, at): of each pair and relation the newest; nothing with itself."""
    r = relations.where("source <> target")
    both = r.unionByName(r.select(F.col("target").alias("source"), F.col("source").alias("target"), "relation", "strength", "at"))
    return both.groupBy("source", "target", "relation").agg(F.max_by("strength", "at").alias("strength"))


def replaced_partition(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old without the partitions that new has, and new."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def guarded_write(stored: DataFrame, drafts: DataFrame) -> DataFrame:
    """(name, outcome): created, updated, or skipped where the stored body no longer has its recorded hash. stored: name, body, digest; drafts: name."""
    j = drafts.select("name").distinct().join(stored.select("name", "body", "digest"), "name", "left")
    return j.select("name", F.when(F.col("digest").isNull() & F.col("body").isNull(), "created").when(F.coalesce(F.sha2("body", 256), F.lit("")) != F.coalesce("digest", F.lit("")), "skipped_user_edited").otherwise("updated").alias("outcome"))


def fresh(confirmed_files: DataFrame, recorded: DataFrame, current: DataFrame) -> DataFrame:
    """(entry, fresh, changed): an entry is fresh if each of its files was recorded and still has the recorded hash.

    confirmed_files: entry, path; recorded: entry, path, digest; current: path, digest.
    """
    parts = shares(confirmed_files)
    files = confirmed_files.repartition(parts, "entry", "path").distinct()
    was = recorded.select("entry", "path", F.col("digest").alias("_was")).repartition(parts, "entry", "path")
    j = files.join(was, ["entry", "path"], "left").join(current.select("path", F.col("digest").alias("_now")), "path", "left")
    bad = F.col("_was").isNull() | F.col("_now").isNull() | (F.col("_was") != F.col("_now"))
    return j.groupBy("entry").agg((F.count_if(bad) == 0).alias("fresh"), F.count_if(bad).alias("changed"))


def citation_hubs(entries: DataFrame, least_group: int = 3, share: float = 0.3) -> DataFrame:
    """(pattern, cited, n, group_size, rate): what at least max(2, share of the group) entries of a pattern cite, in groups of least_group or more."""
    size = entries.groupBy("pattern").agg(F.count("*").alias("group_size")).where(F.col("group_size") >= least_group)
    n = entries.select("pattern", F.explode("citations").alias("cited")).groupBy("pattern", "cited").agg(F.count("*").alias("n"))
    return n.join(size, "pattern").where(F.col("n") >= F.greatest(F.lit(2.0), share * F.col("group_size"))).select("pattern", "cited", "n", "group_size", F.round(F.col("n") / F.col("group_size"), 2).alias("rate"))


def adjusted(rrf: Column, decay: Column, confidence: Column, cross_boost: Column) -> Column:
    return F.round(rrf * decay * (1 + 0.5 * confidence) * (1 + cross_boost), 6)


def smart_query(near: DataFrame, text: DataFrame, rows: DataFrame, exact: str | None, top: int, least: float, tags: list[str] | None = None, k: int = 60) -> DataFrame:
    """(id, kind, similarity, adjusted, place): results and negative signals of a hybrid search.

    near: id, similarity, rank (from 0); text: id, rank; rows: id, tags, decay, confidence,
    boost, negated. Only near rows of at least `least` take part; of these only those with one
    of the tags, if there are any. Ranks of both searches are fused and adjusted; of the 2 x top
    best, negated ones are negative signals and the others results, top at most. The exact key,
    unless negated or there already, comes first with score 1. Everything from the fused rows on
    is at most 8 x top rows.
    """
    n = near.where(F.col("similarity") >= least)
    if tags:
        tagged = n.join(rows.select("id", "tags"), "id").where(F.arrays_overlap(F.transform("tags", F.lower), F.array(*(F.lit(t.lower()) for t in tags)))).select("id")
        some = F.broadcast(tagged.agg((F.count("*") > 0).alias("_some")))  # one row
        n = n.join(tagged.withColumn("_tag", F.lit(True)), "id", "left").join(some).where(~F.col("_some") | F.col("_tag")).drop("_tag", "_some")
    f = n.join(text.select("id", F.col("rank").alias("_t")), "id", "left")
    f = f.withColumn("_rrf", 1 / (k + F.col("rank") + 1) + F.coalesce(1 / (k + F.col("_t") + 1), F.lit(0.0))).join(rows, "id")
    f = f.select("id", "negated", "similarity", adjusted(F.col("_rrf"), F.col("decay"), F.col("confidence"), F.col("boost")).alias("adjusted"))
    best = f.orderBy(F.desc("adjusted"), "id").limit(2 * top)
    if exact is not None:
        own = rows.where((F.col("id").cast("string") == exact) & ~F.col("negated")).join(best.where("not negated").select("id"), "id", "left_anti")
        best = best.unionByName(own.select("id", "negated", F.lit(1.0).alias("similarity"), F.lit(float("inf")).alias("adjusted")))
    kind = F.when(F.col("negated"), "negative").otherwise("result")
    placed = best.withColumn("kind", kind).withColumn("place", F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("adjusted"), "id")))
    placed = placed.where((F.col("kind") == "negative") | (F.col("place") <= top))
    return placed.select("id", "kind", "similarity", F.when(F.col("adjusted") == float("inf"), 1.0).otherwise(F.col("adjusted")).alias("adjusted"), "place")


def after_events(entries: DataFrame, events: DataFrame) -> DataFrame:
    """key, usage, confirmations, confidence, negated, verified, boost of each entry after its events.

    entries: key, pattern, confidence. events: key, actor, kind (reinforced, verified or negated), at, id; an
    event of an unknown key counts for none. usage is the number of different actors that reinforced the
    entry: 5 raise its confidence to 0.75, 10 to 1; so does each confirmation by a quarter. Confidence
    never falls. The last verification or negation decides whether the entry counts as verified. boost is
    that of usage, siblings (others of the pattern with an actor in common) and negation; an entry that
    had reinforced another one before that was negated loses 0.05 for each such negation after the last
    event that set its own boost (a reinforcement or a negation), at least 0 is left.
    """
    e = events.join(entries.select("key").distinct(), "key", "left_semi")
    when = F.struct("at", "id")
    uses = e.where("kind = 'reinforced' and actor is not null").groupBy("key", "actor").agg(F.min(when).alias("first"))
    usage = uses.groupBy("key").agg(F.count("*").alias("usage"))
    last = lambda *kinds: F.max(F.when(F.col("kind").isin(*kinds), when))
    own = e.groupBy("key").agg(F.count_if(F.col("kind") == "verified").alias("confirmations"), F.count_if(F.col("kind") == "negated").alias("_no"), last("verified").alias("_v"), last("negated").alias("_n"), last("reinforced", "negated").alias("_set"))
    cited = uses.join(entries.select("key", "pattern"), "key").groupBy(F.col("key").alias("id"), "pattern").agg(F.collect_list("actor").alias("citations"))
    near = siblings(cited, SIBLINGS).select(F.col("id").alias("key"), "siblings")
    # one row for each negation and each entry that had used the negated one before
    hits = e.where("kind = 'negated'").select("key", when.alias("then")).join(uses, "key").where(F.col("first") < F.col("then")).select(F.col("actor").alias("key"), "then")
    hits = hits.join(own.select("key", "_set"), "key", "left").where(F.col("_set").isNull() | (F.col("then") > F.col("_set"))).groupBy("key").agg(F.count("*").alias("_hits"))
    j = entries.select("key", "confidence").join(own, "key", "left").join(usage, "key", "left").join(near, "key", "left").join(hits, "key", "left")
    n = lambda c: F.coalesce(c, F.lit(0))
    negated = n("_no") > 0
    raised = F.greatest("confidence", F.when(n("usage") >= 10, 1.0).when(n("usage") >= 5, 0.75).otherwise(0.0), F.least(F.lit(1.0), 0.25 * n("confirmations")))
    left = F.greatest(F.lit(0.0), boost(n("usage"), n("siblings"), negated) - 0.05 * n("_hits"))
    verified = F.col("_v").isNotNull() & (F.col("_n").isNull() | (F.col("_v") > F.col("_n")))
    return j.select("key", n("usage").alias("usage"), n("confirmations").alias("confirmations"), raised.alias("confidence"), negated.alias("negated"), verified.alias("verified"), F.round(left, 4).alias("boost"))
