"""Graph building, repair, centrality, ownership and surprise over nodes(id, label, file, community) and edges(source, target, ...)."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphmill.operators import graph as g
from graphmill.operators.blocks import path_shares
from graphmill.operators.relational import last_match
from graphmill.operators.community import numbered
from graphmill.operators.scratch import Scratch

BETWEENNESS_SOURCES, SEED = 50, 42
#: Shares of rank, degree and betweenness in a node's importance.
IMPORTANCE = (0.50, 0.30, 0.20)


def sampled_sources(nodes: DataFrame, most: int = BETWEENNESS_SOURCES, seed: int = SEED) -> DataFrame:
    """(id) of at most `most` nodes: all of them, or places in the order of ids drawn by Python's generator.

    Places are found from exact counts of each partition, so only `most` numbers and one count
    for each partition pass through the driver.
    """
    spark = nodes.sparkSession
    ids = Scratch(spark, "sources").keep(nodes.select("id").distinct().repartitionByRange(F.col("id")).sortWithinPartitions("id").withColumn("n", F.monotonically_increasing_id()))
    counts = sorted((r["p"], r["c"]) for r in ids.groupBy(F.shiftright("n", 33).alias("p")).agg(F.count("*").alias("c")).collect())
    total = sum(c for _, c in counts)
    if total <= most:
        return ids.select("id")
    wanted, starts, at = sorted(random.Random(seed).sample(range(total), most)), [], 0
    for p, c in counts:
        starts += [(p << 33) + w - at for w in wanted if at <= w < at + c]
        at += c
    return ids.where(F.col("n").isin(starts)).select("id")


def betweenness(nodes: DataFrame, edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(id, betweenness): shares of shortest paths from the sources on directed edges, divided by the largest; not scaled to all sources.

    All sources advance together, one level a round, then shares flow back level by level. The graph lies in
    blocks of nodes (blocks.py): a round sends a node's values once to each block that it has an edge with, so
    neither an edge nor a (source, edge) pair is a row.
    """
    scratch = Scratch(nodes.sparkSession, "betweenness")
    e = edges.where("source <> target").select("source", "target")
    sources = sources.select("id").where("id is not null").distinct()
    names = None
    if nodes.schema["id"].dataType.typeName() not in ("byte", "short", "integer", "long"):
        ids = e.select(F.col("source").alias("id")).unionByName(e.select(F.col("target").alias("id"))).unionByName(sources).distinct()
        names = scratch.keep(numbered(ids, ["id"], "number", scratch))
        at = lambda end: names.select(F.col("id").alias(end), F.col("number").alias(f"_{end}"))
        e = e.join(at("source"), "source").join(at("target"), "target").select(F.col("_source").alias("source"), F.col("_target").alias("target"))
        sources = sources.join(names, "id").select(F.col("number").alias("id"))
    total = path_shares(scratch.keep(e.distinct()), numbered(sources, ["id"], "s", scratch), scratch)
    if names is not None and total is not None:
        total = total.join(names.withColumnRenamed("id", "name"), F.col("id") == F.col("number")).select(F.col("name").alias("id"), "b")
    every = nodes.select("id").distinct()
    if total is None:
        return every.withColumn("betweenness", F.lit(0.0))
    sums = scratch.keep(total)
    scratch.keep_only(sums)
    top = sums.agg(F.max("b")).first()[0] or 1.0
    return every.join(sums, "id", "left").select("id", (F.coalesce("b", F.lit(0.0)) / F.lit(top)).alias("betweenness"))


def importance(rank: DataFrame, degree: DataFrame, between: DataFrame, shares: tuple[float, float, float] = IMPORTANCE) -> DataFrame:
    """(id, importance) from (id, pagerank), (id, degree_centrality) and (id, betweenness), each in 0..1."""
    j = rank.join(degree, "id", "left").join(between, "id", "left")
    p, d, b = (F.coalesce(c, F.lit(0.0)) for c in ("pagerank", "degree_centrality", "betweenness"))
    return j.select("id", F.round(shares[0] * p + shares[1] * d + shares[2] * b, 6).alias("importance"))


def repaired_edges(nodes: DataFrame, edges: DataFrame, norm) -> DataFrame:
    """Edges whose ends are ids of nodes, or become one by their normalised form (of several ids with one form the largest); others go."""
    ids = nodes.select("id").distinct()
    by_norm = ids.groupBy(norm(F.col("id")).alias("_norm")).agg(F.max("id").alias("_id"))
    out = edges
    for end in ("source", "target"):
        exact = ids.select(F.col("id").alias(end), F.lit(True).alias("_there"))
        out = out.join(exact, end, "left").withColumn("_norm", norm(F.col(end))).join(by_norm, "_norm", "left")
        out = out.withColumn(end, F.when(F.col("_there"), F.col(end)).otherwise(F.col("_id"))).where(F.col(end).isNotNull()).drop("_there", "_norm", "_id")
    return out


def last_per_key(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of each key the row that comes last in order: later attributes overwrite earlier ones. One pre-aggregated maximum, no window."""
    rest = [c for c in rows.columns if c not in (*keys, order)]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_x")).select(*keys, *(F.col(f"_x.{c}").alias(c) for c in rest))


def rewired_stubs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose ends at nodes without a file go to the one node with a file and the same label, where it is the only one."""
    real = nodes.where("file is not null").groupBy("label").agg(F.count("*").alias("n"), F.min("id").alias("real")).where("n = 1")
    remap = nodes.where("file is null").join(real, "label").select("id", "real")
    return remapped(edges, remap.select(F.col("id").alias("old"), F.col("real").alias("new")), loops=True)


def remapped(edges: DataFrame, remap: DataFrame, loops: bool = False) -> DataFrame:
    """Edges with their ends replaced by remap(old, new); without loops, edges that come to lie on one node go."""
    out = edges
    for end in ("source", "target"):
        out = out.join(remap.select(F.col("old").alias(end), F.col("new").alias("_new")), end, "left").withColumn(end, F.coalesce("_new", end)).drop("_new")
    return out if loops else out.where("source <> target")


def merged_incremental(old_nodes: DataFrame, old_edges: DataFrame, new_nodes: DataFrame, new_edges: DataFrame, stale: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges after the files in stale(file) were read anew: their old rows go, new rows come, edges of nodes that are gone go."""
    kept = old_nodes.join(stale, "file", "left_anti")
    nodes = kept.unionByName(new_nodes)
    gone = old_nodes.select("id").distinct().join(nodes.select("id"), "id", "left_anti")
    edges = old_edges
    for c in ("source_file", "target_file"):
        edges = edges.join(stale.select(F.col("file").alias(c)), c, "left_anti")
    edges = edges.unionByName(new_edges)
    for end in ("source", "target"):
        edges = edges.join(gone.select(F.col("id").alias(end)), end, "left_anti")
    return nodes, edges


def winners(nodes: DataFrame, group: str, order: str, suffix: str = r"_c\d+$") -> DataFrame:
    """(old, new): the nodes of a group go to its winner: an id without a chunk suffix, then the shortest, then the first in order."""
    score = F.struct(F.col("id").rlike(suffix).cast("int").alias("a"), F.length("id").alias("b"), F.col(order).alias("c"))
    best = nodes.groupBy(group).agg(F.min_by("id", score).alias("new"))
    return nodes.select(F.col("id").alias("old"), group).join(best, group).where("old <> new").select("old", "new")


def one_repository(nodes: DataFrame) -> None:
    """Raises if nodes(repo) come from several repositories: names meet there by chance only."""
    if nodes.where("repo is not null and repo <> ''").select("repo").distinct().limit(2).count() > 1:
        raise ValueError("nodes of several repositories can't be merged")


#: Fixed value: a stem that ends in a letter, then a suffix of digits and letters or of two letters and more, the stem as long as it can be.
VARIANT = "^(.*[a-z])([0-9]+[a-z]*|[a-z]{2,})$"
#: Fixed value: labels shorter than this are told apart with care.
SHORT = 12


def variant_pair(a: Column, b: Column) -> Column:
    """Short labels of one stem and different suffixes, such as model numbers: never the same thing."""
    stem = lambda x: F.regexp_extract(x, VARIANT, 1)
    tail = lambda x: F.regexp_extract(x, VARIANT, 2)
    return (a != b) & (F.greatest(F.length(a), F.length(b)) < SHORT) & a.rlike(VARIANT) & b.rlike(VARIANT) & (stem(a) == stem(b)) & (tail(a) != tail(b))


def short_label_blocked(a: Column, b: Column, score: Column) -> Column:
    """Short labels (under 12) merge only if they score 97 and differ in one character of equal length, or by two neighbours that changed places.

    At equal length that is an edit distance of at most one, where swapped neighbours count as one.
    """
    chars = lambda x: F.filter(F.split(x, ""), lambda c: c != "")
    apart = F.filter(F.transform(F.arrays_zip(chars(a).alias("p"), chars(b).alias("q")), lambda z, i: F.struct(z["p"].alias("p"), z["q"].alias("q"), i.alias("i"))), lambda z: z["p"] != z["q"])
    one, two = F.get(apart, 0), F.get(apart, 1)
    swapped = (F.size(apart) == 2) & (two["i"] == one["i"] + 1) & (one["p"] == two["q"]) & (one["q"] == two["p"])
    fine = (score >= 97) & (F.length(a) == F.length(b)) & ((F.size(apart) <= 1) | swapped)
    return (F.greatest(F.length(a), F.length(b)) < 12) & ~fine


def subsystem(nodes: DataFrame, edges: DataFrame, file: str, top: int = 10) -> DataFrame:
    """(kind, file) of the community of the file's first node that has one: all its files, its top files by degree, and files that edges reach across.

    Nodes with an own file first; kind is file, top or cross.
    """
    first = nodes.where((F.col("file") == file) & F.col("community").isNotNull()).agg(F.min_by("community", "id").alias("community")).where("community is not null")
    inside = nodes.join(F.broadcast(first), "community")  # one row
    degrees = inside.join(g.degree(edges), F.col("id") == F.col("node"), "left").groupBy("file").agg(F.max(F.coalesce("degree", F.lit(0))).alias("degree"))
    files = degrees.select(F.lit("file").alias("kind"), "file")
    tops = degrees.orderBy(F.desc("degree"), "file").limit(top).select(F.lit("top").alias("kind"), "file")
    hop = g.both_ways(edges).join(inside.select(F.col("id").alias("node")), "node")
    other = nodes.where("community is not null").join(F.broadcast(first.withColumnRenamed("community", "_own")), F.col("community") != F.col("_own"))
    cross = hop.join(other.select(F.col("id").alias("other"), "file"), "other").where("file is not null").select(F.lit("cross").alias("kind"), "file").distinct()
    return files.unionByName(tops).unionByName(cross)


def owned(files: DataFrame, rules: list[tuple[str, list[str]]]) -> DataFrame:
    """files(file) with owners, an array: those of the last rule that matches."""
    joined = [(pattern, ",".join(owners)) for pattern, owners in rules]
    return files.withColumn("owners", F.filter(F.split(last_match(F.col("file"), joined, ""), ","), lambda x: x != ""))


def ownership(nodes: DataFrame, edges: DataFrame, file: str, rules: list[tuple[str, list[str]]]) -> tuple[DataFrame, DataFrame]:
    """Files that share an owner with the file, and edges (source_file, target_file, to_owners) from them to files of other owners."""
    all_files = owned(nodes.where("file is not null").select("file").distinct(), rules)
    mine = owned(nodes.sparkSession.createDataFrame([(file,)], "file string"), rules).select(F.col("owners").alias("_mine"))
    shared = all_files.join(F.broadcast(mine)).withColumn("same", F.arrays_overlap("owners", "_mine"))  # one row
    same = shared.where("same").select("file")
    at = lambda end: nodes.select(F.col("id").alias(end), F.col("file").alias(f"{end}_file"))
    e = edges.join(at("source"), "source").join(at("target"), "target")
    e = e.join(same.withColumnRenamed("file", "source_file"), "source_file", "left_semi")
    foreign = shared.where((~F.col("same")) & (F.size(F.array_except("owners", "_mine")) > 0)).select(F.col("file").alias("target_file"), F.array_join("owners", ",").alias("to_owners"))
    return same, e.join(foreign, "target_file").select("source_file", "target_file", "to_owners")


def hubs(degrees: DataFrame, percentile: float) -> DataFrame:
    """Nodes whose degree is above that at place int(n * percentile / 100) - 1 of the sorted degrees.

    Found from the histogram of degrees, whose rows are the different degrees, not the nodes.
    """
    h = degrees.groupBy("degree").agg(F.count("*").alias("n"))
    w = Window.orderBy("degree").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("n").over(Window.partitionBy())
    place = F.greatest(F.lit(0), F.floor(total * percentile / 100).cast("long") - 1)
    cut = h.select("degree", F.sum("n").over(w).alias("upto"), place.alias("place")).where(F.col("upto") > F.col("place")).agg(F.min("degree").alias("_cut"))
    return degrees.join(F.broadcast(cut)).where(F.col("degree") > F.col("_cut")).drop("_cut")


def reattached(hub: DataFrame, edges: DataFrame, communities: DataFrame) -> DataFrame:
    """(id, community) of hubs: the community that most of their neighbours are in, the smallest of equals."""
    votes = g.both_ways(edges).distinct().join(hub.select("node"), "node").join(communities.select(F.col("id").alias("other"), "community"), "other").groupBy("node", "community").agg(F.count("*").alias("n"))
    return votes.groupBy(F.col("node").alias("id")).agg(F.min_by("community", F.struct(-F.col("n"), F.col("community"))).alias("community"))


def stable_communities(new: DataFrame, old: DataFrame) -> DataFrame:
    """(community, final): each new community gets the old number that it shares most members with, one to one and largest overlap first; others get fresh numbers, largest first.

    Overlaps are counted by a join; the greedy matching takes local best pairs, all at once,
    in rounds: a pair that is first for both of its sides is what one-by-one matching would take.
    """
    scratch = Scratch(new.sparkSession, "communities")
    o = new.join(old.withColumnRenamed("community", "old"), "id").groupBy("old", "community").agg(F.count("*").alias("n"))
    rest = scratch.keep(o.withColumn("x", F.struct((-F.col("n")).alias("n"), "old", "community")))
    done = None
    while not rest.isEmpty():
        a = rest.groupBy("old").agg(F.min("x").alias("x"))
        b = rest.groupBy("community").agg(F.min("x").alias("x"))
        hit = scratch.keep(a.join(b, "x").select("community", F.col("x.old").alias("final")))
        done = hit if done is None else done.unionByName(hit)
        rest = scratch.keep(rest.join(hit.select("community"), "community", "left_anti").join(hit.select(F.col("final").alias("old")), "old", "left_anti"))
    sizes = new.groupBy("community").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    if done is None:
        done = sizes.select("community", F.lit(0).cast("long").alias("final")).limit(0)
    fresh = sizes.join(done, "community", "left_anti")
    # the k-th fresh community gets the k-th number that no matched one has; both lists are as long as there are communities
    k = numbered(fresh, [F.desc("n"), "least"], "k", scratch).select("community", "k")
    count = sizes.agg(F.count("*").alias("c"))
    free = count.select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("c"))).alias("final")).join(done.select("final"), "final", "left_anti")
    free = numbered(free, ["final"], "k", scratch)
    return done.unionByName(k.join(free, "k").select("community", "final"))


def surprise(confidence: Column, relation: Column, kind_u: Column, kind_v: Column, language_differs: Column, top_u: Column, top_v: Column, community_u: Column, community_v: Column, degree_u: Column, degree_v: Column) -> Column:
    """How surprising an edge across files is: uncertain, across kinds of files, folders or communities, semantic, from the edge to a hub."""
    pollution = (confidence == "INFERRED") & relation.isin("calls", "uses") & (language_differs | (F.array_sort(F.array(kind_u, kind_v)) == F.array(F.lit("code"), F.lit("doc"))))
    base = F.when(confidence == "AMBIGUOUS", 3).when(confidence == "INFERRED", 2).otherwise(1)
    more = F.when(kind_u != kind_v, 2).otherwise(0) + F.when(top_u != top_v, 2).otherwise(0) + F.when(F.coalesce(community_u != community_v, F.lit(False)), 1).otherwise(0)
    s = F.when(pollution, 0).otherwise(base + more)
    s = F.when(relation == "semantically_similar_to", F.floor(s * 1.5)).otherwise(s)
    lone = (F.least(degree_u, degree_v) <= 2) & (F.greatest(degree_u, degree_v) >= 5)
    return (s + F.when(lone, 1).otherwise(0)).cast("long")


def invalid_rows(nodes: DataFrame, edges: DataFrame, kinds: tuple[str, ...], confidences: tuple[str, ...]) -> DataFrame:
    """(row, problem) of nodes and edges that break the schema: missing fields, unknown kinds or confidences, ends that no node has."""
    problem = lambda df, cond, text: df.where(cond).select(F.col("row"), F.lit(text).alias("problem"))
    n, e = nodes, edges
    out = problem(n, F.col("id").isNull(), "node without id").unionByName(problem(n, F.col("label").isNull(), "node without label")).unionByName(problem(n, F.col("file_type").isNotNull() & ~F.col("file_type").isin(*kinds), "unknown file type"))
    out = out.unionByName(problem(e, F.col("confidence").isNotNull() & ~F.col("confidence").isin(*confidences), "unknown confidence"))
    ids = n.where("id is not null").select("id").distinct()
    for end in ("source", "target"):
        out = out.unionByName(problem(e, F.col(end).isNull(), f"edge without {end}"))
        out = out.unionByName(e.where(F.col(end).isNotNull()).join(ids.withColumnRenamed("id", end), end, "left_anti").select("row", F.lit(f"{end} is no node").alias("problem")))
    return out
