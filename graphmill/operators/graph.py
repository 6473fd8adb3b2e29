"""Property-graph operators over nodes(id, ...) and edges(source, target, confidence_score, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphmill.operators.scratch import Scratch, shares


def edge_confidence(edges: DataFrame) -> Column:
    """confidence_score; a missing one is 0, or the number in confidence where that is one."""
    c = F.col("confidence_score")
    return F.coalesce(c, F.expr("try_cast(confidence as double)"), F.lit(0.0)) if "confidence" in edges.columns else F.coalesce(c, F.lit(0.0))


def both_ways(edges: DataFrame) -> DataFrame:
    """(node, other) of every edge from both ends."""
    return edges.select(F.col("source").alias("node"), F.col("target").alias("other")).unionAll(edges.select(F.col("target").alias("node"), F.col("source").alias("other")))


def degree(edges: DataFrame) -> DataFrame:
    """Number of edge ends at each node; a self-loop counts twice."""
    return both_ways(edges).groupBy("node").agg(F.count("*").alias("degree"))


#: Targets of a source that one row holds, about.
CHUNK = 1024


def pagerank(nodes: DataFrame, edges: DataFrame, rounds: int = 20, damping: float = 0.85) -> DataFrame:
    """(id, pagerank) after a fixed number of rounds, divided by the maximum.

    Self-loops go, parallel edges count each, the mass of nodes without an out-edge is spread
    evenly. A row of links has up to about CHUNK targets that get the same share of its source, dealt by
    source in a number of tasks that grows with the edges. Each round is one join and one pre-aggregated
    sum, which takes in all nodes; its result is written, so a round never recomputes the ones before.
    """
    scratch = Scratch(nodes.sparkSession, "pagerank")
    e = scratch.keep(edges.where("source <> target").groupBy("source", "target").agg(F.count("*").alias("n")))
    ids = scratch.keep(nodes.select("id").distinct())
    parts = shares(e, ids)
    dealt = e.repartition(parts, "source")
    out = dealt.groupBy("source").agg(F.sum("n").alias("n_out"), F.ceil(F.count("*") / CHUNK).alias("chunks"))
    chunk = F.pmod(F.xxhash64("target"), F.col("chunks")).alias("chunk")
    links = dealt.join(out.hint("shuffle_hash"), "source").groupBy("source", (F.col("n") / F.col("n_out")).alias("share"), chunk).agg(F.array_sort(F.collect_list("target")).alias("targets"))
    links = scratch.keep(links.select("source", "share", "targets"))
    base = scratch.keep(ids.join(links.select(F.col("source").alias("id"), F.lit(1).alias("_out")).distinct(), "id", "left").select("id", F.col("_out").isNull().alias("dangling")))
    scratch.drop(e)
    n = max(base.count(), 1)
    rank = scratch.keep(base.select("id", "dangling", F.lit(1.0 / n).alias("r")))
    for _ in range(rounds):
        lost = rank.where("dangling").agg(F.sum("r")).first()[0] or 0.0
        given = links.repartition(parts, "source").join(rank.select(F.col("id").alias("source"), "r").repartition(parts, "source").hint("shuffle_hash"), "source")
        got = given.select(F.explode("targets").alias("id"), F.lit(None).cast("boolean").alias("dangling"), (F.col("share") * F.col("r")).alias("got"))
        every = got.unionByName(base.select("id", "dangling", F.lit(0.0).alias("got"))).groupBy("id").agg(F.max("dangling").alias("dangling"), F.sum("got").alias("got"))
        new = scratch.keep(every.where("dangling is not null").select("id", "dangling", (F.lit((1 - damping) / n + damping * lost / n) + damping * F.col("got")).alias("r")))
        scratch.drop(rank)
        rank = new
    top = rank.agg(F.max("r")).first()[0] or 1.0
    return rank.select("id", (F.col("r") / F.lit(top)).alias("pagerank"))


def reach(edges: DataFrame, start: DataFrame, depth: int | None = None, undirected: bool = False, reverse: bool = False) -> DataFrame:
    """(id, depth) of the nodes within depth steps of start(id), or of all that can be reached: breadth-first, one join a level.

    A level is written once, and the nodes seen so far are the union of the levels. A new node
    is two levels back at most where edges go both ways; otherwise it may be in any of them.
    """
    scratch = Scratch(edges.sparkSession, "reach")
    hop = both_ways(edges) if undirected else edges.select(F.col("target" if reverse else "source").alias("node"), F.col("source" if reverse else "target").alias("other"))
    hop = scratch.keep(hop.distinct())
    levels = [scratch.keep(start.select("id").distinct().withColumn("depth", F.lit(0)))]
    while depth is None or len(levels) <= depth:
        step = hop.join(levels[-1].select(F.col("id").alias("node")), "node").select(F.col("other").alias("id")).distinct()
        known = levels[-2:] if undirected else levels
        seen = known[0].select("id")
        for x in known[1:]:
            seen = seen.unionByName(x.select("id"))
        new = scratch.keep(step.join(seen, "id", "left_anti").withColumn("depth", F.lit(len(levels))))
        if new.isEmpty():
            break
        levels.append(new)
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    return out


def impact(edges: DataFrame, start: DataFrame, min_confidence: float = 0.0, most: int | None = None) -> DataFrame:
    """Everything that depends on start (within `most` steps, if given), with depth, direct or transitive, and a tier by the best edge that discovers it."""
    e = edges.where(edge_confidence(edges) >= min_confidence).withColumn("c", edge_confidence(edges))
    levels = reach(e, start, most, reverse=True)
    by = e.join(levels.select(F.col("id").alias("target"), F.col("depth").alias("d")), "target")
    best = by.join(levels.select(F.col("id").alias("source"), F.col("depth").alias("own")), "source").where("own = d + 1").groupBy(F.col("source").alias("id")).agg(F.max("c").alias("best"))
    tier = F.when(F.col("best") >= 0.85, "high").when(F.col("best") >= 0.6, "medium").otherwise("low")
    return levels.where("depth > 0").join(best, "id").select("id", "depth", F.when(F.col("depth") == 1, "direct").otherwise("transitive").alias("kind"), tier.alias("tier"))


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id that undirected edges connect, by alternating large-star and small-star steps."""
    scratch = Scratch(edges.sparkSession, "components")
    e = scratch.keep(edges.where("source <> target").select(F.greatest("source", "target").alias("u"), F.least("source", "target").alias("v")).distinct())
    sign = lambda x: tuple(x.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = sign(e)
    while before[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(m, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        m = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(m, "u").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("x"))
        new = scratch.keep(small.select(F.col("x.u").alias("u"), F.col("x.m").alias("v")).where("u <> v").distinct())
        scratch.drop(e)
        e, after = new, sign(new)
        if after == before:
            break
        before = after
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def label_propagation(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """(id, community): each round every node takes its neighbours' commonest label, ties to the smallest; deterministic."""
    scratch = Scratch(edges.sparkSession, "labels")
    ends = scratch.keep(edges.where("source <> target").select("source", "target"))
    parts = 2 * shares(ends)
    hop = scratch.keep(both_ways(ends).repartition(parts, "node").distinct())
    label = scratch.keep(hop.select(F.col("node").alias("id")).distinct().withColumn("community", F.col("id")))
    for _ in range(rounds):
        votes = hop.join(label.select(F.col("id").alias("other"), "community"), "other").select("node", "community").repartition(parts, "node").groupBy("node", "community").agg(F.count("*").alias("n"))
        new = scratch.keep(votes.groupBy(F.col("node").alias("id")).agg(F.min_by("community", F.struct(-F.col("n"), F.col("community"))).alias("community")))
        scratch.drop(label)
        label = new
    return label


def fuse_edges(edges: DataFrame, families: tuple[str, ...], cap: float = 0.98) -> DataFrame:
    """One row per (source, target, family): fusable families add confidences up to cap, others keep the best."""
    total = F.round(F.least(F.lit(cap), F.sum(F.col("confidence_score").cast("decimal(10,4)")).cast("double")), 4)
    return edges.groupBy("source", "target", "family").agg(
        F.when(F.col("family").isin(*families), total).otherwise(F.max("confidence_score")).alias("confidence_score"),
        F.array_sort(F.collect_set("resolver")).alias("resolvers"),
    )


def cochange(items: DataFrame, least: int, min_strength: float) -> DataFrame:
    """Pairs of items that share groups: items(grp, item); strength = shared / max of both counts.

    Pairs arise within a group only, of distinct items in one order; groups are small by nature (the lines of one commit or order).
    """
    parts = shares(items)
    x = items.select("grp", "item").repartition(parts, "grp").distinct()
    counts = x.groupBy("item").agg(F.count("*").alias("n"))
    pairs = x.select("grp", F.col("item").alias("a")).join(x.select("grp", F.col("item").alias("b")), "grp").where("a < b").select("a", "b").repartition(2 * parts, "a", "b").groupBy("a", "b").agg(F.count("*").alias("together")).where(F.col("together") >= least)
    s = pairs.join(counts.select(F.col("item").alias("a"), F.col("n").alias("na")), "a").join(counts.select(F.col("item").alias("b"), F.col("n").alias("nb")), "b")
    return s.withColumn("raw", F.col("together") / F.greatest("na", "nb")).where(F.col("raw") >= min_strength).select("a", "b", "together", F.round("raw", 4).alias("strength"), F.round(F.least(F.lit(0.9), 0.5 + 0.5 * F.col("raw")), 4).alias("confidence"))


def cohesion(edges: DataFrame, member: DataFrame) -> DataFrame:
    """Inner edges of each community over n(n-1)/2; one member: 1. member: id, community."""
    size = member.groupBy("community").agg(F.count("*").alias("n"))
    m = lambda k, c: member.select(F.col("id").alias(k), F.col("community").alias(c))
    pairs = edges.select(F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target")).where("source <> target").distinct()
    inner = pairs.join(m("source", "cs"), "source").join(m("target", "ct"), "target").where("cs = ct").groupBy(F.col("cs").alias("community")).agg(F.count("*").alias("inner_edges"))
    j = size.join(inner, "community", "left").withColumn("inner_edges", F.coalesce("inner_edges", F.lit(0)))
    return j.select("community", "n", "inner_edges", F.when(F.col("n") <= 1, 1.0).otherwise(F.round(F.col("inner_edges") / (F.col("n") * (F.col("n") - 1) / 2), 6)).alias("cohesion"))


def outliers(values: DataFrame, column: str, sigmas: float) -> DataFrame:
    """Rows above mean + sigmas population standard deviations; fewer than four rows: none. The statistics are one row."""
    s = values.agg(F.avg(column).alias("_mean"), F.stddev_pop(column).alias("_sd"), F.count("*").alias("_n"))
    return values.join(F.broadcast(s)).where((F.col("_n") >= 4) & (F.col(column) > F.col("_mean") + sigmas * F.col("_sd"))).drop("_mean", "_sd", "_n")


def graph_diff(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with change = added or removed. Both sides are grouped together; nulls are alike."""
    both = old.select(*keys, F.lit(1).alias("_side")).unionByName(new.select(*keys, F.lit(2).alias("_side"))).repartition(shares(old, new), *keys)
    sides = both.groupBy(*keys).agg(F.min("_side").alias("_least"), F.max("_side").alias("_most")).where("_least = _most")
    return sides.select(*keys, F.when(F.col("_least") == 2, "added").otherwise("removed").alias("change"))


def strongly_connected(edges: DataFrame) -> DataFrame:
    """(id, component) of nodes on a cycle: trimming to nodes with both kinds of edges, then smallest labels forwards and backwards.

    A node whose smallest forward and backward reaching labels agree is in that label's
    component; settled nodes go, and so do edges between nodes of different labels, since a
    component has one pair of labels. The rest runs again until no edge is left; each round
    settles the component of the smallest id at least.
    """
    scratch = Scratch(edges.sparkSession, "scc")
    e = scratch.keep(edges.where("source <> target").select("source", "target").distinct())
    found = None
    while True:
        while True:  # trim
            n = e.count()
            ok = e.select(F.col("source").alias("x")).intersect(e.select(F.col("target").alias("x")))
            t = scratch.keep(e.join(ok.withColumnRenamed("x", "source"), "source", "left_semi").join(ok.withColumnRenamed("x", "target"), "target", "left_semi").select("source", "target"))
            scratch.drop(e)
            e = t
            if t.count() == n:
                break
        if e.isEmpty():
            break
        ids = e.select(F.col("source").alias("id")).distinct()

        def spread(a: str, b: str) -> DataFrame:
            lab = scratch.keep(ids.withColumn("m", F.col("id")))
            while True:
                step = e.select(F.col(a).alias("id"), F.col(b).alias("to")).join(lab, "id").select(F.col("to").alias("id"), "m")
                new = scratch.keep(lab.unionByName(step).groupBy("id").agg(F.min("m").alias("m")))
                moved = new.exceptAll(lab).limit(1).count()
                scratch.drop(lab)
                lab = new
                if not moved:
                    return lab

        f, g = spread("source", "target"), spread("target", "source")
        done = scratch.keep(f.join(g.withColumnRenamed("m", "w"), "id").where("m = w").select("id", F.col("m").alias("component")))
        found = done if found is None else found.unionByName(done)
        rest = scratch.keep(f.join(g.withColumnRenamed("m", "w"), "id").where("m <> w"))
        end = lambda k: rest.select(F.col("id").alias(k), "m", "w")
        cut = scratch.keep(e.join(end("source"), "source").join(end("target"), ["target", "m", "w"]).select("source", "target"))
        for x in (e, f, g, rest):
            scratch.drop(x)
        e = cut
    if found is None:
        return e.select(F.col("source").alias("id"), F.col("target").alias("component")).limit(0)
    w = Window.partitionBy("component")
    return found.withColumn("n", F.count("*").over(w)).where("n > 1").select("id", "component")


def prune_dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose both ends exist; nodes: id, and end (source or target) where ids are good for one end only."""
    out = edges
    for end in ("source", "target"):
        own = nodes.where(F.col("end") == end) if "end" in nodes.columns else nodes
        out = out.join(own.select(F.col("id").alias(end)).distinct(), end, "left_semi")
    return out


#: Up to so many nodes a cycle is found by joins alone.
SHORT_CYCLE = 3


def cycles(edges: DataFrame, longest: int, skip_types: tuple[str, ...] = ()) -> DataFrame:
    """(cycle, n): every simple cycle of up to `longest` nodes once, as the list of its nodes from the smallest one on.

    edges: source, target and, where skip_types are given, type. Loops and parallel edges don't
    count. From each smallest node paths grow by larger nodes, one join a step, and close where an
    edge leads back. Only edges within one strongly connected component can lie on a cycle, but to find
    these takes many rounds over all edges, more than the steps themselves where cycles are short, so it is done
    for cycles of more than SHORT_CYCLE nodes. The number of paths depends on the graph, so `longest` is the feature's own bound.
    """
    scratch = Scratch(edges.sparkSession, "cycles")
    e = edges.where(~F.col("type").isin(*skip_types) | F.col("type").isNull()) if skip_types else edges
    e = scratch.keep(e.where("source <> target").select("source", "target").distinct())
    if longest > SHORT_CYCLE:
        part = strongly_connected(e)
        at = lambda end: part.select(F.col("id").alias(end), F.col("component").alias(f"_{end}"))
        e = scratch.keep(e.join(at("source"), "source").join(at("target"), "target").where("_source = _target").select("source", "target"))
    paths = scratch.keep(e.where("source < target").select(F.col("source").alias("start"), F.col("target").alias("last"), F.array("source", "target").alias("cycle")))
    back = e.select(F.col("source").alias("last"), F.col("target").alias("start"))
    out = paths.join(back, ["last", "start"]).select("cycle")
    for _ in range(2, longest):
        step = paths.join(e.withColumnRenamed("source", "last"), "last").where(F.col("target") > F.col("start")).where(~F.array_contains("cycle", F.col("target")))
        paths = scratch.keep(step.select("start", F.col("target").alias("last"), F.array_append("cycle", F.col("target")).alias("cycle")))
        if paths.isEmpty():
            break
        out = out.unionByName(paths.join(back, ["last", "start"]).select("cycle"))
    return out.select("cycle", F.size("cycle").alias("n"))


def blast_radius(nodes: DataFrame, edges: DataFrame, partners: DataFrame, changed: DataFrame, depth: int = 5, min_confidence: float = 0.3) -> tuple[DataFrame, DataFrame]:
    """What a change of files touches: (kind, file) and one row of risk and counts.

    nodes: id, file, importance. edges: source, target, confidence_score of all relations, followed both
    ways. partners: (file, partner) that change together. changed: file. kind is direct (one
    step away), transitive (up to `depth` steps, and not direct) or missing (changes together with
    a changed or touched file, and isn't changed). risk is the share of the important nodes
    (over 0.5) that are reached outside the changed files; where no node is important, the share of touched files
    in all nodes. Nodes without a file are passed through and not told.
    """
    scratch = Scratch(nodes.sparkSession, "blast")
    changed = scratch.keep(changed.select("file").distinct())
    e = edges.where(edge_confidence(edges) >= min_confidence)
    start = nodes.join(changed, "file", "left_semi").select("id")
    near = scratch.keep(reach(e, start, depth, undirected=True).join(nodes.select("id", "file", "importance"), "id").join(changed.withColumn("_own", F.lit(True)), "file", "left").where("depth > 0 and _own is null"))
    kinds = near.where("file is not null and file <> ''").groupBy("file").agg(F.when(F.min("depth") == 1, "direct").otherwise("transitive").alias("kind"))
    kinds = scratch.keep(kinds.select("kind", "file"))
    seen = changed.unionByName(kinds.select("file"))
    missing = partners.join(seen, "file", "left_semi").select(F.col("partner").alias("file")).distinct().join(changed, "file", "left_anti").where("file <> ''")
    files = kinds.unionByName(missing.select(F.lit("missing").alias("kind"), "file"))
    counts = files.agg(*(F.count_if(F.col("kind") == k).alias(k) for k in ("direct", "transitive", "missing")))
    all_of = nodes.agg(F.count("*").alias("_n"), F.count_if(F.col("importance") > 0.5).alias("_important"))
    hit = near.agg(F.count_if(F.col("importance") > 0.5).alias("_hit"))
    # three tables of one row each
    one = counts.join(F.broadcast(all_of)).join(F.broadcast(hit))
    touched = F.col("direct") + F.col("transitive")
    share = F.when(F.col("_important") > 0, F.col("_hit") / F.col("_important")).otherwise(touched / F.greatest(F.col("_n"), F.lit(1)))
    return files, one.select(F.round(F.least(F.lit(1.0), share), 4).alias("risk"), touched.alias("total_affected"), "direct", "transitive", "missing")
