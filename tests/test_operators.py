"""Operators on small tables with known results."""

import random

import pytest
from pyspark.sql import functions as F

from graphmill.functions import columns as c
from graphmill.operators import graph as g
from graphmill.operators import relational as r
from graphmill.operators import retrieval as v
from graphmill.plans.queries import QUERIES


def edges(spark, pairs):
    return spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "source long, target long, confidence_score double")


def test_pagerank_star(spark):
    n = spark.range(6)
    got = {x.id: x.pagerank for x in g.pagerank(n, edges(spark, [(i, 0) for i in range(1, 6)])).collect()}
    assert got[0] == 1.0 and all(got[i] < 1 for i in range(1, 6))


def test_reach_and_impact(spark):
    e = edges(spark, [(1, 2), (2, 3), (3, 4), (9, 4)])
    start = spark.range(4, 5)
    assert {(x.id, x.depth) for x in g.reach(e, start, 2, reverse=True).collect()} == {(4, 0), (3, 1), (9, 1), (2, 2)}
    assert {(x.id, x.kind) for x in g.impact(e, start).collect()} == {(3, "direct"), (9, "direct"), (2, "transitive"), (1, "transitive")}


def test_components_random(spark):
    rng = random.Random(4)
    pairs = [(rng.randrange(120), rng.randrange(120)) for _ in range(80)] + [(200 + i, 201 + i) for i in range(30)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {x.id: x.component for x in g.components(edges(spark, pairs)).collect()}
    assert got == {x: find(x) for x in root}


def test_strongly_connected(spark):
    e = edges(spark, [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 1), (7, 7)])
    assert {(x.id, x.component) for x in g.strongly_connected(e).collect()} == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4)}


def test_strongly_connected_chain(spark):
    n = 35
    pairs = [p for i in range(n) for p in ((2 * i, 2 * i + 1), (2 * i + 1, 2 * i), (2 * i + 1, 2 * i + 2))]
    assert {(x.id, x.component) for x in g.strongly_connected(edges(spark, pairs)).collect()} == {(i, i - i % 2) for i in range(2 * n)}


def test_cycles_over_whole_keys(spark, sf_dir):
    parts = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey").collect()
    lines, after = sorted(map(tuple, parts)), {}
    for (o, _, a), (q, _, b) in zip(lines, lines[1:]):
        if o == q and a != b:
            after.setdefault(a, set()).add(b)

    def reached(x):
        seen, todo = set(), [x]
        while todo:
            new = after.get(todo.pop(), set()) - seen
            seen |= new
            todo.extend(new)
        return seen

    to = {x: reached(x) for x in after}
    want = {(x, min(y for y in to[x] if x in to.get(y, ()))) for x in after if x in to[x]}
    assert {(x.id, x.component) for x in QUERIES["g7_cycles"](spark, sf_dir).collect()} == want


def test_edge_fusion_caps(spark):
    e = spark.createDataFrame([(1, 2, "calls", "a", 0.78), (1, 2, "calls", "b", 0.95), (1, 2, "co", "a", 0.3), (1, 2, "co", "b", 0.4)], "source long, target long, family string, resolver string, confidence_score double")
    got = {x.family: (x.confidence_score, x.resolvers) for x in g.fuse_edges(e, ("calls",)).collect()}
    assert got == {"calls": (0.98, ["a", "b"]), "co": (0.4, ["a", "b"])}


def test_cochange(spark):
    rows = [(i, x) for i in range(5) for x in "ab"]
    got = g.cochange(spark.createDataFrame(rows, "grp long, item string"), 3, 0.3).collect()
    assert [(x.a, x.b, x.together, x.strength, x.confidence) for x in got] == [("a", "b", 5, 1.0, 0.9)]


def test_empty_graph(spark):
    e = edges(spark, [])
    assert g.components(e).count() == 0 and g.strongly_connected(e).count() == 0
    assert g.pagerank(spark.range(0), e).count() == 0


def test_running_budget_stops_at_overflow(spark):
    df = spark.createDataFrame([("a", 1, 60), ("a", 2, 50), ("a", 3, 10), ("b", 1, 900)], "k string, o int, n int")
    assert {(x.k, x.o) for x in r.running_budget(df, ["k"], ["o"], "n", 100).collect()} == {("a", 1), ("b", 1)}


def test_filter_or_all(spark):
    df = spark.range(5)
    assert r.filter_or_all(df, F.col("id") > 3).count() == 1
    assert r.filter_or_all(df, F.col("id") > 30).count() == 5


def test_jaro_winkler(spark):
    df = spark.createDataFrame([("martha", "marhta"), ("same", "same"), ("abc", "xyz"), (None, "a")], "a string, b string")
    got = [x.s for x in df.select(v.jaro_winkler("a", "b").alias("s")).collect()]
    assert round(got[0], 4) == 0.9611 and got[1:3] == [1.0, 0.0] and got[3] is None


def test_columns(spark):
    df = spark.createDataFrame([("http://h/api/42/x/?q=1", "AAbb", "1d2h30min")], "u string, e string, m string")
    x = df.select(c.url_path(F.col("u")).alias("u"), c.entropy(F.col("e")).alias("e"), c.effort_minutes(F.col("m")).alias("m")).first()
    assert (x.u, x.m) == ("/api/*/x", 630)
    assert abs(x.e - 1.0) < 1e-9


# betweenness, importance and the graph's other parts


def brandes(nodes, edges, sources):
    out = dict.fromkeys(nodes, 0.0)
    succ = {n: sorted({b for a, b in edges if a == n and b != n}) for n in nodes}
    for s in sources:
        dist, paths, order, preds = {s: 0}, {s: 1.0}, [], {n: [] for n in nodes}
        queue = [s]
        while queue:
            v = queue.pop(0)
            order.append(v)
            for w in succ[v]:
                if w not in dist:
                    dist[w] = dist[v] + 1
                    queue.append(w)
                if dist[w] == dist[v] + 1:
                    paths[w] = paths.get(w, 0.0) + paths[v]
                    preds[w].append(v)
        dep = dict.fromkeys(nodes, 0.0)
        for w in reversed(order):
            for v in preds[w]:
                dep[v] += paths[v] / paths[w] * (1 + dep[w])
            if w != s:
                out[w] += dep[w]
    top = max(out.values()) or 1.0
    return {n: v / top for n, v in out.items()}


def test_betweenness(spark):
    from graphmill.operators import codegraph as k

    rng = random.Random(4)
    nodes = list(range(30))
    edges = [(rng.randrange(30), rng.randrange(30)) for _ in range(70)] + [(1, 2), (2, 3), (3, 4), (5, 5)]
    n = spark.createDataFrame([(i,) for i in nodes], "id long")
    e = spark.createDataFrame(edges, "source long, target long")
    got = {r.id: r.betweenness for r in k.betweenness(n, e, k.sampled_sources(n)).collect()}
    want = brandes(nodes, edges, nodes)
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in nodes)
    few = sorted(r.id for r in k.sampled_sources(n, 7).collect())
    assert few == sorted(random.Random(42).sample(range(30), 7))
    assert all(r.betweenness == 0 for r in k.betweenness(n, e.limit(0), n).collect())


def test_stable_communities(spark):
    from graphmill.operators import codegraph as k

    rng = random.Random(6)
    new = [(i, rng.randrange(8)) for i in range(200)]
    old = [(i, rng.randrange(6) * 3) for i in range(150)]
    got = {r.community: r.final for r in k.stable_communities(spark.createDataFrame(new, "id long, community long"), spark.createDataFrame(old, "id long, community long")).collect()}
    overlap = {}
    was = dict(old)
    for i, c in new:
        if i in was:
            overlap[was[i], c] = overlap.get((was[i], c), 0) + 1
    want, used = {}, set()
    for (o, c), _ in sorted(overlap.items(), key=lambda x: (-x[1], x[0][0], x[0][1])):
        if c not in want and o not in used:
            want[c] = o
            used.add(o)
    sizes = {c: ([i for i, x in new if x == c]) for c in {c for _, c in new}}
    free = 0
    for c in sorted((c for c in sizes if c not in want), key=lambda c: (-len(sizes[c]), min(sizes[c]))):
        while free in used:
            free += 1
        want[c] = free
        used.add(free)
    assert got == want


def test_merged_dimensions(spark):
    from graphmill.functions import rules as r

    df = spark.createDataFrame([(["Correct results!", "ab", "correct RESULTS", "results", "other thing", "a third"],)], "d array<string>")
    assert df.select(r.merged_dimensions(["base dimension"], F.col("d"), 3)).first()[0] == ["base dimension", "Correct results!", "other thing"]


def test_smart_query(spark):
    from graphmill.operators import memory as m

    near = spark.createDataFrame([(i, 1 - i / 10, i) for i in range(8)], "id long, similarity double, rank int")
    text = spark.createDataFrame([(3, 0), (9, 1)], "id long, rank int")
    rows = spark.createDataFrame([(i, ["T"] if i < 6 else [], 1.0, 0.0, 0.0, i == 1) for i in range(10)], "id long, tags array<string>, decay double, confidence double, boost double, negated boolean")
    got = m.smart_query(near, text, rows, "9", 3, 0.3, ["t"]).collect()
    by = {(x.kind, x.place): x.id for x in got}
    assert by == {("result", 1): 9, ("result", 2): 3, ("result", 3): 0, ("negative", 1): 1}
    assert {x.id for x in m.smart_query(near, text, rows, None, 3, 0.3, ["none"]).collect()} == {3, 0, 2, 1}


def test_one_repository(spark):
    from graphmill.operators import codegraph as k

    k.one_repository(spark.createDataFrame([("a",), (None,)], "repo string"))
    with pytest.raises(ValueError):
        k.one_repository(spark.createDataFrame([("a",), ("b",)], "repo string"))


def test_greedy_pack(spark):
    rng = random.Random(1)
    rows = [(f"g{i % 3}", i, rng.randrange(1, 60)) for i in range(90)] + [("g0", 100, 500), (None, 1, 5)]
    want = {}
    for g in ("g0", "g1", "g2", None):
        n, used = -1, 0
        for _, o, c in sorted((x for x in rows if x[0] == g), key=lambda x: x[1]):
            if n < 0 or (used + c > 100 and used > 0):
                n, used = n + 1, 0
            used += c
            want[g, o] = n
    got = r.greedy_pack(spark.createDataFrame(rows, "g string, o int, c int").repartition(4), "g", ["o"], "c", 100).collect()
    assert {(x.g, x.o): x.bin for x in got} == want
