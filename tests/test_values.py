"""Results of operators without SQL against plain loops: importance, label propagation, verified pairs, visible text, repository pins."""

import collections
import random

import pytest
from test_operators import brandes

from graphmill.functions import columns as c
from graphmill.operators import codegraph as k
from graphmill.operators import graph as g
from graphmill.operators import retrieval
from graphmill.sources import files


def test_importance(spark):
    """Half of PageRank after 20 rounds, 0.3 of degree and 0.2 of betweenness, each over its maximum."""
    rng = random.Random(9)
    nodes, edges = list(range(15)), [(rng.randrange(14), rng.randrange(14)) for _ in range(40)] + [(3, 3), (1, 2), (1, 2)]
    n, e = spark.createDataFrame([(i,) for i in nodes], "id long"), spark.createDataFrame(edges, "source long, target long")
    rank = dict.fromkeys(nodes, 1 / 15)
    out = {i: [b for a, b in edges if a == i != b] for i in nodes}
    for _ in range(20):
        lost = sum(r for i, r in rank.items() if not out[i])
        new = {i: 0.15 / 15 + 0.85 * lost / 15 for i in nodes}
        for i in nodes:
            for b in out[i]:
                new[b] += 0.85 * rank[i] / len(out[i])
        rank = new
    ends = collections.Counter(x for p in edges for x in p)
    btw = brandes(nodes, edges, nodes)
    want = {i: 0.5 * rank[i] / max(rank.values()) + 0.3 * ends[i] / max(ends.values()) + 0.2 * btw[i] for i in nodes}
    central = spark.createDataFrame([(i, v / max(ends.values())) for i, v in ends.items()], "id long, degree_centrality double")
    got = {x.id: x.importance for x in k.importance(g.pagerank(n, e), central, k.betweenness(n, e, n)).collect()}
    assert got == {i: pytest.approx(v, abs=2e-6) for i, v in want.items()}


def test_label_propagation(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(40), rng.randrange(40)) for _ in range(60)] + [(7, 7), (1, 2), (2, 1)]
    near = collections.defaultdict(set)
    for a, b in edges:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    label = {i: i for i in near}
    for _ in range(5):
        votes = {i: collections.Counter(label[j] for j in near[i]) for i in near}
        label = {i: min(v, key=lambda x: (-v[x], x)) for i, v in votes.items()}
    got = {x.id: x.community for x in g.label_propagation(spark.createDataFrame(edges, "source long, target long"), 5).collect()}
    assert got == label


def jaro_winkler(a, b):
    far = max(max(len(a), len(b)) // 2 - 1, 0)
    used, hits = set(), []
    for i, x in enumerate(a):
        j = next((j for j in range(max(0, i - far), min(len(b), i + far + 1)) if j not in used and b[j] == x), None)
        if j is not None:
            used.add(j)
            hits.append(x)
    if not hits:
        return 0.0
    moved = sum(x != b[j] for x, j in zip(hits, sorted(used))) / 2
    m = len(hits)
    jaro = (m / len(a) + m / len(b) + (m - moved) / m) / 3
    same = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4])) if x != y), min(4, len(a), len(b)))
    return jaro + same * 0.1 * (1 - jaro) if jaro > 0.7 else jaro


def test_verified_pairs(spark):
    """Every pair that is told scores enough, and of the pairs with similar shingles at least 0.9 are told."""
    rng = random.Random(12)
    labels = []
    for _ in range(120):
        base = "".join(rng.choice("abcdefghijklmno") for _ in range(24))
        labels += [base, base[:12] + rng.choice("xyz") + base[13:]]
    labels = dict(enumerate(dict.fromkeys(labels)))
    got = {(x.a, x.b): x.score for x in retrieval.resolve(spark.createDataFrame(list(labels.items()), "id long, label string"), 0.9).collect()}
    assert all(a < b and s >= 0.9 and s == pytest.approx(jaro_winkler(labels[a], labels[b]), abs=1e-4) for (a, b), s in got.items())
    grams = {i: {t[j : j + 3] for j in range(len(t) - 2)} for i, t in labels.items()}
    strong = [(a, b) for a in labels for b in labels if a < b and 10 * len(grams[a] & grams[b]) >= 7 * len(grams[a] | grams[b]) and jaro_winkler(labels[a], labels[b]) >= 0.9]
    assert len(strong) > 60 and sum(p in got for p in strong) >= 0.9 * len(strong)


def test_visible_text(spark):
    html = [(1, "<h1>Big  Title</h1><p>no</p><button class='x'>Press me</button>"), (2, None), (3, ""), (4, "<button>Press me</button><button>Press me</button>")]
    got = {x.id: x.t for x in spark.createDataFrame(html, "id long, html string").select("id", c.visible_text("html").alias("t")).collect()}
    assert got == {1: "Big  Title | Press me", 2: None, 3: "", 4: "Press me"}


def test_git_dependencies(spark):
    content = '"a": "git+https://host.org/team/a.git#v1.2", "b": "git+ssh://git@host.org/team/b.git@main" \n c @ git+https://host.org/team/c.git\n plain==1.0 https://host.org/d.git#x'
    got = [tuple(x) for x in files.git_dependencies(spark.createDataFrame([("m", content), ("n", None), ("o", "")], "path string, content string")).collect()]
    assert sorted(got, key=str) == [("m", "https://host.org/team/a", "v1.2"), ("m", "https://host.org/team/c", None), ("m", "ssh://git@host.org/team/b", "main")]
