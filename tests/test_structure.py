"""Cycles, blast radius and the entity chain against plain loops."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from graphmill.operators import entities
from graphmill.operators import graph as g
from graphmill.operators.retrieval import bands, blocked_pairs, jaro_winkler, met_pairs


def test_cycles(spark):
    rng = random.Random(2)
    edges = {(rng.randrange(12), rng.randrange(12)) for _ in range(40)}
    skipped = {e for e in edges if (e[0] + e[1]) % 5 == 0}
    df = spark.createDataFrame([(a, b, "co_changed" if (a, b) in skipped else rng.choice(["calls", None])) for a, b in edges] * 2, "source long, target long, type string")
    left = edges - skipped
    for longest in (2, 4):
        want = set()
        for n in range(2, longest + 1):
            for p in itertools.permutations(range(12), n):
                if p[0] == min(p) and all(x in left for x in zip(p, (*p[1:], p[0]))):
                    want.add(p)
        got = g.cycles(df, longest, ("co_changed",)).collect()
        assert {tuple(x.cycle) for x in got} == want and len(got) == len(want) and all(x.n == len(x.cycle) for x in got)
    assert g.cycles(df.where("source < target"), 4).count() == 0 and g.cycles(df.limit(0), 4).count() == 0


def brute_blast(nodes, edges, partners, changed, depth, least):
    file, hop = {n: f for n, f, _ in nodes}, {}
    for a, b, conf in edges:
        if conf >= least:
            hop.setdefault(a, set()).add(b)
            hop.setdefault(b, set()).add(a)
    far = {n: 0 for n, f, _ in nodes if f in changed}
    for d in range(1, depth + 1):
        for n in [x for x in far if far[x] == d - 1]:
            for m in hop.get(n, ()):
                far.setdefault(m, d)
    near = {n: d for n, d in far.items() if d and file[n] not in changed}
    direct = {file[n] for n, d in near.items() if d == 1 and file[n]}
    touched = {file[n] for n in near if file[n]}
    missing = {p for f, p in partners if f in touched | changed} - changed
    important = [n for n, _, i in nodes if i > 0.5]
    share = sum(n in near for n in important) / len(important) if important else len(touched) / len(nodes)
    return {("direct", f) for f in direct} | {("transitive", f) for f in touched - direct} | {("missing", f) for f in missing}, (round(min(1, share), 4), len(touched), len(direct), len(touched - direct), len(missing))


@pytest.mark.parametrize("important", [0.4, 0.0])
def test_blast_radius(spark, important):
    rng = random.Random(8)
    nodes = [(i, rng.choice(["a", "b", "c", "d", "e", "f", "", None]), 0.9 if rng.random() < important else 0.1) for i in range(60)]
    edges = [(rng.randrange(60), rng.randrange(60), rng.random()) for _ in range(70)]
    partners = [("a", "c"), ("b", "z"), ("e", "y"), ("q", "x"), ("c", "a")]
    for depth, changed in ((5, {"a"}), (1, {"a", "b"}), (3, {"none"})):
        files, risk = g.blast_radius(spark.createDataFrame(nodes, "id long, file string, importance double"), spark.createDataFrame(edges, "source long, target long, confidence_score double"), spark.createDataFrame(partners, "file string, partner string"), spark.createDataFrame([(f,) for f in changed], "file string"), depth)
        want = brute_blast(nodes, edges, partners, changed, depth, 0.3)
        got = [tuple(x) for x in files.collect()]
        assert set(got) == want[0] and len(got) == len(want[0]) and tuple(risk.first()) == want[1]


@pytest.fixture(scope="module")
def labelled():
    """500 nodes: families of near labels, exact copies in and across files, short and variant labels."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(4, 9)))
    rows, i = [], 0
    while len(rows) < 480:
        base = f"{word()} {word()} {word()}"
        for _ in range(rng.randrange(1, 5)):
            x = list(base)
            for _ in range(rng.randrange(3)):
                x[rng.randrange(8, len(x))] = rng.choice("abcdefghij")
            label = "".join(x)
            rows.append((f"n{i}" + ("_c2" if rng.random() < 0.2 else ""), label.upper() if rng.random() < 0.3 else label.replace(" ", "__"), rng.choice(["f", "g"]), i % 3))
            i += 1
    rows += [("m1", "cortexa53", "f", 1), ("m2", "cortexa55", "f", 1), ("m3", "extractor", "f", 1), ("m4", "extractar", "g", 1), ("m5", "cranel", "f", 1), ("m6", "cranelr", "f", 1), ("m7", "aaaa", "f", 1), ("m8", "aaab", "f", 1)]
    rows += [("e1", None, "f", 1), ("e2", "", None, None), ("e3", "---", "f", 1), ("ﬁ1", "ﬁne Straße of labels", "f", 1), ("fi2", "FINE STRASSE of LABELS", "f", 2), ("m1", "cortexa53", "f", 1)]
    return rows


def spelled(spark, labels):
    out = spark.createDataFrame([(x,) for x in labels], "label string").select("label", entities.folded_label("label").alias("norm"))
    return {x.label: x.norm for x in out.collect()}


def test_entity_chain(spark, labelled):
    nodes = spark.createDataFrame([(*r[:3], "one") for r in labelled], "id string, label string, file string, repo string")
    com = spark.createDataFrame([(r[0], r[3]) for r in labelled if r[3] is not None], "id string, community long").distinct()
    remap = {x.old: x.new for x in entities.resolve_entities(nodes, com).collect()}
    # every pair of different labels, by the same guards and score
    norm = spelled(spark, {r[1] or r[0] for r in labelled})
    own = {r[0]: (norm[r[1] or r[0]], r[2] or "", r[3]) for r in sorted(labelled, key=str)}
    own = {i: v for i, v in own.items() if v[0]}
    first = {}
    for i in sorted(own):
        first.setdefault(own[i][0], i)
    frame = spark.createDataFrame([(i, x, own[i][2]) for x, i in first.items()], "id string, l string, c long")
    from graphmill.functions import columns as c

    frame = frame.where(c.entropy(F.col("l")) >= 2.5)
    side = lambda k: frame.select(*(F.col(x).alias(x + k) for x in frame.columns))
    pairs = side("a").join(side("b"), F.col("ida") < F.col("idb")).withColumn("s", 100 * jaro_winkler("la", "lb"))
    linked = pairs.where(entities.verified(F.col("s"), F.col("la"), F.col("lb"), F.col("ca") == F.col("cb"))).select("ida", "idb", "la", "lb").collect()
    root = {i: i for i in own}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (x, f, _) in own.items():
        for j, (y, e, _) in own.items():
            if i < j and x == y and f == e:
                root[find(j)] = find(i)
    shingles = lambda t: {t[i : i + 3] for i in range(len(t) - 2)}
    strong = [x for x in linked if len((a := shingles(x.la.replace(" ", ""))) & (b := shingles(x.lb.replace(" ", "")))) >= 0.7 * len(a | b)]
    one = lambda i: remap.get(i, i)
    met = sum(one(x.ida) == one(x.idb) for x in strong)
    assert len(strong) > 50 and met >= 0.9 * len(strong), f"{met} of {len(strong)}"
    # what is merged is linked
    for x in linked:
        root[find(x.idb)] = find(x.ida)
    assert all(find(a) == find(b) for a, b in remap.items())
    # winners: no chunk suffix, then the shortest, then the first
    groups = {}
    for i in own:
        groups.setdefault(one(i), set()).add(i)
    assert all(w == min(v, key=lambda i: (bool(__import__("re").search(r"_c\d+$", i)), len(i), i)) for w, v in groups.items())
    assert one("m1") != one("m2") and one("m5") != one("m6") and one("m7") == "m7" and one("fi2") == one("ﬁ1")


def test_deduplicated_edges(spark):
    nodes = spark.createDataFrame([("a", "one label here", "f"), ("b", "One Label Here", "f"), ("c", "other", "f")], "id string, label string, file string")
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "source string, target string")
    n, e = entities.deduplicate(nodes, edges)
    assert {x.id for x in n.collect()} == {"a", "c"} and {tuple(x) for x in e.collect()} == {("a", "c"), ("c", "a")}
    with pytest.raises(ValueError, match="several repositories"):
        entities.resolve_entities(nodes.withColumn("repo", F.col("id")))
    assert entities.resolve_entities(nodes.limit(0)).count() == 0


def test_met_pairs(spark):
    """All pairs of small buckets; of a crowded one, as many rows as ids times the window."""
    rows = [(1, f"l{i:02d}", f"i{i}") for i in range(9)] + [(2, f"l{i:03d}", f"j{i}") for i in range(100)] + [(3, "x", "alone")]
    got = {tuple(sorted(x)) for x in met_pairs(spark.createDataFrame(rows, "key long, label string, id string"), 8).collect()}
    assert {p for p in got if p[0][0] == "i"} == {tuple(sorted((f"i{a}", f"i{b}"))) for a in range(9) for b in range(a)}
    big = [p for p in got if p[0][0] == "j"]
    assert len(big) <= 9 * 100 and {x for p in big for x in p} == {f"j{i}" for i in range(100)} and all(x != "alone" for p in got for x in p)


def test_bands_find_similar_labels(spark):
    """Of pairs of similarity 0.7 or more at least 0.9 meet, measured; bands of one label differ."""
    rng = random.Random(6)
    rows = []
    for i in range(150):
        base = [rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(30)]
        near = base[:]
        for _ in range(rng.randrange(1, 3)):
            near[rng.randrange(30)] = "_"
        rows += [(f"a{i}", "".join(base)), (f"b{i}", "".join(near))]
    df = spark.createDataFrame(rows, "id string, label string")
    shingles = lambda t: {t[i : i + 3] for i in range(len(t) - 2)}
    label = dict(rows)
    alike = {i for i in range(150) if 10 * len((a := shingles(label[f"a{i}"])) & (b := shingles(label[f"b{i}"]))) >= 7 * len(a | b)}
    met = {tuple(x) for x in blocked_pairs(df).collect()}
    assert len(alike) > 60 and sum((f"a{i}", f"b{i}") in met for i in alike) >= 0.9 * len(alike)
    assert bands(df.limit(1)).select("key").distinct().count() == 25
