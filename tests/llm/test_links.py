"""Links within buckets against all pairs, on families that are mostly strangers to each other."""

import random

import numpy as np
import pytest

from graphmill.llm import links
from graphmill.operators.scratch import Scratch


def six(items):
    return np.array(sorted(items), "<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def families(seed, count, most):
    """Sets of one key each: copies of a base with random changes, changes of sub-families, and parts cut off."""
    rng = random.Random(seed)
    rows, sets, i = [], {}, 0
    for key in range(count):
        base = rng.sample(range(1 << 40), rng.randrange(5, 60))
        stems = [base] + [[x if rng.random() > 0.15 else rng.randrange(1 << 40) for x in base] for _ in range(3)]
        for _ in range(rng.randrange(2, most)):
            stem = rng.choice(stems)
            keep = stem[: rng.randrange(max(2, len(stem) // 2), len(stem) + 1)] if rng.random() < 0.4 else stem
            rate = rng.choice([0.0, 0.03, 0.08, 0.15])
            sets[i] = {x if rng.random() > rate else rng.randrange(1 << 40) for x in keep} | ({rng.randrange(1 << 40) for _ in range(rng.randrange(8))} if rng.random() < 0.3 else set())
            rows.append((key, i))
            i += 1
    return rows, sets


def brute(rows, sets, percent):
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by = {}
    for k, i in rows:
        by.setdefault(k, []).append(i)
    for v in by.values():
        for n, a in enumerate(v):
            for b in v[:n]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    root[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in sets}


@pytest.mark.parametrize(("percent", "block"), [(80, 4), (60, 2048)])
def test_no_link_is_lost(spark, monkeypatch, percent, block):
    monkeypatch.setattr(links, "BLOCK", block)
    monkeypatch.setattr(links, "CROWD", 16)
    monkeypatch.setattr(links, "AT_ONCE", 2000)
    rows, sets = families(percent + block, 30, 40)
    table = spark.createDataFrame([(i, six(v)) for i, v in sets.items()], "id long, items binary")
    keyed = links.members_of(spark.createDataFrame(rows, "key long, id long"))
    got = links.linked_components(keyed, lambda ids: table.join(ids, "id", "left_semi"), links.six_bytes, percent, Scratch(spark, "test"))
    want = brute(rows, sets, percent)
    assert len(set(want.values())) > 50
    assert {i: want[i] for i in want if want[i] != i} == {x.node: x.component for x in got.collect() if x.node != x.component}


def test_strangers_do_not_meet(spark):
    """3,000 sets under one leader, each with its own quarter: hardly any of their 4.5 million pairs meets in a bucket."""
    rng = random.Random(1)
    base = rng.sample(range(1 << 40), 80)
    sets = {0: set(base)}
    for i in range(1, 3000):
        own = set(rng.sample(base, 60 if i % 3 else 76))
        sets[i] = own | {rng.randrange(1 << 40) for _ in range(80 - len(own))}
    members = spark.createDataFrame([(0, i, bool(i % 3 == 0), i if i % 3 else 0) for i in sets if i], "leader long, id long, linked boolean, component long")
    table = spark.createDataFrame([(i, six(v)) for i, v in sets.items()], "id long, items binary")
    scratch = Scratch(spark, "test")
    diffs = scratch.keep(links._differing(members, table, links.six_bytes))
    size = {x.id: (x.size, x.head, set(x.delta)) for x in diffs.collect()}
    assert size == {i: (len(v), 80, v ^ sets[0]) for i, v in sets.items() if i}
    buckets = links._open_buckets(diffs, 80, scratch).groupBy("bucket").count().collect()
    assert sum(x["count"] ** 2 for x in buckets) < 3000
