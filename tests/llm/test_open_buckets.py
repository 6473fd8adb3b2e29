"""Members of a large group that share a passage with its leader and little else (findings F1 and F2 of the third round)."""

import random

import numpy as np

from graphmill.llm import links
from graphmill.operators.scratch import Scratch


def _diffs(spark, head, sets):
    items, at = np.concatenate(sets), np.cumsum([0, *map(len, sets)])
    owner, flat = links._differences(head, items, at)
    flat = flat[np.argsort(owner, kind="stable")]
    count = np.bincount(owner, minlength=len(sets))
    ends = np.cumsum(count)
    rows = [(0, i + 1, bool(100 * len(np.intersect1d(s, head)) >= 80 * len(np.union1d(s, head))), i + 1, len(s), len(head), flat[e - c : e].astype(int).tolist()) for i, (s, c, e) in enumerate(zip(sets, count, ends))]
    return spark.createDataFrame(rows, "leader long, id long, linked boolean, component long, size long, head long, delta array<long>")


def _met(rows):
    """The pairs that are compared, by their buckets."""
    sides = {}
    for r in rows:
        x, y = sides.setdefault(r.bucket, ([], []))
        if r.left:
            x.append(r.id)
        if r.right:
            y.append(r.id)
    return {(min(a, b), max(a, b)) for x, y in sides.values() for a in x for b in y if a != b}


def test_strangers_with_frequent_items_hardly_meet(spark):
    """Strangers whose own items are partly frequent ones of the language are not sent once for each of these; near copies among them meet still."""
    rng = random.Random(11)
    head = np.arange(100, dtype=np.uint64)
    sets, fresh = [], iter(range(10_000, 1_000_000))
    for i in range(600):
        passage, frequent = rng.sample(range(100), 40), rng.sample(range(1_000, 1_200), 30)
        s = passage + frequent + [next(fresh) for _ in range(30)]
        sets.append(np.array(sorted(s), np.uint64))
        if i % 20 == 0:  # a near copy of it
            sets.append(np.array(sorted(s[:-5] + [next(fresh) for _ in range(5)]), np.uint64))
    rows = links._open_buckets(_diffs(spark, head, sets), 80, Scratch(spark, "test")).collect()
    assert len(rows) < 5 * len(sets)
    met = _met(rows)
    copies = [(i + 1, i + 2) for i in range(len(sets) - 1) if len(np.intersect1d(sets[i], sets[i + 1])) == 95]
    assert len(copies) == 30 and met >= set(copies)


def test_no_link_is_lost_at_any_distance_from_the_leader(spark):
    """Random families between copies of the leader and strangers: every pair that is linked and not both linked with the leader meets, or follows from distances alone."""
    rng = random.Random(12)
    head = list(range(60))
    families = []
    for own in (3, 8, 10, 12, 14, 16, 20, 30, 45):
        base = head[: 60 - rng.randrange(own + 1)] + [1_000 * own + i for i in range(own)]
        families += [sorted({*rng.sample(base, len(base) - rng.randrange(8)), *(rng.randrange(100_000, 100_040) for _ in range(rng.randrange(8)))}) for _ in range(12)]
    sets = [np.array(f, np.uint64) for f in families]
    diffs = _diffs(spark, np.array(head, np.uint64), sets)
    scratch = Scratch(spark, "test")
    met = _met(links._open_buckets(diffs, 80, scratch).collect())
    info = {r.id: r for r in diffs.collect()}
    room = lambda r: 180 * len(r.delta) - 20 * r.size
    needed = 0
    for a in range(len(sets)):
        for b in range(a + 1, len(sets)):
            x, y = info[a + 1], info[b + 1]
            linked = 100 * len(np.intersect1d(sets[a], sets[b])) >= 80 * len(np.union1d(sets[a], sets[b]))
            if linked and not (x.linked and y.linked) and room(x) + room(y) > 0:
                needed += 1
                assert (a + 1, b + 1) in met
    assert needed > 100
