"""Near-duplicate links and components, shared by the MinHash operators.

1. Bucket rows (key, id) are range-partitioned and sorted by (key, id), so that a key with
   very many ids spreads over several tasks, and one streaming pass over each partition
   drops the keys that only one id has (members_of).
2. Each bucket has a leader, the member that shares most with others, and each member is
   compared with it exactly: as many pairs as rows. Links give components.
3. Where members of a leader are not linked with it and components differ, those that are not
   linked with it are compared with all others, in one task if they are about BLOCK members or
   ITEMS items at most. A task takes every member as its difference from the leader's set, since
   |x ^ y| follows from |x ^ L|, |y ^ L| and what these two share. It holds posting lists of one
   side, streams the other past them, and returns only links that join components it has not
   joined yet: no pair ever is a row.
4. Larger groups are not compared as a whole. A link asks for a number of shared items, so two
   members that can be linked share one of the first items that the leader lacks or, where they are
   closer to it, of the first differences of each, rarest of the group first (_open_buckets gives the
   lengths of these beginnings). Members meet in buckets of such an item only, and are compared
   there as in 3, in blocks by hash where a bucket is larger than a block.
   Strangers under one leader differ from it in their own ways and don't meet. Members linked with the
   leader that are close enough without a shared difference are one comparison with the best of
   them. So no link between two ids of a bucket is lost, and a task's memory is that of a
   block, whatever the size of the group.

Comparison streams over rows sorted by leader: the leader's set comes once for at most CROWD
members, so a hot leader spreads over tasks. The work of step 4 is the square of the members that
share a rare difference and are in different components, at some 50 ns each, over blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphmill.llm.text import blocks, ragged
from graphmill.operators.scratch import Scratch

#: Members that one copy of a leader's set is sent to.
CROWD = 512
#: Members that a task holds while others pass, at most about.
BLOCK = 2048
#: Items of sets that a task holds while others pass, and about how many it handles at once.
ITEMS, AT_ONCE = 2 << 20, 1 << 20
#: Members that pass a block together.
ABREAST = 64


def members_of(rows: DataFrame) -> DataFrame:
    """The distinct (key, id) rows whose key has several ids, and of each partition the first and last key whatever it has.

    A run of one key may be of any length: only its first id and the fact that more follow are held.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first_key = key = None  # of the stream, of the open run
        only = before = None  # the open run's single id, until it is told; its last id

        def told(k: np.ndarray, i: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(i, pa.int64())], ["key", "id"])

        for batch in batches:
            k, i = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "id"))
            same = np.zeros(len(k), bool)
            same[1:] = (k[1:] == k[:-1]) & (i[1:] == i[:-1])
            same[:1] = (k[:1] == key) & (i[:1] == before) if key is not None else False
            k, i = k[~same], i[~same]
            if not len(k):
                continue
            first_key = int(k[0]) if first_key is None else first_key
            more = np.append(k[1:] == k[:-1], False)  # the next row has the same key
            show = more.copy()
            show[1:] |= more[:-1]
            show |= k == first_key
            goes_on = key is not None and int(k[0]) == key
            if goes_on:
                show[0] = True
                if only is not None:
                    yield told(np.array([key]), np.array([only]))
            yield told(k[show], i[show])
            only = None if show[-1] else int(i[-1])
            key, before = int(k[-1]), int(i[-1])
        if only is not None:
            yield told(np.array([key]), np.array([only]))

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.select("key", "id").repartitionByRange(n, "key", "id").sortWithinPartitions("key", "id").mapInArrow(work, "key long, id long")


def _signed(df: DataFrame) -> tuple:
    r = df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return r[0], r[1]


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) of every node that has an edge and is not its component's smallest; edges has a and b.

    Union-find by alternating large-star and small-star steps: each node's larger
    neighbours, then its smaller ones, are linked to the smallest. Each step is a
    pre-aggregated minimum and a join with these minima, one row for each node; a hub's
    edges are one key of that join, which adaptive execution splits.
    """
    e = scratch.keep(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    sign = _signed(e)
    while sign[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(m, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        m = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(m, "u").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("x"))
        new = scratch.keep(small.select(F.col("x.u").alias("u"), F.col("x.m").alias("v")).where("u <> v").distinct())
        after = _signed(new)
        scratch.drop(e)
        e = new
        if after == sign:
            break
        sign = after
    return e.select(F.col("u").alias("node"), F.col("v").alias("component"))


def linked_components(rows: DataFrame, sets_for: Callable[[DataFrame], DataFrame], decode: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]], percent: int, scratch: Scratch, extra: DataFrame | None = None) -> DataFrame:
    """(node, component) by exact links, 100 * |intersection| >= percent * |union|, among ids that share a bucket.

    rows: kept (key, id) rows from members_of. sets_for(ids) gives the sets (id, items), one of
    each id; decode makes of a column of items the sorted distinct hashes of all sets (below
    2**48) and where each set's start. extra: further links (a, b), kept.
    """
    size = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    # the order of leadership: how many others an id meets in its buckets
    rank = scratch.keep(rows.join(size, "key").groupBy("id").agg(F.sum("n").alias("rank")))
    sets = scratch.keep(sets_for(rank.select("id")))
    scratch.release()
    ranked = rows.join(size.select("key"), "key").join(rank, "id")
    leader = ranked.groupBy("key").agg(F.max(F.struct("rank", (-F.col("id")).alias("i"))).alias("x")).select("key", (-F.col("x.i")).alias("leader"))
    pairs = scratch.keep(rows.join(leader, "key").where("id <> leader").select("leader", "id").distinct())
    met = scratch.keep(_streamed(pairs, sets, decode, percent))
    scratch.release()
    links = met.where("linked").select(F.col("leader").alias("a"), F.col("id").alias("b"))
    parts = components(links if extra is None else links.unionByName(extra), scratch)
    placed = met.join(parts.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    spans = placed.groupBy("leader").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.bool_and("linked").alias("all"), F.count("*").alias("n"), F.sum("size").alias("items"))
    parted = F.ceil(F.greatest(F.col("n") / BLOCK, F.col("items") / ITEMS)).alias("blocks")
    open_pairs = placed.join(spans.where("lo < hi and not all").select("leader", parted), "leader")
    open_pairs = scratch.keep(open_pairs.select("leader", "id", "linked", "component", "blocks"))
    if open_pairs.isEmpty():
        return parts
    # a group of one block is compared at once; in a larger one only those meet that share a rare difference
    buckets = open_pairs.where("blocks <= 1").select("leader", F.lit(0).cast("long").alias("bucket"), "id", "component", (~F.col("linked")).alias("left"), F.lit(True).alias("right"), "blocks")
    large = open_pairs.where("blocks > 1").select("leader", "id", "linked", "component")
    found = []
    if not large.isEmpty():
        diffs = scratch.keep(_differing(large, sets, decode))
        scratch.release()
        found.append(scratch.keep(_through_best(diffs, percent)))
        buckets = buckets.unionByName(_open_buckets(diffs, percent, scratch).select(buckets.columns))
    found.append(scratch.keep(_across(scratch.keep(buckets), sets, decode, percent)))
    scratch.release()
    links = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    if links.isEmpty():
        return parts
    return components(links.unionByName(parts.select(F.col("component").alias("a"), F.col("node").alias("b"))), scratch)


def _differing(members: DataFrame, sets: DataFrame, decode: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """(leader, id, linked, component, size, head, delta): the sizes of the two sets and the items in one of them only; members: leader, id, linked, component."""

    def row(head: np.ndarray, items: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
        owner, flat = _differences(head, items, at)
        n = len(at) - 1
        return np.diff(at), np.full(n, len(head)), np.bincount(owner, minlength=n), flat[np.argsort(owner, kind="stable")].astype(np.int64)

    def arrays(size: np.ndarray, head: np.ndarray, count: np.ndarray, flat: np.ndarray) -> list[pa.Array]:
        return [pa.array(size), pa.array(head), pa.ListArray.from_arrays(pa.array(np.cumsum([0, *count]).astype(np.int32)), pa.array(flat))]

    return _beside_leaders(members, sets, decode, row, arrays, "leader long, id long, linked boolean, component long, size long, head long, delta array<long>", ["linked", "component"])


def _through_best(diffs: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that follow from distances to the leader alone: of the members linked with it, the one that leaves most room is taken."""
    room = _excess(percent)
    best = diffs.where("linked").groupBy("leader").agg(F.min_by("id", F.struct(room.alias("e"), "id")).alias("best"), F.min(room).alias("best_room"))
    return diffs.where("not linked").join(best, "leader").where(room + F.col("best_room") <= 0).select(F.col("best").alias("a"), F.col("id").alias("b"))


def _excess(percent: int):
    """(100 + percent) * differences - (100 - percent) * size: the sum of two members' values is what their shared differences must make up for, twice."""
    return (100 + percent) * F.size("delta").cast("long") - (100 - percent) * F.col("size")


def _ordered(items: DataFrame, scratch: Scratch) -> DataFrame:
    """(leader, id, order): of items(leader, id, item) those that several ids have, as (n, item), rarest first."""
    shared = scratch.keep(items.groupBy("leader", "item").agg(F.count("*").alias("n")).where("n > 1"))
    return items.join(shared, ["leader", "item"]).groupBy("leader", "id").agg(F.array_sort(F.collect_list(F.struct("n", "item"))).alias("order"))


def _open_buckets(diffs: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(leader, bucket, id, component, left, right, blocks): members that share an item early enough to be linked.

    Two linked sets share percent of the larger, so one of the first size - percent * size + 1 items
    of each in any one order. With the items that the leader lacks first, rarest first, a stranger,
    who has as many of these as that, meets all it can be linked with in its own items.

    The others are nearer to the leader and meet by what they differ in, lacking items too. With
    e = _excess, two members are linked only if they share o >= (e + e') / (2 * (100 +
    percent)) differences, so one of the first d - o + 1 of each in any one order. Of a member not linked
    with the leader e is over (100 - percent) * head. So against such a member o is over (e + (100 -
    percent) * head) / (2 * (100 + percent)); against a linked one, which has no more differences than
    it can share, the first (100 - percent) / percent * size + 1 are enough. A bucket is an
    item and which of the three it is for.
    """
    e, d = _excess(percent), F.size("delta")
    least = F.greatest(F.lit(1), F.floor((e + (100 - percent) * F.col("head")) / (2 * (100 + percent))) + 1)
    far, near = d - least + 1, F.least(d, F.floor((100 - percent) * F.col("size") / percent) + 1)
    # own items come before lacking ones in delta
    diffs = diffs.withColumn("own", F.floor((d + F.col("size") - F.col("head")) / 2).cast("int"))
    reach = F.col("size") - F.ceil(percent * F.col("size") / 100) + 1
    stranger = F.col("own") >= reach
    # items of one member come first in its order and meet nobody: only their number counts
    ordered = lambda some, items, count: some.join(_ordered(some.select("leader", "id", F.explode(items).alias("item")), scratch), ["leader", "id"]).withColumn("alone", count - F.size("order"))
    first = lambda n: F.slice("order", 1, F.greatest(n - F.col("alone"), F.lit(0)).cast("int"))
    rows = lambda some, n, kind, left, right: some.select("leader", "id", "component", "size", F.explode(first(n)).alias("x"), left.alias("left"), right.alias("right")).select("leader", "id", "component", "size", F.xxhash64("x.item", F.lit(kind)).alias("bucket"), "left", "right")
    yes, no = F.lit(True), F.lit(False)
    apart = ordered(diffs, F.slice("delta", 1, F.col("own")), F.col("own"))
    close = ordered(diffs.where(~stranger), F.col("delta"), d)
    both = rows(apart, F.least(F.col("own"), reach), 2, stranger, yes)
    both = both.unionByName(rows(close.where("not linked"), far, 0, yes, yes)).unionByName(rows(close.where("not linked"), near, 1, yes, no)).unionByName(rows(close.where("linked"), far, 1, no, yes))
    both = scratch.keep(both)
    some = both.groupBy("leader", "bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count_if("left").alias("l"), F.count_if("right").alias("r"), F.count("*").alias("n"), F.sum("size").alias("items"))
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK, F.col("items") / ITEMS)).alias("blocks")
    return both.join(some.where("lo < hi and l > 0 and r > 0 and n > 1").select("leader", "bucket", blocks), ["leader", "bucket"])


def _decoded(batch: pa.RecordBatch, decode: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch of about AT_ONCE bytes of sets, with the sets' items and where each set starts."""
    column = batch.column("items").cast(pa.large_binary())
    offs = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    for lo, hi in blocks(np.maximum(np.diff(offs), AT_ONCE // 50_000), AT_ONCE):
        part = batch.slice(lo, hi - lo)
        yield part, *decode(part.column("items"))


def _streamed(pairs: DataFrame, sets: DataFrame, decode: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]], percent: int) -> DataFrame:
    """(leader, id, linked, size) of each pair (leader, id); size is that of the set of id."""

    def row(head: np.ndarray, items: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
        hit = head[np.minimum(np.searchsorted(head, items), len(head) - 1)] == items if len(head) else np.zeros(len(items), bool)
        sums = np.zeros(len(items) + 1, np.int64)
        np.cumsum(hit, out=sums[1:])
        common, size = sums[at[1:]] - sums[at[:-1]], np.diff(at)
        return 100 * common >= percent * (len(head) + size - common), size

    return _beside_leaders(pairs, sets, decode, row, lambda *x: [pa.array(y) for y in x], "leader long, id long, linked boolean, size long")


def _beside_leaders(pairs: DataFrame, sets: DataFrame, decode: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]], row: Callable, arrays: Callable, schema: str, more: list[str] | None = None) -> DataFrame:
    """leader, id, the columns `more` of pairs and what row(leader's set, items of members, where each starts) makes of them, as arrays() puts it."""
    more = more or []
    crowd = pairs.groupBy("leader").agg(F.ceil(F.count("*") / CROWD).alias("salts"))
    many = crowd.where("salts > 1")
    salt = F.coalesce(F.pmod(F.xxhash64("id"), F.col("salts")), F.lit(0))
    own = pairs.join(many, "leader", "left").select("leader", salt.cast("long").alias("salt"), F.lit(1).alias("kind"), "id", *more).join(sets, "id")
    none = [F.lit(None).cast(pairs.schema[c].dataType).alias(c) for c in more]
    heads = crowd.select("leader", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"), F.col("leader").alias("id"), *none).join(sets, "id")
    columns = ["leader", "salt", "kind", "id", *more, "items"]
    names = [x.split()[0] for x in schema.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None, np.zeros(0, np.uint64)
        for whole in batches:
            for batch, flat, at in _decoded(whole, decode):
                leader, member = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("leader", "kind"))
                start = np.flatnonzero(np.append(True, leader[1:] != leader[:-1]) | (member == 0))
                out = []
                for lo, hi in zip(start.tolist(), [*start[1:].tolist(), len(leader)]):
                    if member[lo] == 0:
                        held = leader[lo], flat[at[lo] : at[lo + 1]].copy()
                        lo += 1
                    if lo == hi:
                        continue
                    if held[0] != leader[lo]:
                        raise ValueError("a leader without a set")
                    out.append(row(held[1], flat[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]))
                if out:
                    own = batch.filter(pa.array(member == 1))
                    yield pa.RecordBatch.from_arrays([*(own.column(c) for c in ("leader", "id", *more)), *arrays(*map(np.concatenate, zip(*out)))], names)

    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = heads.select(columns).unionByName(own.select(columns)).repartition(n, "leader", "salt").sortWithinPartitions("leader", "salt", "kind")
    return dealt.mapInArrow(work, schema)


def _across(members: DataFrame, sets: DataFrame, decode: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]], percent: int) -> DataFrame:
    """Links (a, b) between components, enough to join them, from members(leader, bucket, id, component, left, right, blocks): those on the left are compared with those on the right."""
    block = F.pmod(F.xxhash64("id"), F.col("blocks"))
    every = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    columns = ["leader", "bucket", "i", "j", "kind", "id", "component", "items"]
    m = members.join(sets, "id")
    head = members.select("leader", "bucket", "blocks").distinct().join(sets.withColumnRenamed("id", "leader"), "leader")
    head = head.select("leader", "bucket", F.explode(every).alias("i"), every.alias("_j"), "items").select("leader", "bucket", "i", F.explode("_j").alias("j"), F.lit(0).alias("kind"), F.col("leader").alias("id"), F.col("leader").alias("component"), "items")
    left = m.where("left").select("leader", "bucket", block.alias("i"), F.explode(every).alias("j"), F.lit(1).alias("kind"), "id", "component", "items")
    right = m.where("right").select("leader", "bucket", F.explode(every).alias("i"), block.alias("j"), F.lit(2).alias("kind"), "id", "component", "items")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, head, held, block = None, None, [], None
        for whole in batches:
            for batch, flat, at in _decoded(whole, decode):
                key = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("leader", "bucket", "i", "j", "kind")], 1)
                ids, part = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "component"))
                cuts = np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(1)))
                found = []
                for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(key)]):
                    if tuple(key[lo, :4]) != group:
                        group, head, held, block = tuple(key[lo, :4]), None, [], None
                    if key[lo, 4] == 0:
                        head = flat[at[lo] : at[lo + 1]].copy()
                        continue
                    for a in range(lo, hi, ABREAST):
                        b = min(a + ABREAST, hi)
                        rows = ids[a:b], part[a:b], np.diff(at[a : b + 1]), *_differences(head, flat[at[a] : at[b]], at[a : b + 1] - at[a])
                        if key[lo, 4] == 1:
                            held.append(rows)
                            continue
                        if block is None:
                            block, held = _Block(held, percent), []
                        found += block.links(*rows)
                if found:
                    x, y = zip(*found)
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["a", "b"])

    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = head.select(columns).unionByName(left.select(columns)).unionByName(right.select(columns)).repartition(n, "leader", "bucket", "i", "j").sortWithinPartitions("leader", "bucket", "i", "j", "kind")
    return dealt.mapInArrow(work, "a long, b long")


def _differences(head: np.ndarray, flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, item) of the items that each of several sets has and head lacks, or the other way round."""
    n = len(at) - 1
    owner = np.repeat(np.arange(n), np.diff(at))
    if not len(head):
        return owner, flat.copy()
    place = np.minimum(np.searchsorted(head, flat), len(head) - 1)
    hit = head[place] == flat
    lacks = np.ones((n, len(head)), bool)
    lacks[owner[hit], place[hit]] = False
    who, what = np.nonzero(lacks)
    return np.concatenate([owner[~hit], who]), np.concatenate([flat[~hit], head[what]])


class _Block:
    """A block of members of one leader as posting lists of their differences from it."""

    def __init__(self, parts: list[tuple[np.ndarray, ...]], percent: int):
        self.percent = percent
        none = np.zeros(0, np.int64)
        self.ids, self.part, self.size = (np.concatenate([none, *(p[k] for p in parts)]) for k in range(3))
        first = np.cumsum([0, *(len(p[0]) for p in parts)])
        owner = np.concatenate([none, *(p[3] + f for p, f in zip(parts, first))])
        flat = np.concatenate([none.astype(np.uint64), *(p[4] for p in parts)])
        self.apart = np.bincount(owner, minlength=len(self.ids))
        order = np.argsort(flat, kind="stable")
        self.owner, flat = owner[order], flat[order]
        self.start = np.flatnonzero(np.append(True, flat[1:] != flat[:-1])) if len(flat) else none
        self.item = flat[self.start]
        self.count = np.diff(np.append(self.start, len(flat)))
        self.root: dict[int, int] = {}

    def find(self, x: int) -> int:
        while (y := self.root.get(x, x)) != x:
            self.root[x] = x = self.root.get(y, y)
        return x

    def links(self, ids: np.ndarray, part: np.ndarray, size: np.ndarray, owner: np.ndarray, items: np.ndarray) -> list[tuple[int, int]]:
        """Links of other members with those of the block, one for each two components that are not joined yet."""
        n = len(self.ids)
        if not n:
            return []
        apart = np.bincount(owner, minlength=len(ids))
        at = np.minimum(np.searchsorted(self.item, items), len(self.item) - 1)
        known = self.item[at] == items
        at, owner = at[known], owner[known]
        count = self.count[at]
        shared = np.bincount(np.repeat(owner, count) * n + self.owner[ragged(self.start[at], count)], minlength=len(ids) * n).reshape(len(ids), n)
        differ = self.apart + apart[:, None] - 2 * shared
        both = self.size + size[:, None]
        near = ((100 + self.percent) * differ <= (100 - self.percent) * both) & (self.part != part[:, None]) & (self.ids != ids[:, None])
        out = []
        for r, k in zip(*(x.tolist() for x in np.nonzero(near))):
            a, b = self.find(int(self.part[k])), self.find(int(part[r]))
            if a != b:
                self.root[max(a, b)] = min(a, b)
                out.append((int(self.ids[k]), int(ids[r])))
        return out


def six_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The sets of a column of sorted 48-bit items."""
    raw, offs = binary(column)
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = raw.reshape(-1, 6)
    return out.view("<u8").ravel(), offs // 6


def binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column without nulls, and where each value starts."""
    column = column.cast(pa.large_binary())
    offs = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]
