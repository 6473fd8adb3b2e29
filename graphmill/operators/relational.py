"""Relational operators: filters with fallbacks, theta and set-overlap joins, ranking, paging, set logic and upserts."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphmill.functions.rules import any_in
from graphmill.operators.scratch import Scratch, shares


def project_key(c: Column) -> Column:
    """PROJ-123 or proj as PROJ."""
    return F.upper(F.regexp_extract(F.trim(c), "^([A-Za-z][A-Za-z0-9_]*)", 1))


def filter_or_all(df: DataFrame, keep: Column) -> DataFrame:
    """Rows that pass, or all rows if none passes. The flag is one pre-aggregated row."""
    some = F.broadcast(df.agg(F.coalesce(F.bool_or(keep), F.lit(False)).alias("_some")))
    return df.join(some).where(~F.col("_some") | keep).drop("_some")


def glob_regex(pattern: str) -> str:
    """A regular expression for a glob: * within a path step, ** across steps, ? one character."""
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        elif pattern[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif pattern[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + ("\\" if pattern[i] in ".^$+()[]{}|\\" else "") + pattern[i], i + 1
    return "^" + out + "$"


def last_match(value: Column, rules: list[tuple[str, object]], default: object) -> Column:
    """The outcome of the last rule whose glob matches."""
    return F.coalesce(*(F.when(value.rlike(glob_regex(p)), F.lit(o)) for p, o in reversed(rules)), F.lit(default))


def first_per(df: DataFrame, keys: list[str], order: list, name: str = "_rank", most: int = 1) -> DataFrame:
    """The first `most` rows of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= most)


def page(df: DataFrame, order: list, limit: int, offset: int) -> DataFrame:
    """A page with total, has_more and next_offset."""
    total = F.broadcast(df.agg(F.count("*").alias("total")))
    rows = df.orderBy(*order).offset(offset).limit(limit)
    more = F.col("total") > offset + limit
    return rows.join(total).withColumn("has_more", more).withColumn("next_offset", F.when(more, F.lit(offset + limit)))


def running_budget(df: DataFrame, by: list[str], order: list, cost: str, budget: int) -> DataFrame:
    """Rows of each group until the cost runs over budget; stops at the first overflow, and keeps one row at least."""
    w = Window.partitionBy(*by).orderBy(*order)
    d = df.withColumn("_sum", F.sum(cost).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.row_number().over(w))
    return d.where((F.col("_sum") <= budget) | (F.col("_n") == 1)).drop("_sum", "_n")


def changed(current: DataFrame, stored: DataFrame, key: str, digest: str) -> DataFrame:
    """key and change (new, changed, deleted, unchanged) of two states."""
    a = current.select(F.col(key), F.col(digest).alias("_now"))
    b = stored.select(F.col(key), F.col(digest).alias("_was"))
    state = F.when(F.col("_was").isNull(), "new").when(F.col("_now").isNull(), "deleted").when(F.col("_now") != F.col("_was"), "changed").otherwise("unchanged")
    return a.join(b, key, "full").select(key, state.alias("change"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new, and those of old without a row in new."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def consensus(a: DataFrame, b: DataFrame, keys: list[str], both: float = 0.85, one: float = 0.5) -> DataFrame:
    """Keys of two passes with the confidence of agreement."""
    x = a.select(*keys).distinct().withColumn("_a", F.lit(1)).join(b.select(*keys).distinct().withColumn("_b", F.lit(1)), keys, "full")
    return x.select(*keys, F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), both).otherwise(one).alias("confidence"))


def overlap_links(items: DataFrame, least: float) -> DataFrame:
    """(a, b, shared, strength): entities by the share of common items in the longer list. items: id, item.

    For each of its items an entity gets the larger ids of that item as one array, so pairs arise, are counted and are held
    against the entity's own size where its arrays lie; only those that reach `least` of that move on.
    """
    parts = shares(items)
    x = items.select("id", "item").repartition(parts, "item").distinct()
    size = x.groupBy("id").agg(F.count("*").alias("n"))
    ids = x.where("item is not null").groupBy("item").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    own = ids.select("ids", F.posexplode("ids").alias("i", "a")).where(F.col("i") + 1 < F.size("ids"))
    rest = own.select("a", F.slice("ids", F.col("i") + 2, F.size("ids")).alias("rest")).repartition(4 * parts, "a")
    p = rest.select("a", F.explode("rest").alias("b")).groupBy("a", "b").agg(F.count("*").alias("shared"))
    at = size.repartition(4 * parts, "id")
    p = p.join(at.select(F.col("id").alias("a"), F.col("n").alias("na")).hint("merge"), "a").where(F.col("shared") / F.col("na") >= least)
    j = p.join(size.select(F.col("id").alias("b"), F.col("n").alias("nb")), "b")
    return j.withColumn("raw", F.col("shared") / F.greatest("na", "nb")).where(F.col("raw") >= least).select("a", "b", "shared", F.round("raw", 4).alias("strength"))


def version_tuple(c: Column) -> Column:
    """Numbers of a version, which compare in order."""
    return F.transform(F.regexp_extract_all(c, F.lit("(\\d+)"), 1), lambda x: x.cast("int"))


def greedy_pack(df: DataFrame, group: str, order: list[str], cost: str, budget: int) -> DataFrame:
    """Bins of rows in order: a row goes into the open bin or opens the next one.

    That is sequential within a group, so a group is one task; its rows are sorted by Spark and
    pass in Arrow batches, of which one at a time is held.
    """
    from collections.abc import Iterator

    import pyarrow as pa
    from pyspark.sql import types as T

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, first, n, used = None, True, -1, 0
        for batch in batches:
            bins = []
            for g, c in zip(batch.column(group).to_pylist(), batch.column(cost).to_pylist()):
                if first or g != own:
                    own, first, n, used = g, False, -1, 0
                c = c or 0
                if n < 0 or (used + c > budget and used > 0):
                    n, used = n + 1, 0
                used += c
                bins.append(n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bins, pa.int32())], [*batch.schema.names, "bin"])

    schema = T.StructType([*df.schema.fields, T.StructField("bin", T.IntegerType())])
    return df.repartition(group).sortWithinPartitions(group, *order).mapInArrow(work, schema)


def link_plan(links: DataFrame, targets: list[tuple[str, list[str]]], connected: list[str]) -> DataFrame:
    """(url, target, status) of each link once: fetched by a connected tool, by one that is still to be connected, or by the agent."""
    low = F.lower("url")
    target = F.lit("web")
    for name, parts in reversed(targets):
        target = F.when(any_in(low, parts), name).otherwise(target)
    names = [n for n, _ in targets]
    return links.distinct().withColumn("target", target).withColumn("status", F.when(F.col("target").isin(*connected), "tool").when(F.col("target").isin(*names), "connect_needed").otherwise("agent_fetch"))


def re_exports(symbols: DataFrame, via: DataFrame) -> DataFrame:
    """(m, symbol) of what each module offers: its own, and all of the modules that it re-exports; via: via, m. To a fixed point, one join and one anti-join a round."""
    scratch = Scratch(symbols.sparkSession, "exports")
    via = scratch.keep(via)
    new = scratch.keep(symbols.select("m", "symbol").distinct())
    rounds = [new]
    while True:
        found = new.withColumnRenamed("m", "via").join(via, "via").select("m", "symbol").distinct()
        for old in rounds:
            found = found.join(old, ["m", "symbol"], "left_anti")
        new = scratch.keep(found)
        if new.isEmpty():
            break
        rounds.append(new)
    out = rounds[0]
    for x in rounds[1:]:
        out = out.unionByName(x)
    return out


def cluster_labels(names: DataFrame, generic: list[str]) -> DataFrame:
    """(cluster, label): the commonest second word of a cluster's names that is not generic, the last of equals."""
    w = names.select("cluster", F.split("name", " ")[1].alias("word")).where(~F.col("word").isin(*generic)).groupBy("cluster", "word").agg(F.count("*").alias("n"))
    return w.groupBy("cluster").agg(F.max_by("word", F.struct("n", "word")).alias("label"))


#: Pairs of a cell, about, and those of it that are counted at once.
CELL, AT_ONCE = 4 << 20, 2 << 20


def shared_groups(left: DataFrame, right: DataFrame) -> DataFrame:
    """(a, b, n): for each a of left(topic, id) and another b of right(topic, id) that share topics, how many; rows are distinct and whole numbers.

    There may be many times more pairs than rows, so no pair is shuffled: ids of both sides are dealt to blocks,
    so many that a pair of blocks, a cell, has about CELL pairs. A topic's ids of a block are sent, as one
    list, to the cells of that block, and a task counts cell after cell. So each row is sent once for every
    block of the other side, whose number grows with the root of the number of pairs.
    """
    sizes = left.groupBy("topic").agg(F.count("*").alias("n")).join(right.groupBy("topic").agg(F.count("*").alias("m")), "topic")
    pairs = sizes.agg(F.sum(F.col("n").cast("double") * F.col("m"))).first()[0] or 0.0
    n = max(1, math.ceil(math.sqrt(pairs / CELL)))
    tasks = min(n * n, 4096)

    def sent(rows: DataFrame, kind: int, i: str, j: str) -> DataFrame:
        lists = rows.groupBy("topic", F.pmod(F.xxhash64("id"), F.lit(n)).alias("block")).agg(F.array_sort(F.collect_list(F.col("id").cast("long"))).alias("ids"))
        lists = lists.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
        return lists.select((F.col(i) * n + F.col(j)).alias("cell"), F.col("topic").cast("long").alias("topic"), F.lit(kind).alias("kind"), "ids")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, topics = None, {}
        for batch in batches:
            for k, (c, topic, kind) in enumerate(zip(*(batch.column(x).to_pylist() for x in ("cell", "topic", "kind")))):
                if c != cell:
                    yield from _cell(topics.values())
                    cell, topics = c, {}
                topics.setdefault(topic, [None, None])[kind] = batch.column("ids")[k].values.to_numpy(zero_copy_only=False)
        yield from _cell(topics.values())

    dealt = sent(left, 0, "block", "other").unionByName(sent(right, 1, "other", "block")).withColumn("task", F.pmod("cell", F.lit(tasks)).cast("int"))
    return dealt.repartitionById(tasks, F.col("task")).sortWithinPartitions("cell", "topic").select("cell", "topic", "kind", "ids").mapInArrow(count, "a long, b long, n long")


def _cell(topics: Iterable[list]) -> Iterator[pa.RecordBatch]:
    """Counts of pairs (a, b) in topics, each two sorted lists; about AT_ONCE pairs are held, as a table where they fill one and else as sorted codes."""
    both = [x for x in topics if x[0] is not None and x[1] is not None]
    if not both:
        return
    ids_a, ids_b = (np.unique(np.concatenate([x[k] for x in both])) for k in (0, 1))
    both = [(np.searchsorted(ids_a, x), np.searchsorted(ids_b, y)) for x, y in both]
    many = np.zeros(len(ids_a), np.int64)
    for x, y in both:
        many[x] += len(y)
    before = np.cumsum(many) - many
    cuts = [*np.unique(before // AT_ONCE, return_index=True)[1].tolist(), len(ids_a)]
    width = len(ids_b)
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        some = [(x[np.searchsorted(x, lo) : np.searchsorted(x, hi)] - lo, y) for x, y in both]
        if (hi - lo) * width <= 8 * many[lo:hi].sum():
            table = np.zeros((hi - lo, width), np.int64)
            for x, y in some:
                table[np.ix_(x, y)] += 1
            a, b = np.nonzero(table)
            n = table[a, b]
        else:
            code, n = np.unique(np.concatenate([(x[:, None] * width + y).ravel() for x, y in some]), return_counts=True)
            a, b = code // width, code % width
        a, b = ids_a[lo + a], ids_b[b]
        apart = a != b
        yield pa.RecordBatch.from_arrays([pa.array(x[apart]) for x in (a, b, n)], ["a", "b", "n"])
