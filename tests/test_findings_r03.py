"""Findings of the third round: queries against their SQL on tables that show the fault."""

import duckdb
import pytest

from graphmill.operators import graph, memory, relational
from graphmill.operators.scratch import DEALT, shares
from graphmill.plans.queries import ORACLE_SQL, QUERIES
from test_queries import plain


@pytest.fixture
def same(spark, tmp_path):
    """Whether a query gives the rows of its SQL over the given tables, made by SQL; returns the rows."""

    def run(name, **tables):
        c = duckdb.connect()
        for t, sql in tables.items():
            c.execute(f"copy ({sql}) to '{tmp_path}/{t}.parquet' (format parquet)")
            c.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet'")
        df = QUERIES[name](spark, str(tmp_path))
        columns = sorted(df.columns)
        got = sorted([tuple(map(plain, r)) for r in df.select(*columns).collect()], key=repr)
        want = c.sql(f"select {', '.join(columns)} from ({ORACLE_SQL[name]})").fetchall()
        assert got == sorted([tuple(map(plain, r)) for r in want], key=repr)
        return got

    return run


def test_topics_round_seconds(same):
    """The last half second of an hour belongs to the next one; an exact half goes to the even second."""
    rows = "('2024-01-01 00:59:59.6', 1, 'signup'), ('2024-01-01 01:10:00', 2, 'purchase'), ('2024-01-01 01:59:59.5', 3, 'signup'), ('2024-01-01 02:00:00.5', 4, 'purchase'), ('2024-01-01 02:59:59.4', 5, 'purchase'), ('2024-01-01 03:00:00', 6, 'signup')"
    events = f"select row_number() over () as event_id, ts::timestamp as ts, u::bigint as user_id, e as event_type, 1.0::double as value, '' as props from (values {rows}) x(ts, u, e)"
    assert (1, 2, 1) in [(p, s, n) for p, s, n in same("j3_topic_channels", events=events)]


def test_components_reach_over_suppliers(same):
    """Orders of different customers are connected by a supplier, whatever the quantity and discount of their lines."""
    orders = "select * from (values (1::bigint, 1::bigint), (2, 2), (3, 2), (4, 3), (9, 5)) x(o_orderkey, o_custkey)"
    lines = "select k::bigint as l_orderkey, s::bigint as l_suppkey, 1.0::double as l_quantity, 0.0::double as l_discount from (values (1, 10), (3, 10), (4, 11), (8, 12)) x(k, s)"
    got = {i: c for c, i in same("g18_components", orders=orders, lineitem=lines)}
    assert [got[i] for i in (1, 2, 3, 4, 8, 9)] == [1, 1, 1, 4, 8, 9]


def test_siblings_up_to_a_number(spark):
    """Counts that stop to matter are those of all pairs, cut; a large meeting makes no pairs."""
    import random

    rng = random.Random(5)
    rows = [(i, i % 3, [rng.randrange(30) for _ in range(rng.randrange(4))]) for i in range(60)]
    e = spark.createDataFrame(rows, "id long, pattern long, citations array<long>")
    every = {r.id: r.siblings for r in memory.siblings(e).collect()}
    assert len(every) > 20 and max(every.values()) > 4 > min(every.values())
    assert {r.id: r.siblings for r in memory.siblings(e, 4).collect()} == {k: min(v, 4) for k, v in every.items()}
    crowd = spark.range(200_000).selectExpr("id", "0L as pattern", "array(1L) as citations")
    assert [tuple(r) for r in memory.siblings(crowd, 6).groupBy("siblings").count().collect()] == [(6, 200_000)]


def test_shares_grow_with_rows(spark):
    assert shares(spark.range(0)) == 1 and shares(spark.range(DEALT), spark.range(1)) == 2


@pytest.mark.parametrize("name", ["j2_cooccurrence", "j6_file_overlap", "a12_cochange", "g17_graph_diff", "st12_freshness", "g21_graph_build", "j8_endpoint_repair", "x14_deepest_ancestor"])
def test_tasks_stay_small(spark, sf_dir, name):
    """Groups are dealt to as many tasks as the rows need, which adaptive execution doesn't join to larger ones."""
    assert "REPARTITION_BY_NUM" in QUERIES[name](spark, sf_dir)._jdf.queryExecution().toString()


def test_diff_takes_nulls_as_alike(spark):
    old, new = (spark.createDataFrame(x, "a long, b long") for x in ([(None, 1), (None, 1), (1, 2), (3, None)], [(None, 1), (1, 2), (1, 3)]))
    assert sorted(map(repr, (tuple(r) for r in graph.graph_diff(old, new, ["a", "b"]).collect()))) == ["(1, 3, 'added')", "(3, None, 'removed')"]


def test_overlaps_with_missing_items(spark):
    """A missing item counts for the length of a list and is shared with none; repeated rows count once."""
    rows = [(1, 1), (1, 1), (1, 2), (2, 1), (2, 2), (2, None), (3, 2), (3, 7), (3, 8), (3, 9), (4, None), (None, 1)]
    got = relational.overlap_links(spark.createDataFrame(rows, "id long, item long"), 0.3)
    assert sorted(map(tuple, got.collect())) == [(1, 2, 2, 0.6667)]


def test_fold_has_one_timer():
    """However many events of an entry wait, there is one timer, at the earliest; it moves on with what is folded."""
    import pandas as pd

    from graphmill.streaming.stateful import _Ordered

    class Held:
        def __init__(self):
            self.rows, self.value, self.timers = [], None, set()
            self.appendList, self.get, self.put = self.rows.extend, lambda: list(self.rows), self._put
            self.listTimers, self.registerTimer, self.deleteTimer = lambda: iter(set(self.timers)), self.timers.add, self.timers.discard

        def _put(self, rows):
            self.rows[:] = rows

        getListState = lambda self, *_: self

        def getValueState(self, *_):  # noqa: N802
            class Value:
                get = lambda _: self.value
                update = lambda _, x: setattr(self, "value", x)

            return Value()

        clear = lambda self: self.rows.clear()

    class Now:
        getCurrentWatermarkInMs = lambda self: 6

    held, fold = Held(), _Ordered()
    fold.init(held)
    for at in ([9000, 5000, 7000], [3000, 8000]):
        list(fold.handleInputRows((1,), iter([pd.DataFrame({"at": at, "id": at, "kind": "verify"})]), None))
    assert held.timers == {4}
    held.timers.clear()  # Spark drops a timer that has expired
    (told,) = fold.handleExpiredTimer((1,), Now(), None)
    assert told.values.tolist() == [[1, 5000, 2, 0, 0.5]] and held.timers == {8} and len(held.rows) == 3


def test_short_cycles_by_joins(spark, monkeypatch):
    """Cycles of up to three nodes need no search for components; longer ones are still found."""
    e = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (3, 1), (3, 4), (4, 1), (5, 6)], "source long, target long")
    found = lambda n: sorted(tuple(r.cycle) for r in graph.cycles(e, n).collect())
    assert found(4) == [(1, 2), (1, 2, 3), (1, 2, 3, 4)]
    monkeypatch.setattr(graph, "strongly_connected", None)
    assert found(3) == [(1, 2), (1, 2, 3)]


def test_names_take_no_broadcast(spark, sf_dir, monkeypatch):
    """Names of modules grow with the modules, so no join sends them through the driver."""
    from graphmill.operators.scratch import Scratch

    plans, keep = [], Scratch.keep
    monkeypatch.setattr(Scratch, "keep", lambda self, df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or keep(self, df))
    QUERIES["x12_resolved_names"](spark, sf_dir)
    assert len(plans) > 5 and not [p for p in plans if "BroadcastHashJoin" in p]


def test_pages_by_line(spark, tmp_path):
    """A file may hold a page on each line; lines that are no page, or cut off, give none."""
    from graphmill.sources import findings as fd

    page = lambda *keys: '{"issues": [' + ", ".join(f'{{"key": "{k}", "line": 1}}' for k in keys) + "]}"
    texts = [page("a"), page("b", "c") + "\n" + page("d")[:-9] + "\n[1]\n" + page("e") + "\n", "{\n" + page("f")[1:-1] + "\n}", page("g")[:-3]]
    for i, x in enumerate(texts):
        (tmp_path / f"{i}.txt").write_text(x)
    df = fd.findings(spark, str(tmp_path))
    assert sorted(r.key for r in df.collect()) == ["a", "b", "c", "e", "f"]


def test_pagerank_links_are_dealt(spark, monkeypatch):
    """Links are dealt by source in a number of tasks that grows with them; long lists are cut; nodes that only edges name get no row."""
    from graphmill.operators.scratch import Scratch

    plans, keep = [], Scratch.keep
    monkeypatch.setattr(Scratch, "keep", lambda self, df: plans.append(df._jdf.queryExecution().toString()) or keep(self, df))
    pairs = [(1, 2), (1, 2), (1, 3), (2, 3), (3, 1), (3, 4), (4, 4), (4, 9), *((5, x) for x in range(10, 40))]
    nodes, edges = spark.range(1, 30).toDF("id"), spark.createDataFrame(pairs, "source long, target long")
    monkeypatch.setattr(graph, "CHUNK", 4)
    got = {r.id: r.pagerank for r in graph.pagerank(nodes, edges).collect()}
    assert any("REPARTITION_BY_NUM" in p and "targets" in p for p in plans)
    n, e = 29, [p for p in pairs if p[0] != p[1]]
    out = {s: sum(a == s for a, _ in e) for s, _ in e}
    rank = dict.fromkeys(range(1, 30), 1 / n)
    for _ in range(20):
        lost = sum(r for i, r in rank.items() if i not in out)
        rank = {i: 0.15 / n + 0.85 * lost / n + 0.85 * sum(rank[a] / out[a] for a, b in e if b == i) for i in rank}
    assert got.keys() == rank.keys() and all(abs(got[i] - r / max(rank.values())) < 1e-9 for i, r in rank.items())
