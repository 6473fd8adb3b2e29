"""Findings of the fourth round."""

import pytest
from test_findings_r03 import same  # noqa: F401

from graphmill.operators import relational


@pytest.mark.parametrize("at_once", [relational.AT_ONCE, 40])
def test_topic_pairs_meet_in_cells(same, spark, monkeypatch, at_once):  # noqa: F811
    """Users of a topic meet in cells: the pairs are those of the SQL, and none is shuffled."""
    monkeypatch.setattr(relational, "CELL", 2_000)
    cell = relational._cell

    def small(topics):
        relational.AT_ONCE = at_once
        return cell(topics)

    monkeypatch.setattr(relational, "_cell", small)
    values = "select i as event_id, timestamp '2024-01-01' + to_seconds((hash(i) % 20000)::bigint) as ts, case when i % 97 > 0 then (hash(i, 1) % 150)::bigint end as user_id, ['signup', 'purchase', 'view'][1 + (hash(i, 2) % 3)::bigint] as event_type, 1.0::double as value, '' as props from range(1500) x(i)"
    store = spark.sparkContext._jsc.sc().statusStore
    written = lambda: (lambda e: sum(e.apply(i).totalShuffleWrite() for i in range(e.size())))(store().executorList(True))
    before = written()
    rows = same("j3_topic_channels", events=values)
    assert len(rows) > 10_000 and max(n for _, _, n in rows) > 1
    assert written() - before < 8 * len(rows)
