"""Every query with SQL gives the rows of its SQL; the others run."""

import decimal

import duckdb
import pytest

from graphmill.plans.queries import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or isinstance(v, bool):
        return v
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 9)
    return v if isinstance(v, int) else str(v)


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted([tuple(map(plain, r)) for r in df.select(*columns).collect()], key=repr)
    want = duck.sql(ORACLE_SQL[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert got == sorted([tuple(plain(r[i]) for i in at) for r in want.fetchall()], key=repr)


#: Columns of the queries that SQL can't express; tests/test_operators.py holds their operators against brute force.
OTHERS = {
    "arr1_dimension_merge": {"conv_id", "turn", "dims"},
    "er4_verified_pairs": {"a", "b", "score"},
    "er_entity_chain": {"old", "new"},
    "f8_ignored_paths": {"path", "ignored"},
    "g11_communities": {"id", "community", "n"},
    "g11_label_propagation": {"id", "community"},
    "g13_community_remap": {"community", "final"},
    "g1c_betweenness": {"id", "betweenness"},
    "g1d_importance": {"id", "importance"},
    "g2_important_nodes": {"id", "importance"},
    "g7_cycles": {"id", "component"},
    "str19_ui_text": {"page_id", "ui_text"},
    "w12_greedy_matching": {"new", "kept_as"},
    "w13_first_fit_chunks": {"doc_id", "source", "n_chars", "bin"},
}


def test_others_are_known():
    assert set(OTHERS) == set(QUERIES) - set(ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(OTHERS))
def test_others(spark, sf_dir, name):
    """Rows, their columns and what must hold of them whatever the tables are."""
    df = QUERIES[name](spark, sf_dir)
    assert set(df.columns) == OTHERS[name]
    rows = df.collect()
    assert rows
    if "importance" in df.columns or "betweenness" in df.columns:
        value = [x[-1] for x in rows]
        assert all(0 <= v <= 1 for v in value) and max(value) > 0
    if name == "er4_verified_pairs":
        assert all(x.a < x.b and 0.85 <= x.score <= 1 for x in rows)
    if name == "g11_communities":
        from graphmill.operators import community, graph
        from graphmill.plans import codegraph

        e = codegraph.edges(spark, sf_dir).withColumn("weight", 1 + 2 * codegraph.F.col("confidence_score"))
        own = spark.createDataFrame(rows).select("id", "community")
        assert community.modularity(own, e) >= community.modularity(graph.label_propagation(e), e) > -1
        sizes = [n for _, n in sorted({(x.community, x.n) for x in rows})]
        assert sizes == sorted(sizes, reverse=True) and sum(sizes) == len(rows)
    if name == "f8_ignored_paths":
        from test_rules_symbols import brute_ignored

        from graphmill.plans.structure import RULE_FILES

        assert {x.path: x.ignored for x in rows} == {x.path: brute_ignored(x.path, dict(RULE_FILES)) for x in rows} and len({x.ignored for x in rows}) == 2
    if name == "er_entity_chain":
        assert all(x.old != x.new for x in rows) and not {x.old for x in rows} & {x.new for x in rows}
    if name == "g13_community_remap":
        assert len({x.final for x in rows}) == len({x.community for x in rows}) == len(rows)
    if name == "w13_first_fit_chunks":
        cost = {}
        for x in rows:
            cost.setdefault((x.source, x.bin), []).append(x.n_chars or 0)
        assert all(sum(v) <= 20_000 or len(v) == 1 for v in cost.values())
