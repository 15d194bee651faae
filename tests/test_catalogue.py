"""Every registered query of the library against its DuckDB counterpart."""

import math

import duckdb
import pytest

from graphloom.plans import catalogue

DATA = "/root/testdata/sf0.001"


def rows(columns, data):
    def plain(v):
        return float(f"{v:.9g}") if isinstance(v, float) and not math.isnan(v) else v

    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, name):
    made = catalogue.queries()[name](spark, DATA)
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for table in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "pages", "documents"):
        con.execute(f"create view {table} as select * from '{DATA}/{table}.parquet'")
    wanted = con.execute(catalogue.oracle_sql()[name])
    assert rows(made.columns, made.collect()) == rows([c[0] for c in wanted.description], wanted.fetchall())


def test_scans_are_pruned(spark):
    """A pattern reads the tables that have its predicate, with its constants pushed down."""
    plan = catalogue.queries()["bgp_star_topk"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    # price, priority and placedBy of orders; labels of regions, nations, customers, suppliers and parts
    assert plan.count("Relation [") <= 8 and "Generate" not in plan
    physical = catalogue.queries()["bgp_star_topk"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderpriority,1-URGENT)" in physical
    empty = catalogue.queries()["bgp_not_exists"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "lineitem" not in empty
