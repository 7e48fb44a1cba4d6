"""Each query against its SQL at the smallest scale, where the tables are there."""

import glob
import os

import pytest

import __spark_entry__
from graphloom import catalog

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")


def test_names():
    assert set(catalog.oracle_sql()) <= set(catalog.queries()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, name):
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    found = con.execute(catalog.oracle_sql()[name])
    names = [c[0] for c in found.description]
    got = catalog.queries()[name](spark, DIR)
    assert sorted(got.columns) == sorted(names)
    rows = sorted((tuple(r[c] for c in names) for r in got.collect()), key=repr)
    assert rows == sorted(found.fetchall(), key=repr)


def test_no_row_is_left_out(spark):
    """Jumps and stars have the edges of every order; a jump that would end beyond the last order is none."""
    orders = spark.read.parquet(f"{DIR}/orders.parquet").collect()
    n, customers = len(orders), spark.read.parquet(f"{DIR}/customer.parquet").count()
    jumps = [(r.o_orderkey, r.o_orderkey + 1 + j % (n // 12)) for r in orders for j in (r.o_custkey, int(r.o_totalprice))]
    assert sorted((r.src, r.tgt) for r in catalog.jump_graph(spark, DIR).edges.collect()) == sorted(e for e in jumps if e[1] < n)
    assert sorted((r.src, r.tgt) for r in catalog.star_graph(spark, DIR).edges.collect()) == sorted((r.o_custkey, customers + r.o_orderkey) for r in orders)


@pytest.mark.parametrize("name, whole", [("adjacency_edges_whole", "orders"), ("cc_whole", "orders"), ("cc_suppliers", "lineitem")])
def test_whole_tables_are_read(spark, name, whole):
    """Every row of the table takes part: against the edges of all its rows, by hand."""
    got = catalog.queries()[name](spark, DIR).collect()
    graph = catalog.customer_graph(spark, DIR) if whole == "orders" else catalog.supplier_graph(spark, DIR)
    edges = [(r.src, r.tgt) for r in graph.edges.select("src", "tgt").collect()]
    assert len(edges) == spark.read.parquet(f"{DIR}/{whole}.parquet").count()
    if name.startswith("adjacency"):
        assert sorted((r.src, r.tgt) for r in got) == sorted(edges)
        return
    label, last = list(range(graph.n)), None
    while label != last:
        last = list(label)
        for s, t in edges:
            label[t] = min(label[t], label[s])
    assert {r.id: r.value for r in got} == dict(enumerate(label))
    assert name != "cc_suppliers" or len(set(label)) > 1
