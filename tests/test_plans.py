"""What the queries' plans read and shuffle."""

from spanlake.operators import graph
from spanlake.plans import base, sampling

SMALL = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _windowed(node):
    """The columns that go into the lowest window of a plan."""
    below = [_windowed(node.children().apply(i)) for i in range(node.children().size())]
    found = next((x for x in below if x), None)
    own = node.child().output() if node.nodeName() == "Window" else None
    return found or (own and {own.apply(i).name() for i in range(own.size())})


def test_attributes_stay_behind(spark):
    """Attributes that no column of the result needs aren't shuffled for the dedupe."""
    for rows in (base.base_red(spark, SMALL), base.base_traces(spark, SMALL)):
        columns = _windowed(rows._jdf.queryExecution().optimizedPlan())
        assert "is_error" in columns and "attrs" not in columns


def test_decisions_read_spans_once_for_each_use(spark):
    """Traces are rolled up and signed once, though rare ones are looked for among all; tenants are read without dedupe."""
    plan = _plan(sampling.decisions(spark, SMALL))
    assert "MapInArrow" not in plan and plan.count("row_number") < 10
    assert "row_number" not in _plan(sampling.predicates(spark, SMALL))


def test_distances_read_edges_once(spark):
    edge = spark.createDataFrame([("t", "a", "b"), ("t", "b", "c"), ("t", "c", "d")], "tenant string, caller string, callee string")
    found = graph.distances(edge.repartition(2), hops=2)
    assert "Repartition" not in _plan(found)
    assert {(r.service, r.other): r.hops for r in found.where("service = 'a'").collect()} == {("a", "a"): 0, ("a", "b"): 1, ("a", "c"): 2}
