from types import SimpleNamespace

from lagwise.operators import sets
from lagwise.plans.catalog import joins


def test_semi_and_anti_deal_both_sides_alike(spark, monkeypatch):
    monkeypatch.setattr(sets.dealt_alike, "__defaults__", (10,))
    tables = {
        "orders": spark.createDataFrame([(i,) for i in range(40)] + [(None,), (1,)], "o_orderkey long"),
        "lineitem": spark.createDataFrame([(i,) for i in range(0, 60, 2)] + [(4,), (None,)], "l_orderkey long"),
    }
    out = joins.semi_and_anti(SimpleNamespace(table=tables.__getitem__))
    got = sorted((-1 if r[0] is None else r[0], r[1]) for r in out.collect())
    assert got == sorted([(i, "missing" if i % 2 else "with_children") for i in range(40)] + [(-1, "missing"), (1, "missing")])
    assert "RepartitionByExpression" in out._jdf.queryExecution().optimizedPlan().toString()
