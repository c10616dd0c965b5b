from pyspark.sql import functions as F

from lattica.operators import layout
from lattica.plans import reference


def test_the_query_relaxes_until_no_tension_is_left(spark, monkeypatch):
    nodes = spark.createDataFrame([(k, 0.0, 10.0 * k + (60.0 if k >= 3 else 0.0)) for k in range(6)], "id bigint, y double, x double")
    edges = spark.createDataFrame([(k, k + 1, 0.0, 10.0, 1.0) for k in range(5)], "a bigint, b bigint, dy double, dx double, weight double")
    monkeypatch.setattr(reference.V, "nodes", lambda *_: nodes)
    monkeypatch.setattr(reference.V, "edges", lambda *_: edges)
    found = reference.relax_converged(spark, "")
    assert layout.tensions(found, edges).agg(F.max(F.hypot("weighted_y", "weighted_x"))).first()[0] <= 0.11
