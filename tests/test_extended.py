import numpy as np
from pyspark.sql import functions as F

from lattica.operators import layout, mesh, sections, transforms


def test_multiquadric_meets_its_points():
    rng = np.random.default_rng(1)
    s, t = rng.random((12, 2)) * 50, rng.random((12, 2)) * 50
    assert np.allclose(mesh.multiquadric(s, t, s), t, atol=1e-6)


def test_nearest_far_from_all(spark):
    rng = np.random.default_rng(2)
    cp = [(k % 2, k, float(y), float(x)) for k, (y, x) in enumerate(rng.random((40, 2)) * 100)] + [(0, 99, float("nan"), 1.0)]
    q = [(k % 3, k, float(y), float(x)) for k, (y, x) in enumerate(rng.random((60, 2)) * 20_000 - 9_000)] + [(0, 900, None, 1.0)]
    have = spark.createDataFrame(cp, "tf_id int, idx int, t_y double, t_x double")
    got = {(r.tf_id, r.q): r.idx for r in transforms.nearest_control(spark.createDataFrame(q, "tf_id int, q int, y double, x double"), have, 10.0).collect()}
    want = {(t, k): min((np.hypot(y - c[2], x - c[3]), c[1]) for c in cp if c[0] == t and c[1] != 99)[1] for t, k, y, x in q if t < 2 and k != 900}
    assert got == want


def test_chain_of_parts(spark):
    placed = spark.createDataFrame([(k, k // 2, float(k * 10 + k // 2 * 7), 0.0) for k in range(8)], "id bigint, part bigint, y double, x double")
    offsets = spark.createDataFrame([(k, k + 1, 10.0, 0.0) for k in range(7)], "a bigint, b bigint, dy double, dx double").withColumn("weight", F.lit(1.0))
    got = {r.id: (r.part, r.y) for r in layout.merge_all_parts(placed, offsets).collect()}
    assert got == {k: (0, k * 10.0) for k in range(8)}


def test_deep_tree(spark):
    pairs = spark.createDataFrame([(k, k - 1) for k in range(1, 31)], "mapped int, control int")
    assert {r.section: r.depth for r in sections.tree_depth(pairs).collect()} == {k: k for k in range(31)}


def test_edits_with_ties_and_nulls(spark):
    cp = spark.createDataFrame([(1, 1, 1.0, 1.0, 1.0, 1.0), (1, 2, 2.0, 2.0, 2.0, 2.0)], "tf_id int, idx int, t_y double, t_x double, s_y double, s_x double")
    e = spark.createDataFrame([(1, 1, "put", 9.0, None, None, None), (1, 2, "put", 3.0, 3.0, 3.0, 3.0), (1, 2, "remove", None, None, None, None), (1, 3, "put", 4.0, 4.0, 4.0, 4.0)], "tf_id int, idx int, action string, t_y double, t_x double, s_y double, s_x double")
    assert sorted(tuple(r) for r in transforms.edited(cp, e).collect()) == [(1, 1, 9.0, 1.0, 1.0, 1.0), (1, 3, 4.0, 4.0, 4.0, 4.0)]
    assert transforms.edited(cp.limit(0), e.limit(0)).count() == 0
