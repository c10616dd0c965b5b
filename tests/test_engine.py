import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.functions.geometry import Rect, boxes_touch
from lattica.operators import grids, kernels, layout, mesh, pixels, records, rectangles, transforms
from lattica.sources import images
from lattica.streaming.composite import streamed_composite

RECTS = "id int, min_y double, min_x double, max_y double, max_x double"


def test_touching_rectangles_do_not_overlap(spark):
    rows = [(1, 0.0, 0.0, 10.0, 5.0), (2, 4.99, 0.0, 7.99, 5.0), (3, -5.0, -5.0, 5.0, 5.0), (4, 4.0, 0.0, 5.0, 1.0), (5, 10.0, 10.0, 15.0, 20.0), (6, 10.0, 5.0, 12.0, 10.0), (7, None, 0.0, 1.0, 1.0), (8, 3.0, 3.0, 1.0, 9.0)]
    for size in (0.7, 4.0, 1000.0):
        assert sorted((r.a, r.b) for r in rectangles.overlapping_pairs(spark.createDataFrame(rows, RECTS), size).collect()) == [(1, 2), (1, 3), (1, 4), (2, 3), (2, 4), (3, 4)]
    z = [F.lit(float(v)) for v in (0, 0, 0, 1, 10, 5)]
    assert spark.range(1).select(boxes_touch(z, [F.lit(float(v)) for v in (1, 0, 0, 2, 1, 1)])).first()[0]


def test_rectangles_are_joined_without_a_broadcast(spark):
    t = spark.range(400).selectExpr("id", "id div 20 * 80.0D as min_y", "id % 20 * 80.0D as min_x", "id div 20 * 80.0D + 100 as max_y", "id % 20 * 80.0D + 100 as max_x")
    moved = t.withColumns({c: F.col(c) + F.when(F.col("id") == 0, -1000.0).otherwise(0.0) for c in ("min_y", "max_y")})
    delta = rectangles.pair_delta(rectangles.overlaps(t, 100.0), rectangles.overlaps(moved, 100.0))
    assert {r.state: r["count"] for r in delta.groupBy("state").count().collect()} == {"removed": 3, "unchanged": 2 * 20 * 19 + 2 * 19 * 19 - 3}
    delta.collect()
    plan = delta._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in plan and "Broadcast" not in plan


def test_overlap_shares(spark):
    a, b = Rect(*[F.lit(float(v)) for v in (0, 0, 10, 10)]), Rect(*[F.lit(float(v)) for v in (5, 5, 10, 20)])
    assert tuple(spark.range(1).select(a.overlap(b), a.overlap_normalized(b), b.overlap(a)).first()) == (0.25, 0.5, 25 / 75)


def test_safe_round_keeps_the_size(spark):
    r = Rect(F.lit(0.6), F.lit(-0.4), F.lit(2.2), F.lit(3.0)).safe_round()
    assert tuple(spark.range(1).select(*r.columns()).first()) == (0.0, -1.0, 2.0, 3.0)


def test_relaxing_reaches_the_offsets(spark):
    nodes = spark.createDataFrame([(0, 0.0, 0.0), (1, 3.0, 9.0), (2, -8.0, 2.0)], "id int, y double, x double")
    edges = spark.createDataFrame([(0, 1, 0.0, 10.0, 1.0), (0, 2, -10.0, 0.0, 0.5), (1, 2, -10.0, -10.0, 1.0)], "a int, b int, dy double, dx double, weight double")
    at = {r.id: (r.y, r.x) for r in layout.relax(nodes, edges, 0.01, 60).collect()}
    assert abs(at[1][0] - at[0][0]) < 0.1 and abs(at[1][1] - at[0][1] - 10) < 0.1 and abs(at[2][0] - at[0][0] + 10) < 0.1


def test_strongest_layout(spark):
    rng = np.random.default_rng(4)
    pos = rng.random((60, 2)) * 100
    edges = [(int(a), int(b), *(pos[b] - pos[a]).tolist(), float(w)) for a, b, w in zip(rng.integers(0, 50, 300), rng.integers(0, 50, 300), rng.random(300), strict=True) if a != b]
    edges += [(50, 51, *(pos[51] - pos[50]).tolist(), 0.5), (50, 51, 0.0, 0.0, math.nan)]
    nodes = spark.range(60).select(F.col("id").cast("int").alias("id"))
    placed, forest = layout.strongest_layout(nodes, spark.createDataFrame(edges, "a int, b int, dy double, dx double, weight double"))
    root = {r.id: r for r in placed.collect()}
    for i, r in root.items():
        assert np.allclose((r.y, r.x), pos[i] - pos[r.component], atol=1e-6)
    # Kruskal by hand
    part = list(range(60))
    find = lambda i: i if part[i] == i else find(part[i])
    total = 0.0
    for w, a, b in sorted(((e[4], e[0], e[1]) for e in edges if not math.isnan(e[4])), reverse=True):
        if find(a) != find(b):
            part[find(a)] = find(b)
            total += w
    assert abs(sum(r.weight for r in forest.collect()) - total) < 1e-9
    assert len({r.component for r in root.values()}) == len({find(i) for i in range(60)})


def test_components_of_a_chain(spark):
    edges = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"), F.lit(0.0).alias("dy"), F.lit(0.0).alias("dx"), F.lit(1.0).alias("weight")).filter("a <> 100")
    got = {r.id: r.component for r in layout.components(spark.range(202), edges).collect()}
    assert all(got[i] == (0 if i <= 100 else 101 if i <= 200 else 201) for i in got)


def test_composite_ties_and_stream(spark, tmp_path):
    rows = [("b", 0, 0, 5.0, 1.0), ("a", 0, 0, 3.0, 1.0), ("c", 0, 0, 9.0, 0.5), ("a", 0, 1, -2.0, 1.0), ("b", 0, 1, 4.0, 1.0)]
    df = spark.createDataFrame(rows, "key string, y int, x int, v double, dist double")
    assert sorted((r.x, r.v, r.key) for r in pixels.composite(df).collect()) == [(0, 9.0, "c"), (1, 0.0, "a")]
    df.write.parquet(str(tmp_path / "in"))
    q = streamed_composite(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("comp").start()
    q.processAllAvailable()
    assert spark.table("comp").count() == 2
    q.stop()


def test_rigid_round_trip(spark):
    p = spark.createDataFrame([(1, math.pi / 4, 1.0, 3.0, -2.0, 1.0, 0.0), (2, 0.7, 2.0, 0.0, 5.0, 4.0, 4.0)], "tf_id int, angle double, scale double, dy double, dx double, c_y double, c_x double")
    q = spark.createDataFrame([(t, i, float(i), float(i * i - 3)) for t in (1, 2) for i in range(5)], "tf_id int, q int, y double, x double")
    back = transforms.map_points(transforms.map_points(q, p), p, inverse=True)
    for a, b in zip(q.orderBy("tf_id", "q").collect(), back.orderBy("tf_id", "q").collect(), strict=True):
        assert np.allclose((a.y, a.x), (b.y, b.x))


def test_delaunay_and_maps():
    rng = np.random.default_rng(7)
    s = np.concatenate([rng.random((60, 2)) * 100, [[0, 0], [0, 100], [100, 0], [100, 100]]])
    tri = mesh.delaunay(s)
    area = lambda t: abs(np.cross(np.append(s[t[1]] - s[t[0]], 0), np.append(s[t[2]] - s[t[0]], 0))[2]) / 2
    assert abs(sum(map(area, tri)) - 10_000) < 1e-3
    affine = s @ np.array([[1.1, 0.2], [-0.3, 0.9]]) + [5, 6]
    q = rng.random((40, 2)) * 100
    want = q @ np.array([[1.1, 0.2], [-0.3, 0.9]]) + [5, 6]
    assert np.allclose(mesh.mesh_map(s, affine, q), want) and np.allclose(mesh.thin_plate(s, affine, q), want, atol=1e-4)
    far = np.array([[500.0, 500.0]])
    assert np.isnan(mesh.mesh_map(s, affine, far)).all() and np.allclose(mesh.mesh_or_plate(s, affine, far), far @ np.array([[1.1, 0.2], [-0.3, 0.9]]) + [5, 6], atol=1e-2)
    grid = np.array([[y, x] for y in range(5) for x in range(5)], float)
    assert np.allclose(mesh.mesh_map(grid, grid * 2, grid + 0.3)[:4], (grid[:4] + 0.3) * 2)


def test_phase_correlation_finds_the_shift():
    rng = np.random.default_rng(3)
    a = rng.random((64, 64))
    for dy, dx in ((0, 0), (5, -9), (-20, 11)):
        y, x, w = kernels.find_offset(a, np.roll(a, (-dy, -dx), (0, 1)))
        assert abs(y - dy) < 1 and abs(x - dx) < 1 and w > 0


def test_kernels():
    label, n = kernels.labelled(np.array([[1, 1, 0, 1], [0, 1, 0, 1], [1, 0, 0, 1]], bool))
    assert n == 3 and label.tolist() == [[1, 1, 0, 2], [0, 1, 0, 2], [3, 0, 0, 2]]
    m = kernels.overlap_mask((10, 10), (10, 10), (20, 20), 0.25, 1.0)
    assert m.shape == (20, 20) and (m == m[::-1]).all() and (m == m[:, ::-1]).all() and m[10, 10] and not m[0, 0]
    assert kernels.overlap_mask((4, 4), (4, 4), (8, 8), 0.0, 1.0) is None
    img = np.random.default_rng(1).random((20, 30))
    assert kernels.resized(img, 0.5).shape == (10, 15) and np.allclose(kernels.resized(img, 1.0), img)
    assert kernels.padded(img, 32, 32, 1)[6:26, 1:31].tolist() == img.tolist()
    assert kernels.feature_score(np.zeros((8, 8)), 4) == 0 and kernels.spectral_score(img) > 0


def test_nearest_control(spark):
    rng = np.random.default_rng(9)
    cp, q = rng.random((80, 2)) * 50, rng.random((60, 2)) * 300 - 100
    c = spark.createDataFrame([(1, i, float(y), float(x), 0.0, 0.0) for i, (y, x) in enumerate(cp)], "tf_id int, idx int, t_y double, t_x double, s_y double, s_x double")
    p = spark.createDataFrame([(1, i, float(y), float(x)) for i, (y, x) in enumerate(q)], "tf_id int, q int, y double, x double")
    got = {r.q: r.idx for r in transforms.nearest_control(p, c, 8.0).collect()}
    assert got == {i: int(((cp - v) ** 2).sum(1).argmin()) for i, v in enumerate(q)}


@pytest.mark.parametrize("bits", [8, 16])
def test_png_round_trip(spark, tmp_path, bits):
    px = np.random.default_rng(bits).integers(0, 2**bits, (7, 5)).astype(float)
    got, n = images.decode_png(images.encode_png(px, bits))
    assert n == bits and (got == px).all()
    df = spark.createDataFrame([("a.png", 7, 5, px.ravel().tolist())], "name string, h int, w int, data array<double>")
    assert images.write_files(images.encoded(df, bits), str(tmp_path)).count() == 1
    np.save(tmp_path / "b.npy", px)
    (tmp_path / "c.png").write_bytes(b"nothing")
    rows = {r.path[-5:]: r for r in images.read_images(spark, str(tmp_path)).collect()}
    assert rows["a.png"].data == px.ravel().tolist() and rows["b.npy"].h == 7 and rows["c.png"].error and rows["c.png"].data is None


def test_mosaic_and_stos_files(spark, tmp_path):
    (tmp_path / "m.mosaic").write_text("format_version_number: 1\nnumber_of_images: 3\npixel_spacing: 2\nimage:\nx/b.png\nRigid 1\nimage:\na.png\nGrid 2\nimage:\nb.png\nRigid 3\n")
    lines = records.read_text_files(spark, str(tmp_path))
    assert sorted((r.image, r.transform) for r in records.mosaic_entries(lines).collect()) == [("a.png", "Grid 2"), ("b.png", "Rigid 3")]
    h = records.mosaic_header(lines).first()
    assert (h.format_version, h.pixel_spacing, h.images) == (1, 2, 3)
    text = records.mosaic_text(records.mosaic_entries(lines)).first().text
    assert text.index("a.png") < text.index("b.png")
    old = spark.createDataFrame([("o", i, x) for i, x in enumerate(["image: d/t1.png Rigid 1 2", "image: t1.png Mesh", "other: x"])], "path string, line_no int, line string")
    assert [(r.image, r.transform) for r in records.mosaic_entries(old).collect()] == [("t1.png", "Mesh")]
    short = spark.createDataFrame([("s", i, "x") for i in range(6)], "path string, line_no int, line string")
    assert records.stos_fields(short).count() == 0
    hist = spark.createDataFrame([("h", 0, " 5: (3,3,3) #030303 gray"), ("h", 1, "junk"), ("h", 2, "2: (3,0,0) #x")], "path string, line_no int, line string")
    assert [tuple(r) for r in records.histogram_lines(hist).collect()] == [("h", 3, 7)]


def test_small_helpers():
    assert grids.roi_range(-3, 5, 10) == (0, 5) and grids.roi_range(8, 5, 10) == (5, 10) and grids.roi_range(0, 11, 10) is None
    assert grids.constrained_range(8, 5, 10) == (8, 10) and grids.next_power(65) == 128


def test_converting_images(spark):
    df = spark.createDataFrame([("a", 2, 2, 8, [0.0, 255.0, 51.0, 102.0]), ("b", 3, 2, 8, [1.0])], "name string, h int, w int, bpp int, data array<double>")
    got = {r.name: r for r in kernels.converted(df, 8, flip=True, invert=True).collect()}
    assert got["a"].data == [204.0, 153.0, 255.0, 0.0] and got["b"].error and got["b"].data is None
    with pytest.raises(ValueError):
        kernels.converted(df, 8, levels=(0.5, 0.5))


def test_written_tables_can_be_dropped(spark):
    from lattica.sources.tables import drop_materialized, materialize

    df = materialize(spark.range(5))
    assert df.count() == 5
    assert drop_materialized(spark) >= 1 and drop_materialized(spark) == 0


def test_windowed_stream(spark, tmp_path):
    from lattica.streaming.composite import windowed_stats

    rows = spark.createDataFrame([("a", "2021-01-01 10:00:00", 1.0), ("a", "2021-01-01 20:00:00", 3.0), ("b", "2021-01-02 01:00:00", None)], "k string, t string, v double").selectExpr("k", "cast(t as timestamp) t", "v")
    rows.write.parquet(str(tmp_path / "in"))
    q = windowed_stats(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "t", "v", "k").writeStream.outputMode("update").format("memory").queryName("win").start()
    q.processAllAvailable()
    assert sorted((r.k, r.n, r["mean"]) for r in spark.table("win").collect()) == [("a", 2, 2.0), ("b", 0, None)]
    q.stop()


def test_local_rigid_of_a_turn(spark):
    a = 0.4
    src = [(float(y), float(x)) for y in (0, 50, 100) for x in (0, 50, 100)]
    turn = lambda y, x: (math.cos(a) * y - math.sin(a) * x + 5, math.sin(a) * y + math.cos(a) * x - 3)
    cp = spark.createDataFrame([(1, i, *turn(*p), *p) for i, p in enumerate(src)], "tf_id int, idx int, t_y double, t_x double, s_y double, s_x double")
    q = spark.createDataFrame([(1, 0, *turn(40.0, 60.0))], "tf_id int, q int, y double, x double")
    r = mesh.local_rigid(q, cp).first()
    assert abs(abs(r.angle) - a) < 1e-6 and abs(r.c_y - 40) < 1e-6 and abs(r.c_x - 60) < 1e-6


def test_each_transform_is_fitted_once(spark, tmp_path, monkeypatch):
    def fit(source, target):
        with (tmp_path / "fits").open("a") as f:
            f.write(f"{len(source)}\n")
        return source, target

    monkeypatch.setitem(mesh.FITS, mesh.mesh_map, (fit, lambda fitted, q: q + (fitted[1] - fitted[0])[0]))
    cp = spark.createDataFrame([(t, i, y + (t or 0), x, y, x) for t in (1, 2, 9, None) for i, (y, x) in enumerate([(0.0, 0.0), (0.0, 9.0), (9.0, 0.0), (9.0, 0.0)])] + [(3, 0, 1.0, 1.0, 0.0, 0.0)], "tf_id int, idx int, t_y double, t_x double, s_y double, s_x double")
    q = spark.range(0, 60_000, 1, 4).selectExpr("nullif(cast(id % 5 as int), 4) as tf_id", "id as q", "cast(id as double) as y", "2.0D as x")
    got = mesh.map_by(q, cp, mesh.mesh_map).toPandas()
    assert (tmp_path / "fits").read_text().split() == ["3"] * 3
    assert got.groupby("tf_id").size().to_dict() == {1: 12_000, 2: 12_000, 3: 12_000} and got.q.is_unique
    known = got[got.tf_id < 3]
    assert (known.y == known.q + known.tf_id).all() and (known.x == 2).all() and got[got.tf_id == 3].y.isna().all()


def _strip(n):
    """Control points of a long strip: sources, and targets turned by 0.4."""
    rng = np.random.default_rng(5)
    src = np.column_stack([np.arange(n) * 25.0, rng.integers(0, 10, n) * 10.0])
    a = 0.4
    return src, src @ np.array([[math.cos(a), math.sin(a)], [-math.sin(a), math.cos(a)]]) + [5, -3]


def test_a_grid_over_a_long_mesh_is_whole():
    src, dst = _strip(400)
    assert np.abs(mesh.thin_plate(src, dst + src % 7, src) - dst - src % 7).max() < 1e-6
    grid = np.stack(np.meshgrid(np.arange(400) * 25.0, np.arange(5) * 25.0, indexing="ij"), axis=-1).reshape(-1, 2)
    a = 0.4
    want = grid @ np.array([[math.cos(a), math.sin(a)], [-math.sin(a), math.cos(a)]]) + [5, -3]
    assert np.abs(mesh.mesh_or_plate(src, dst, grid) - want).max() < 1e-6


def test_a_grid_over_far_control_points_is_whole(spark, tmp_path):
    from lattica.plans.registry import queries

    keys = [(1, 0), (15, 0), (6_000_008, 0), (3, 1), (7, None)]
    spark.createDataFrame([(k, t, 0.0) for k, t in keys], "s_suppkey bigint, s_nationkey int, s_acctbal double").write.parquet(str(tmp_path / "supplier.parquet"))
    got = queries()["grid_resample"](spark, str(tmp_path)).groupBy("tf_id").agg(F.count("*"), F.count_distinct("cell"), F.max("cell"), F.max(F.abs(F.col("y") - F.expr("cell div 10000 * 25"))))
    zero, one = sorted(got.collect())
    assert tuple(zero)[:4] == (0, 240_001 * 4, 240_001 * 4, 2_400_000_003) and zero[4] < 0.01
    assert tuple(one)[:4] == (1, 1, 1, 0)


def test_grids_and_assembling_empty_tables(spark):
    none = spark.createDataFrame([], "id int, h int, w int")
    assert grids.edge_grid(none, 10.0).count() == grids.centred_grid(none, 10.0).count() == 0
    px = spark.createDataFrame([], "image_id int, y int, x int, v double")
    assert pixels.image_stats(px).count() == pixels.normalised(px).count() == pixels.histogram(px, 4, 0.0, 1.0).count() == 0
    rects = spark.createDataFrame([], RECTS)
    assert rectangles.overlapping_pairs(rects, 1.0).count() == 0
    nodes = spark.createDataFrame([], "id int, y double, x double")
    edges = spark.createDataFrame([], "a int, b int, dy double, dx double, weight double")
    assert layout.relax_step(nodes, edges).count() == layout.components(nodes.select("id"), edges).count() == layout.strongest_layout(nodes.select("id"), edges)[0].count() == 0
