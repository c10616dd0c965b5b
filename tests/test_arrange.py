import numpy as np

from lattica.operators import assemble, refine
from lattica.operators.arrange import arrange


def smooth(h, w, seed):
    v = np.random.default_rng(seed).random((h, w))
    return sum(np.roll(v, s, a) for s in (-1, 0, 1) for a in (0, 1))


def test_arranged_tiles_find_their_places(spark):
    whole = smooth(150, 150, 1)
    true = {i: (40 * (i // 3), 40 * (i % 3)) for i in range(9)}
    rng = np.random.default_rng(2)
    images = spark.createDataFrame([(i, 64, 64, whole[y : y + 64, x : x + 64].ravel().tolist()) for i, (y, x) in true.items()], "image_id bigint, h int, w int, data array<double>")
    tiles = spark.createDataFrame([(i, float(y + rng.integers(-4, 5)), float(x + rng.integers(-4, 5)), 64.0, 64.0) for i, (y, x) in true.items()], "id bigint, y double, x double, h double, w double")
    got = {r.id: (r.y, r.x) for r in arrange(tiles, images, 64.0, passes=2, first_excess=1.5).collect()}
    for i, (y, x) in true.items():
        assert abs(got[i][0] - got[0][0] - y) < 1.5 and abs(got[i][1] - got[0][1] - x) < 1.5
    assert arrange(tiles.limit(1), images, 64.0).count() == 1


def test_refining_a_shift():
    whole = smooth(140, 140, 5)
    fixed, moving = whole[:128, :128], whole[3:131, 5:133]
    corners = np.array([[0, 0], [0, 127], [127, 0], [127, 127]], float)
    out = refine.refine(fixed, moving, np.column_stack([corners, corners]), 32, 32, 4)
    assert np.abs(np.median(out[:, :2] - out[:, 2:], axis=0) - [3, 5]).max() < 0.7


def test_enriching():
    s = np.array([[0, 0], [0, 10], [10, 0], [10, 10], [5, 5]], float)
    bent = np.column_stack([s, s])
    bent[4, :2] += 2
    out = refine.enriched(np.column_stack([s + 1, s]), bent, 0.1)
    assert len(out) >= 5
    same = refine.enriched(np.column_stack([s + 1, s]), np.column_stack([s * 2, s]), 0.1)
    assert len(same) == 5 and np.allclose(same[:, :2], 2 * (s + 1), atol=1e-3)


def test_assembling_shifted_images(spark):
    px = spark.createDataFrame([(k, y, x, float(10 * k + y)) for k in (1, 2) for y in range(4) for x in range(4)], "image_id int, y int, x int, v double")
    images = spark.createDataFrame([(1, 4, 4), (2, 4, 4)], "image_id int, h int, w int")
    params = spark.createDataFrame([(1, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0), (2, 0.0, 1.0, 0.0, 0.0, 0.0, 2.0)], "tf_id int, angle double, scale double, c_y double, c_x double, dy double, dx double")
    got = {(r.y, r.x): r.key for r in assemble.assembled(px, images, params, 4, 4).collect()}
    assert len(got) == 4 * 6 and all(got[(0, x)] == (1 if x <= 2 else 2) for x in range(6))
