import numpy as np

from lattica.operators import kernels


def smooth(n, seed):
    v = np.random.default_rng(seed).random((n, n))
    for _ in range(2):
        v = sum(np.roll(v, s, a) for s in (-1, 0, 1) for a in (0, 1)) / 6
    return v


def cropped(image, n):
    y, x = ((s - n) // 2 for s in image.shape)
    return image[y : y + n, x : x + n]


def test_turned_and_flipped_pairs_are_found(spark):
    whole = smooth(97, 3)
    fixed = cropped(whole, 64)
    rows = []
    for b, (angle, flip) in enumerate([(12.0, False), (63.0, False), (-131.4, False), (27.0, True)]):
        # The search turns the moving image by ``angle`` after any flip, so the planted image is turned back, then flipped.
        moving = cropped(kernels.rotated(whole, -angle), 64)
        rows.append((1, b, 64, 64, fixed.ravel().tolist(), (moving[::-1] if flip else moving).ravel().tolist()))
    pairs = spark.createDataFrame(rows, "a bigint, b bigint, h int, w int, fixed array<double>, moving array<double>")
    got = {r.b: r for r in kernels.angle_search(pairs).collect()}
    for b, (angle, flip) in enumerate([(12.0, False), (63.0, False), (-131.4, False), (27.0, True)]):
        assert abs(got[b].angle - angle) <= 6 and got[b].flipped == flip and abs(got[b].dy) < 2 and abs(got[b].dx) < 2, got[b]
    assert {r.b: r.flipped for r in kernels.angle_search(pairs, [0.0, 62.0]).collect()}[1] is False


def test_angles_of_the_two_passes():
    assert len(kernels.ANGLES) == 180 and kernels.ANGLES[0] == -180 and kernels.ANGLES[-1] == 178
    assert len(kernels.FINER) == 20 and kernels.FINER[0] == -1 and kernels.FINER[-1] == 0.9
    assert [kernels.padded_size(n, 0.75) for n in (8, 11, 64, 65)] == [8, 16, 64, 128]
