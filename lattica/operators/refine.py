"""Refining the transform of a pair of sections on a grid of points, and composing and thinning transforms."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.operators import kernels
from lattica.operators.mesh import delaunay, mesh_or_plate


def grid_points(h: int, w: int, spacing: int) -> np.ndarray:
    """Points (y, x) from edge to edge of an image."""
    at = lambda n: np.floor(np.linspace(0, n - 1, max(2, -(-n // spacing) + 1)))
    return np.array([(y, x) for y in at(h) for x in at(w)])


def _window(image: np.ndarray, at: np.ndarray, size: int, seed: int) -> np.ndarray:
    y0, x0 = (int(round(v)) - size // 2 for v in at)
    out = kernels.noise((size, size), float(np.median(image)), float(image.std()), float(image.min()), float(image.max()), seed)
    ys, xs = slice(max(y0, 0), max(min(y0 + size, image.shape[0]), 0)), slice(max(x0, 0), max(min(x0 + size, image.shape[1]), 0))
    part = image[ys, xs]
    out[ys.start - y0 : ys.start - y0 + part.shape[0], xs.start - x0 : xs.start - x0 + part.shape[1]] = part
    return out


def refine(fixed: np.ndarray, moving: np.ndarray, control: np.ndarray, cell: int = 32, spacing: int = 32, passes: int = 10, settled: float = 1.0) -> np.ndarray:
    """Control points (t_y, t_x, s_y, s_x) after at most ``passes`` rounds of aligning cells about a grid of source points.

    A round maps the points, aligns a cell about each, and fits the next transform to the heaviest: those above a percentile
    that falls from 90 to 10. Points that moved no more than ``settled`` and are heavier than the median stay where they are
    for good. Rounds end early when nine in ten have settled, or a tenth has and no more do. The first uses cells twice as large.
    """
    source = grid_points(*moving.shape, spacing)
    final: dict[int, np.ndarray] = {}
    for k in range(passes):
        size = cell * 2 if k == 0 else cell
        target = mesh_or_plate(control[:, 2:], control[:, :2], source)
        inside = (target >= 0).all(axis=1) & (target < fixed.shape).all(axis=1)
        todo = [i for i in np.flatnonzero(inside).tolist() if i not in final]
        peak, weight = np.zeros((len(source), 2)), np.zeros(len(source))
        for i in todo:
            f, m = _window(fixed, target[i], size, i), _window(moving, source[i], size, i)
            if f.min() < f.max() and m.min() < m.max():
                *p, weight[i] = kernels.find_offset(f, m, 0.25)
                peak[i] = p
        heavy = weight[todo] >= np.percentile(weight[todo], max(10, 90 - 80 * k / max(passes - 1, 1))) if todo else []
        used = [i for i, ok in zip(todo, heavy, strict=True) if ok and weight[i] > 0]
        moved = {i: target[i] + peak[i] for i in used} | final
        if len(moved) >= 3:
            keys = sorted(moved)
            new = np.column_stack([[moved[i] for i in keys], source[keys]])
            if len(delaunay(new[:, 2:])):
                control = new
        before = len(final)
        middle = np.median(weight[todo]) if todo else 0
        final |= {i: target[i] for i in todo if weight[i] > middle and np.hypot(*peak[i]) <= settled}
        share = len(final) / max(len(source), 1)
        if share > 0.9 or share >= 0.1 and len(final) == before:
            break
    return control


def refined(pairs: DataFrame, cell: int = 32, spacing: int = 32, passes: int = 10) -> DataFrame:
    """(pair, t_y, t_x, s_y, s_x) for section pairs (pair, h, w, fixed, moving, control array<double> of rows of four): one row is one pair, so a volume's pairs spread over tasks."""

    def kernel(r: dict) -> dict:
        f, m = (np.asarray(r[k], float).reshape(r["h"], r["w"]) for k in ("fixed", "moving"))
        return {"pair": r["pair"], "control": refine(f, m, np.asarray(r["control"], float).reshape(-1, 4), cell, spacing, passes).ravel().tolist()}

    out = kernels.rows_to(pairs, "pair bigint, control array<double>", kernel)
    at = lambda k: F.get("control", F.col("i") * 4 + k)
    return out.select("pair", "control", F.explode(F.sequence(F.lit(0), (F.size("control") / 4 - 1).cast("int"))).alias("i")).select("pair", at(0).alias("t_y"), at(1).alias("t_x"), at(2).alias("s_y"), at(3).alias("s_x"))


def enriched(a_to_b: np.ndarray, b_to_c: np.ndarray, epsilon: float) -> np.ndarray:
    """Control points of A to C, with centroids added where mapping A to C at once misses A to B to C by more than ``epsilon``."""
    through = lambda s: mesh_or_plate(b_to_c[:, 2:], b_to_c[:, :2], mesh_or_plate(a_to_b[:, 2:], a_to_b[:, :2], s))
    source = a_to_b[:, 2:]
    while True:
        target = through(source)
        tri = delaunay(source)
        if not len(tri):
            break
        centre = source[tri].mean(axis=1)
        off = np.hypot(*(through(centre) - mesh_or_plate(source, target, centre)).T)
        room = np.sqrt(((source[tri] - centre[:, None]) ** 2).sum(axis=2)).min(axis=1)
        new = centre[(off > epsilon) & (room > epsilon)]
        if not len(new):
            break
        source = np.concatenate([source, new])
    return np.column_stack([through(source), source])


def scaled_records(stos: DataFrame, old: float, new: float) -> DataFrame:
    """Control points of records written at one pixel spacing, at another: both spaces scaled alike."""
    k = old / new
    return stos.select("tf_id", "idx", *[(F.col(c) * k).alias(c) for c in ("t_y", "t_x", "s_y", "s_x")])


def upserted(volume: DataFrame, new: DataFrame, key: str = "section") -> DataFrame:
    """A volume's rows with those of ``new`` in the place of rows of the same section."""
    return volume.join(new.select(key).distinct(), key, "left_anti").select(*new.columns).unionByName(new)


def points_in(cp: DataFrame, low: tuple[float, float], high: tuple[float, float], space: str = "t") -> DataFrame:
    """Control points whose target (or source) lies in a closed rectangle."""
    return cp.filter(F.col(f"{space}_y").between(low[0], high[0]) & F.col(f"{space}_x").between(low[1], high[1]))
