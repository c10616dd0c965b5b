"""Mesh and radial-basis transforms fitted to control points, applied to points per transform."""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.sources.tables import materialize


def delaunay(points: np.ndarray) -> np.ndarray:
    """Triangles (n, 3) of a Delaunay triangulation of distinct points, by insertion: each point opens the triangles whose circle holds it."""
    n = len(points)
    if n < 3:
        return np.zeros((0, 3), int)
    p = points - points.mean(axis=0)
    size = max(float(np.abs(p).max()), 1e-9)
    p = p / size
    # A far triangle around all points; circles through its corners act as half planes.
    p = np.concatenate([p, [[-3e3, -3e3], [3e3, -3e3], [0.0, 3e3]]])
    tri, dead = [(n, n + 1, n + 2)], set()

    def circle(t: tuple[int, int, int]) -> tuple[np.ndarray, float]:
        a, b, c = p[list(t)]
        ab, ac = b - a, c - a
        d = 2 * (ab[0] * ac[1] - ab[1] * ac[0])
        if abs(d) < 1e-14:
            return a, np.inf
        u = np.array([ac[1] * (ab @ ab) - ab[1] * (ac @ ac), ab[0] * (ac @ ac) - ac[0] * (ab @ ab)]) / d
        return a + u, float(u @ u)

    first = circle(tri[0])
    centre, radius = np.array([first[0]]), np.array([first[1]])
    # Triangles by number whose circles may hold a point to come; points come by y, so a circle that ends below one is past.
    live = np.array([0])
    for i in np.lexsort((p[:n, 1], p[:n, 0])).tolist():
        gap = (centre - p[i]) ** 2
        most = radius * (1 + 1e-10)
        hit = gap.sum(axis=1) < most
        bad = live[hit].tolist()
        count: dict[tuple[int, int], tuple[int, int] | None] = {}
        for k in bad:
            t = tri[k]
            for e in ((t[0], t[1]), (t[1], t[2]), (t[2], t[0])):
                s = (min(e), max(e))
                count[s] = None if s in count else e
        dead.update(bad)
        stay = ~hit & ~((centre[:, 0] < p[i, 0]) & (gap[:, 0] >= most))
        new, at, far = [], [], []
        for e in count.values():
            if e is not None:
                t = (e[0], e[1], i)
                c, q = circle(t)
                if np.isfinite(q):
                    new.append(len(tri))
                    tri.append(t)
                    at.append(c)
                    far.append(q)
        live = np.concatenate([live[stay], np.array(new, int)])
        centre, radius = np.concatenate([centre[stay], np.array(at).reshape(-1, 2)]), np.concatenate([radius[stay], far])
    return np.array([t for k, t in enumerate(tri) if k not in dead and max(t) < n], int).reshape(-1, 3)


#: Pairs of a query and a triangle or control point that are held at once; of a spline, which takes many passes over them, in the CPU's cache.
PAIRS, SPLINE_PAIRS = 1 << 18, 1 << 15


def _blocks(sizes: np.ndarray, most: int = PAIRS) -> Iterator[tuple[int, int]]:
    """Ranges of neighbours whose sizes add up to ``most`` at most, or single ones."""
    end, at = np.cumsum(sizes), 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(end, (end[at - 1] if at else 0) + most, side="right")))
        yield at, to
        at = to


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    y, x = a[:, None, 0] - b[None, :, 0], a[:, None, 1] - b[None, :, 1]
    y *= y
    x *= x
    y += x
    return y


def fit_mesh(source: np.ndarray, target: np.ndarray) -> tuple:
    return source, target, delaunay(source).astype(np.int32)


def by_mesh(fit: tuple, query: np.ndarray) -> np.ndarray:
    source, target, tri = fit
    out = np.full((len(query), 2), np.nan)
    a, b, c = (source[tri[:, k]] for k in range(3))
    ab, ac = b - a, c - a
    det = ab[:, 0] * ac[:, 1] - ac[:, 0] * ab[:, 1]
    good = np.abs(det) >= 1e-12
    tri, a, b, c, ab, ac, det = (v[good] for v in (tri, a, b, c, ab, ac, det))
    ta, tb, tc = (target[tri[:, k]] for k in range(3))
    # A triangle meets the queries of its span in y only.
    order = np.argsort(query[:, 0], kind="stable")
    y = query[order, 0]
    lo, hi = np.minimum(np.minimum(a[:, 0], b[:, 0]), c[:, 0]), np.maximum(np.maximum(a[:, 0], b[:, 0]), c[:, 0])
    slack = 1e-8 * (hi - lo)
    begin = np.searchsorted(y, lo - slack, side="left")
    n = np.searchsorted(y, hi + slack, side="right") - begin
    for k, to in _blocks(n):
        t = np.repeat(np.arange(k, to), n[k:to])
        at = order[np.arange(len(t)) - np.repeat(np.cumsum(n[k:to]) - n[k:to], n[k:to]) + np.repeat(begin[k:to], n[k:to])]
        d = query[at] - a[t]
        # Shares of b and c, times det.
        nu, nv = d[:, 0] * ac[t, 1] - ac[t, 0] * d[:, 1], ab[t, 0] * d[:, 1] - ab[t, 1] * d[:, 0]
        u, v = nu / det[t], nv / det[t]
        inside = np.flatnonzero((u >= -1e-9) & (v >= -1e-9) & (u + v <= 1 + 1e-9) & np.isnan(out[at, 0]))
        at, first = np.unique(at[inside], return_index=True)
        j = inside[first]
        t, nu, nv = t[j], nu[j, None], nv[j, None]
        out[at] = ta[t] + (nu * (tb[t] - ta[t]) + nv * (tc[t] - ta[t])) / det[t, None]
    return out


def mesh_map(source: np.ndarray, target: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Queries through the linear map of the source triangle that holds them, of several the first; NaN outside all triangles."""
    return by_mesh(fit_mesh(source, target), query)


def _plate_basis(d2: np.ndarray) -> np.ndarray:
    out = np.log(np.maximum(d2, np.finfo(float).tiny))
    out *= d2
    out /= 2
    return out


def fit_plate(source: np.ndarray, target: np.ndarray) -> tuple:
    """Source, weights, middle and size by which coordinates are scaled, as distances of their squares' size cost digits.

    Distinct points that are not all on a line have one spline, else the least squares of the unscaled points count.
    """
    n = len(source)
    middle = source.mean(axis=0)
    size = float(np.abs(source - middle).max()) or 1.0
    one = len(np.unique(source, axis=0)) == n and np.linalg.matrix_rank(np.column_stack([np.ones(n), (source - middle) / size])) == 3
    if not one:
        middle, size = np.zeros(2), 1.0
    s = (source - middle) / size
    p = np.column_stack([np.ones(n), s])
    m = np.zeros((n + 3, n + 3))
    m[:n, :n], m[:n, n:], m[n:, :n] = _plate_basis(_squares(s, s)), p, p.T
    want = np.concatenate([target, np.zeros((3, 2))])
    return s, np.linalg.solve(m, want) if one else np.linalg.lstsq(m, want, rcond=None)[0], middle, size


def by_plate(fit: tuple, query: np.ndarray) -> np.ndarray:
    s, w, middle, size = fit
    q, out = (query - middle) / size, np.empty((len(query), 2))
    for k, to in _blocks(np.full(len(q), len(s)), SPLINE_PAIRS):
        out[k:to] = _plate_basis(_squares(q[k:to], s)) @ w[: len(s)] + np.column_stack([np.ones(to - k), q[k:to]]) @ w[len(s) :]
    return out


def thin_plate(source: np.ndarray, target: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Queries through the thin-plate spline with affine part that meets all control points."""
    return by_plate(fit_plate(source, target), query)


def fit_multiquadric(source: np.ndarray, target: np.ndarray) -> tuple:
    extent = np.ptp(source, axis=0)
    extent = extent[extent > 0]
    width = (extent.prod() / len(source)) ** (1 / len(extent)) if len(extent) else 1.0
    return source, np.linalg.lstsq(np.sqrt(_squares(source, source) / width**2 + 1), target, rcond=None)[0], width


def by_multiquadric(fit: tuple, query: np.ndarray) -> np.ndarray:
    source, w, width = fit
    out = np.empty((len(query), 2))
    for k, to in _blocks(np.full(len(query), len(source))):
        out[k:to] = np.sqrt(_squares(query[k:to], source) / width**2 + 1) @ w
    return out


def multiquadric(source: np.ndarray, target: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Radial map by multiquadrics whose width is the mean spacing of the control points."""
    return by_multiquadric(fit_multiquadric(source, target), query)


def fit_mesh_or_plate(source: np.ndarray, target: np.ndarray) -> tuple:
    return fit_mesh(source, target), fit_plate(source, target)


def by_mesh_or_plate(fit: tuple, query: np.ndarray) -> np.ndarray:
    out = by_mesh(fit[0], query)
    lost = np.isnan(out[:, 0])
    if lost.any():
        out[lost] = by_plate(fit[1], query[lost])
    return out


def mesh_or_plate(source: np.ndarray, target: np.ndarray, query: np.ndarray) -> np.ndarray:
    """The mesh inside its hull, the thin-plate spline outside."""
    out = mesh_map(source, target, query)
    lost = np.isnan(out[:, 0])
    if lost.any():
        out[lost] = thin_plate(source, target, query[lost])
    return out


#: How a kind of transform is fitted to its control points once, and applied to queries.
FITS = {mesh_map: (fit_mesh, by_mesh), thin_plate: (fit_plate, by_plate), multiquadric: (fit_multiquadric, by_multiquadric), mesh_or_plate: (fit_mesh_or_plate, by_mesh_or_plate)}
#: Parts into which the points of a transform are spread.
SPREAD = 8
#: Cells of a grid that are mapped at once.
CELLS = 1 << 16


def _fits(cp: DataFrame, kind: Callable, inverse: bool = False) -> DataFrame:
    """(tf_id, fit, box, part): each transform fitted once and the bounds of its sources, for each of SPREAD parts of what it maps."""
    fit = FITS[kind][0]

    def fitted(group: pa.Table) -> pa.Table:
        c = np.unique(np.column_stack([np.array(group.column(k)) for k in range(1, 5)]), axis=0)
        s, g = (c[:, 2:], c[:, :2]) if inverse else (c[:, :2], c[:, 2:])
        _, first = np.unique(s, axis=0, return_index=True)
        made = pickle.dumps(fit(s[first], g[first]) if len(first) >= 3 else None)
        box = [[*s.min(axis=0).tolist(), *s.max(axis=0).tolist()]]
        return pa.table([group.column(0).slice(0, 1), pa.array([made], pa.binary()), pa.array(box, pa.list_(pa.float64()))], ["tf_id", "fit", "box"])

    # A given number of partitions: control points have few bytes for the time they take, and AQE would put them into one task.
    tasks = int(cp.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = cp.filter("tf_id is not null").select("tf_id", *[F.col(c).cast("double") for c in ("s_y", "s_x", "t_y", "t_x")]).repartition(tasks, "tf_id")
    fits = each.groupBy("tf_id").applyInArrow(fitted, f"tf_id {dict(cp.dtypes)['tf_id']}, fit binary, box array<double>")
    return fits.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))


def map_by(points: DataFrame, cp: DataFrame, kind: Callable = mesh_or_plate, inverse: bool = False) -> DataFrame:
    """(tf_id, q, y, x) through transforms given by control points (tf_id, idx, t_y, t_x, s_y, s_x); inverse: target to source.

    A transform is fitted once, in a task that holds its control points (memory grows with their square where a spline is
    fitted); the fit goes to each of SPREAD parts of its points, so a transform that is asked for a third of all points
    is applied in several tasks. Repeated control points count once. A transform of fewer than three maps to NaN.
    """
    apply = FITS[kind][1]
    kinds = dict(points.dtypes)

    def run(asked: pa.Table, fits: pa.Table) -> pa.Table:
        if not fits.num_rows:
            asked = asked.slice(0, 0)
        q = np.column_stack([np.array(asked.column(k), float) for k in ("y", "x")])
        model = pickle.loads(fits.column("fit")[0].as_py()) if asked.num_rows else None
        out = np.full(q.shape, np.nan) if model is None else apply(model, q)
        return pa.table([asked.column("tf_id"), asked.column("q"), pa.array(out[:, 0]), pa.array(out[:, 1])], ["tf_id", "q", "y", "x"])

    fits = _fits(cp, kind, inverse).select("tf_id", "fit", "part")
    spread = points.filter("tf_id is not null").select("tf_id", "q", "y", "x", F.pmod(F.xxhash64("q", "y", "x"), F.lit(SPREAD)).cast("int").alias("part"))
    return spread.groupBy("tf_id", "part").cogroup(fits.groupBy("tf_id", "part")).applyInArrow(run, f"tf_id {kinds['tf_id']}, q {kinds['q']}, y double, x double")


def grid_by(cp: DataFrame, step: float, kind: Callable = mesh_or_plate) -> DataFrame:
    """(tf_id, i, j, y, x): a grid of points ``step`` apart from the least source of each transform to past its largest, mapped.

    As ``map_by``, but the points are made where they are mapped, CELLS at a time: a box may hold any number of them.
    """
    apply = FITS[kind][1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                made, (low_y, low_x, high_y, high_x), part = (batch.column(k)[row].as_py() for k in range(1, 4))
                model, wide = pickle.loads(made), math.ceil((high_x - low_x) / step) + 1
                n = (math.ceil((high_y - low_y) / step) + 1) * wide
                end = (part + 1) * n // SPREAD
                for at in range(part * n // SPREAD, end, CELLS):
                    i, j = np.divmod(np.arange(at, min(at + CELLS, end)), wide)
                    q = np.column_stack([low_y + i * step, low_x + j * step])
                    out = np.full(q.shape, np.nan) if model is None else apply(model, q)
                    ids = batch.column(0).take(pa.array(np.full(len(i), row)))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(i), pa.array(j), pa.array(out[:, 0]), pa.array(out[:, 1])], ["tf_id", "i", "j", "y", "x"])

    tasks = int(cp.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fits = _fits(cp, kind).select("tf_id", "fit", "box", "part").repartition(tasks, "tf_id", "part")
    return fits.mapInArrow(run, f"tf_id {dict(cp.dtypes)['tf_id']}, i bigint, j bigint, y double, x double")


def composed(a_to_b: DataFrame, b_to_c: DataFrame) -> DataFrame:
    """Control points of A to C: A's targets pushed through B to C. Both have one transform per tf_id."""
    asked = a_to_b.select("tf_id", F.col("idx").alias("q"), F.col("t_y").alias("y"), F.col("t_x").alias("x"))
    mapped = map_by(asked, b_to_c).select("tf_id", F.col("q").alias("idx"), F.col("y").alias("t_y"), F.col("x").alias("t_x"))
    return a_to_b.select("tf_id", "idx", "s_y", "s_x").join(mapped, ["tf_id", "idx"]).select("tf_id", "idx", "t_y", "t_x", "s_y", "s_x")


def local_rigid(points: DataFrame, cp: DataFrame) -> DataFrame:
    """Rigid map that stands for each transform about target points (tf_id, q, y, x): angle, offset and centre."""
    from lattica.functions.geometry import arc_angle

    back = materialize(map_by(points, cp, inverse=True).select("tf_id", "q", F.col("y").alias("c_y"), F.col("x").alias("c_x")))
    step = map_by(back.select("tf_id", "q", F.col("c_y").alias("y"), (F.col("c_x") + 1.0).alias("x")), cp).select("tf_id", "q", F.col("y").alias("e_y"), F.col("x").alias("e_x"))
    j = points.select("tf_id", "q", "y", "x").join(back, ["tf_id", "q"]).join(step, ["tf_id", "q"])
    angle = -arc_angle(F.col("y"), F.col("x"), F.col("y"), F.col("x") + 1.0, F.col("e_y"), F.col("e_x"))
    return j.select("tf_id", "q", angle.alias("angle"), (F.col("y") - F.col("c_y")).alias("dy"), (F.col("x") - F.col("c_x")).alias("dx"), "c_y", "c_x")
