"""Numeric kernels on images in array form (id, h, w, data): NumPy over Arrow batches, a row at a time only inside the batch."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def rows_to(df: DataFrame, schema: str, kernel: Callable[[dict], dict | None]) -> DataFrame:
    """``kernel`` on every row as a dict of Python and NumPy values; a None drops the row. One row in, one out: nothing is grouped."""
    kinds = to_arrow_schema(T.StructType.fromDDL(schema))
    lists = {f.name for f in df.schema.fields if f.dataType.typeName() == "array"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                row = {c: np.array(batch.column(k)[i].values) if c in lists and batch.column(k)[i].is_valid else batch.column(k)[i].as_py() for k, c in enumerate(batch.schema.names)}
                made = kernel(row)
                if made is not None:
                    rows.append(made)
            if rows:
                yield from pa.Table.from_pylist(rows, kinds).to_batches()

    return df.mapInArrow(run, schema)


def phase_correlation(fixed: np.ndarray, moving: np.ndarray) -> np.ndarray:
    """Correlation image of two images of the same shape by their phases alone."""
    if fixed.shape != moving.shape:
        raise ValueError("images differ in shape")
    f, m = np.fft.fft2(fixed - fixed.mean()), np.fft.fft2(moving - moving.mean())
    c = np.conj(f) * m
    size = np.abs(c)
    c[size > 0] /= size[size > 0]
    return np.fft.ifft2(c).real


def labelled(mask: np.ndarray) -> tuple[np.ndarray, int]:
    """Parts of a mask joined by their sides, numbered from 1 in reading order of their first pixel: the least index spreads until nothing changes."""
    n = mask.size
    label = np.where(mask, np.arange(n).reshape(mask.shape), n)
    while True:
        low = np.pad(label, 1, constant_values=n)
        new = np.minimum.reduce([label, low[:-2, 1:-1], low[2:, 1:-1], low[1:-1, :-2], low[1:-1, 2:]])
        new = np.where(mask, new, n)
        # A label's own label is at least as good: long parts settle in few rounds.
        new = np.where(mask, np.append(new.ravel(), n)[np.where(mask, new, n)], n)
        if (new == label).all():
            break
        label = new
    ids = np.unique(label[mask])
    return np.where(mask, np.searchsorted(ids, label) + 1, 0), len(ids)


def find_peak(image: np.ndarray, mask: np.ndarray | None = None, percent: float = 99.5, relative: bool = True) -> tuple[float, float, float]:
    """Offset (y, x) of the heaviest bright part's centre of mass from the image's centre, and its weight relative to the mean part.

    Not ``relative``, the weight is the part's sum and the percentile that of the pixels in the mask.
    """
    v = image if mask is None else np.where(mask, image, 0.0)
    v = np.where(v >= np.percentile(v if relative or mask is None else image[mask], percent), v, 0.0)
    label, n = labelled(v > 0)
    if not n:
        return 0.0, 0.0, 0.0
    sums = np.bincount(label.ravel(), weights=v.ravel(), minlength=n + 1)
    best = int(sums[1:].argmax()) + 1
    y, x = np.nonzero(label == best)
    w = v[y, x]
    cy, cx = (y * w).sum() / w.sum(), (x * w).sum() / w.sum()
    return image.shape[0] / 2 - cy, image.shape[1] / 2 - cx, float(sums[best] / sums[1:].mean() if relative else sums[best])


def overlap_mask(fixed: tuple[int, int], moving: tuple[int, int], shape: tuple[int, int], lo: float, hi: float) -> np.ndarray | None:
    """Shifts from the centre at which two images share between ``lo`` and ``hi`` of the most they can share; None if all do."""
    if lo >= hi:
        raise ValueError("least overlap must be below largest")
    if lo <= 0 and hi >= 1:
        return None
    share = []
    for n, f, m in zip(shape, fixed, moving, strict=True):
        d = np.abs(np.arange(n) - (n - 1) / 2) if n % 2 else np.where(np.arange(n) >= n // 2, np.arange(n) - n // 2, n // 2 - 1 - np.arange(n))
        share.append(np.clip(np.minimum(f / 2, d + m / 2) - np.maximum(-f / 2, d - m / 2), 0, None) / min(f, m))
    s = np.outer(share[0], share[1])
    return (s >= lo) & (s <= hi)


def find_offset(fixed: np.ndarray, moving: np.ndarray, lo: float = 0.0, hi: float = 1.0) -> tuple[float, float, float]:
    """Where ``moving`` lies on ``fixed``: peak of the shifted correlation image, with its weight."""
    c = np.fft.fftshift(phase_correlation(fixed, moving))
    c -= c.min()
    if c.max() > 0:
        c /= c.max()
    return find_peak(c, overlap_mask(fixed.shape, moving.shape, c.shape, lo, hi))


def noise(shape: tuple[int, ...], mean: float, std: float, lo: float, hi: float, seed: int) -> np.ndarray:
    """Normal noise within bounds, the same for the same seed."""
    return np.clip(np.random.default_rng(seed).normal(mean, std, shape), lo, hi)


def padded(image: np.ndarray, height: int, width: int, seed: int) -> np.ndarray:
    """Image in the middle of a larger one filled with noise of its own median and deviation."""
    h, w = image.shape
    out = noise((height, width), float(np.median(image)), float(image.std()), float(image.min()), float(image.max()), seed)
    y, x = (height - h) // 2, (width - w) // 2
    out[y : y + h, x : x + w] = image
    return out


def masked_with_noise(image: np.ndarray, mask: np.ndarray, seed: int) -> np.ndarray:
    """Pixels outside the mask replaced by noise of those inside."""
    inside = image[mask]
    if inside.size <= 2:
        raise ValueError("too few pixels inside the mask")
    return np.where(mask, image, noise(image.shape, float(np.median(inside)), float(inside.std()), float(image.min()), float(image.max()), seed))


def extrema_with_noise(image: np.ndarray, seed: int) -> np.ndarray:
    """Pixels at either extremum replaced by noise of the others."""
    mask = (image > image.min()) & (image < image.max())
    return masked_with_noise(image, mask, seed) if mask.sum() > 2 else image


def spectral_score(image: np.ndarray) -> float:
    """Mean power of an image's spectrum: how much there is to register by. NaN counts as the mean."""
    v = np.where(np.isnan(image), np.nanmean(image), image)
    return float(np.abs(np.fft.rfft2(v - v.mean())).sum() / v.size)


def feature_score(image: np.ndarray, cell: int = 64) -> float:
    """75th percentile of the spectral scores of an image's cells; cells with fewer than half finite pixels don't count."""
    scores = []
    for y in range(0, max(image.shape[0] - cell, 0) + 1, cell):
        for x in range(0, max(image.shape[1] - cell, 0) + 1, cell):
            part = image[y : y + cell, x : x + cell]
            if np.isfinite(part).sum() * 2 >= part.size:
                scores.append(spectral_score(part))
    return 0.0 if not scores else scores[0] if len(scores) == 1 else float(np.percentile(scores, 75))


def rotated(image: np.ndarray, degrees: float) -> np.ndarray:
    """Image turned about its centre, bilinear, grown so that nothing of it is cut off; NaN where it comes from outside."""
    h, w = image.shape
    a = np.deg2rad(degrees)
    c, s = np.cos(a), np.sin(a)
    height, width = int(abs(c) * h + abs(s) * w + 0.5), int(abs(s) * h + abs(c) * w + 0.5)
    y, x = np.arange(height)[:, None] - (height - 1) / 2, np.arange(width)[None] - (width - 1) / 2
    return sampled(image, c * y + s * x + (h - 1) / 2, c * x - s * y + (w - 1) / 2)


def sampled(image: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Bilinear samples; NaN outside."""
    h, w = image.shape
    inside = (y > -1e-9) & (x > -1e-9) & (y < h - 1 + 1e-9) & (x < w - 1 + 1e-9)
    y, x = np.clip(y, 0, h - 1), np.clip(x, 0, w - 1)
    y0, x0 = np.minimum(y.astype(int), h - 2 if h > 1 else 0), np.minimum(x.astype(int), w - 2 if w > 1 else 0)
    fy, fx = y - y0, x - x0
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    v = (image[y0, x0] * (1 - fx) + image[y0, x1] * fx) * (1 - fy) + (image[y1, x0] * (1 - fx) + image[y1, x1] * fx) * fy
    return np.where(inside, v, np.nan)


def resized(image: np.ndarray, scale: float) -> np.ndarray:
    """Image of round(shape * scale), bilinear, corners on corners."""
    h, w = (max(1, round(n * scale)) for n in image.shape)
    y = np.linspace(0, image.shape[0] - 1, h)[:, None].repeat(w, 1)
    x = np.linspace(0, image.shape[1] - 1, w)[None].repeat(h, 0)
    return sampled(image, y, x)


def padded_size(n: int, least_overlap: float) -> int:
    """Size that a dimension is padded to for a least overlap: the next power of two; from one half on an image needs no room beside it."""
    return 1 << math.ceil(math.log2(n if least_overlap >= 0.5 else n + n * (1 - (least_overlap + 0.5)) * 2))


def score_angle(fixed: np.ndarray, moving: np.ndarray, degrees: float, seed: int = 0, least_overlap: float = 0.75) -> tuple[float, float, float]:
    """Offset and weight with ``moving`` turned first; what the turn uncovers becomes noise, and so does the padding of both images.

    Only shifts count at which the images share ``least_overlap`` or more of what they can share.
    """
    turned = moving if degrees == 0 else rotated(moving, degrees)
    size = [padded_size(max(f, m), least_overlap) for f, m in zip(fixed.shape, turned.shape, strict=True)]
    y, x = ((n - m) // 2 for n, m in zip(size, turned.shape, strict=True))
    canvas = noise(tuple(size), float(np.median(moving)), float(moving.std()), float(moving.min()), float(moving.max()), 2 * seed)
    part = canvas[y : y + turned.shape[0], x : x + turned.shape[1]]
    part[...] = np.where(np.isnan(turned), part, turned)
    c = np.fft.fftshift(phase_correlation(padded(fixed, *size, 2 * seed + 1), canvas))
    c -= c.min()
    if c.max() > 0:
        c /= c.max()
    return find_peak(c, overlap_mask(fixed.shape, moving.shape, c.shape, least_overlap, 1.0), relative=False)


def _image(row: dict, name: str = "data") -> np.ndarray:
    return np.asarray(row[name], float).reshape(row["h"], row["w"])


def offsets(pairs: DataFrame) -> DataFrame:
    """(a, b, dy, dx, weight) of image pairs (a, b, h, w, fixed, moving); a solid image gives weight 0."""

    def kernel(r: dict) -> dict:
        f, m = _image(r, "fixed"), _image(r, "moving")
        if f.min() == f.max() or m.min() == m.max():
            return {"a": r["a"], "b": r["b"], "dy": 0.0, "dx": 0.0, "weight": 0.0}
        dy, dx, weight = find_offset(f, m)
        return {"a": r["a"], "b": r["b"], "dy": dy, "dx": dx, "weight": weight}

    return rows_to(pairs, "a bigint, b bigint, dy double, dx double, weight double", kernel)


def feature_scores(images: DataFrame, cell: int) -> DataFrame:
    return rows_to(images.select("image_id", "h", "w", "data"), "image_id bigint, score double", lambda r: {"image_id": r["image_id"], "score": feature_score(_image(r), cell)})


#: Angles of the first pass, those of the second from the best one, and how many a row holds.
ANGLES = [float(a) for a in range(-180, 180, 2)]
FINER = [round(k * 0.1 - 1, 1) for k in range(20)]
ANGLES_EACH = 30


def angle_search(pairs: DataFrame, angles: list[float] | None = None, least_overlap: float = 0.75) -> DataFrame:
    """Best angle of each image pair, plain or with ``moving`` flipped top to bottom first: (a, b, angle, flipped, dy, dx, weight).

    By default all angles of ``ANGLES`` are tried either way, then those of ``FINER`` about the best; given ``angles`` are
    tried alone. Flipped counts only if strictly heavier; ties go to the lower angle. A row has ``ANGLES_EACH`` angles of a
    pair, so a search spreads over tasks. Extrema become noise first; a solid image gives weight 0.
    """
    schema = "a bigint, b bigint, angle double, flipped boolean, dy double, dx double, weight double"

    def kernel(r: dict) -> dict:
        f, m = _image(r, "fixed"), _image(r, "moving")
        if f.min() == f.max() or m.min() == m.max():
            return {"a": r["a"], "b": r["b"], "angle": float(min(r["angles"])), "flipped": r["flipped"], "dy": 0.0, "dx": 0.0, "weight": 0.0}
        f, m = extrema_with_noise(f, 2 * r["a"] + 1), extrema_with_noise(m, 2 * r["a"])
        m = m[::-1] if r["flipped"] else m
        found = [(*score_angle(f, m, float(a), r["a"], least_overlap), float(a)) for a in r["angles"]]
        dy, dx, weight, angle = max(found, key=lambda x: (x[2], -x[3]))
        return {"a": r["a"], "b": r["b"], "angle": angle, "flipped": r["flipped"], "dy": dy, "dx": dx, "weight": weight}

    def best(rows: DataFrame) -> DataFrame:
        order = F.struct("weight", (~F.col("flipped")).alias("plain"), (-F.col("angle")).alias("o"))
        scored = rows_to(rows.select("a", "b", "h", "w", "fixed", "moving", "flipped", "angles"), schema, kernel)
        return scored.groupBy("a", "b").agg(F.max_by(F.struct("angle", "flipped", "dy", "dx", "weight"), order).alias("r")).select("a", "b", "r.*")

    tried = [float(a) for a in (ANGLES if angles is None else angles)]
    parts = [F.array(*map(F.lit, tried[k : k + ANGLES_EACH])) for k in range(0, len(tried), ANGLES_EACH)]
    rows = pairs.withColumn("flipped", F.explode(F.array(F.lit(False), F.lit(True)))).withColumn("angles", F.explode(F.array(*parts)))
    first = best(rows.repartition("a", "b", "flipped", F.get("angles", F.lit(0))))
    if angles is not None:
        return first
    about = first.select("a", "b", "flipped", F.transform(F.array(*map(F.lit, FINER)), lambda x: F.round(x + F.col("angle"), 1)).alias("angles"))
    return best(pairs.join(about, ["a", "b"]))


def converted(images: DataFrame, bits: int, flip: bool = False, flop: bool = False, invert: bool = False, levels: tuple[float, float] | None = None, gamma: float = 1.0, scale: float = 1.0) -> DataFrame:
    """Images (name, h, w, bpp, data) with their size, levels and orientation changed, at most ``bits`` deep: (name, h, w, data, error).

    An image that can't be converted has a row with its error; the others go on.
    """
    if levels and levels[0] >= levels[1]:
        raise ValueError("lowest level must be below highest")

    def kernel(r: dict) -> dict:
        try:
            v = _image(r) / (2.0 ** r["bpp"] - 1)
            if scale != 1:
                v = resized(v, scale)
            v = v[:: -1 if flip else 1, :: -1 if flop else 1]
            lo, hi = levels or (0.0, 1.0)
            v = np.clip((v - lo) / (hi - lo), 0, 1) ** (1 / gamma)
            v = np.floor((1 - v if invert else v) * (2.0 ** min(bits, r["bpp"]) - 1))
            return {"name": r["name"], "h": v.shape[0], "w": v.shape[1], "data": v.ravel().tolist(), "error": None}
        except Exception as e:  # noqa: BLE001
            return {"name": r["name"], "h": None, "w": None, "data": None, "error": f"{type(e).__name__}: {e}"}

    return rows_to(images.select("name", "h", "w", "bpp", "data"), "name string, h int, w int, data array<double>, error string", kernel)
