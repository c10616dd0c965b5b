"""Arranging the tiles of a mosaic: offsets of overlapping tiles from their pixels, then a layout that meets them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions.geometry import SIDES
from lattica.operators import kernels, layout
from lattica.operators.rectangles import overlaps, pair_delta
from lattica.sources.tables import materialize


def tile_boxes(tiles: DataFrame) -> DataFrame:
    """Bounds of tiles (id, y, x, h, w), y and x being the lower corner."""
    return tiles.select("id", F.col("y").alias("min_y"), F.col("x").alias("min_x"), (F.col("y") + F.col("h")).alias("max_y"), (F.col("x") + F.col("w")).alias("max_x"))


def crops(pairs: DataFrame, tiles: DataFrame, images: DataFrame, excess: float) -> DataFrame:
    """(a, b, side, y0, x0, h, w, data, score): what either tile shows of a pair's common rectangle, enlarged by ``excess`` about its centre.

    Each tile's image is joined once to the crops asked of it, and only crops go on. Beyond the tile there is noise, seeded
    by the pair. The score says how much there is to register by.
    """
    side = lambda k, t: F.struct(F.lit(k).alias("side"), F.col(t).alias("id"))
    asked = pairs.select("a", "b", *SIDES, F.explode(F.array(side(0, "a"), side(1, "b"))).alias("s")).select("a", "b", *SIDES, "s.side", "s.id")
    rows = asked.join(tiles.select("id", "y", "x"), "id").join(images.select(F.col("image_id").alias("id"), "h", "w", "data"), "id")

    def cut(r: dict) -> dict:
        image = np.asarray(r["data"], float).reshape(r["h"], r["w"])
        size = [max(2, round((r[f"max_{k}"] - r[f"min_{k}"]) * excess)) for k in "yx"]
        at = [round((r[f"min_{k}"] + r[f"max_{k}"]) / 2 - r[k] - n / 2) for k, n in zip("yx", size, strict=True)]
        seed = (r["a"] * 1_000_003 + r["b"]) * 2 + r["side"]
        out = kernels.noise(tuple(size), float(np.median(image)), float(image.std()), float(image.min()), float(image.max()), seed)
        (y0, x0), (h, w) = at, size
        ys, xs = slice(max(y0, 0), max(min(y0 + h, r["h"]), 0)), slice(max(x0, 0), max(min(x0 + w, r["w"]), 0))
        part = image[ys, xs]
        if part.size:
            out[ys.start - y0 : ys.start - y0 + part.shape[0], xs.start - x0 : xs.start - x0 + part.shape[1]] = part
        solid = part.size == 0 or part.min() == part.max()
        return {"a": r["a"], "b": r["b"], "side": r["side"], "h": h, "w": w, "score": 0.0 if solid else kernels.spectral_score(part), "data": out.ravel().tolist()}

    return kernels.rows_to(rows, "a bigint, b bigint, side int, h int, w int, score double, data array<double>", cut)


def tile_offsets(pairs: DataFrame, tiles: DataFrame, images: DataFrame, excess: float, least_score: float) -> DataFrame:
    """Edges (a, b, dy, dx, weight) between tiles: where b should lie from a. Pairs with a featureless side are dropped."""
    c = crops(pairs, tiles, images, excess)
    both = c.groupBy("a", "b").agg(*[F.max(F.when(F.col("side") == k, F.struct("h", "w", "score", "data"))).alias(n) for k, n in ((0, "p"), (1, "q"))])
    ok = both.filter(f"p.score >= {least_score} and q.score >= {least_score}").join(pairs.select("a", "b", "dy", "dx"), ["a", "b"])
    rows = ok.select("a", "b", "dy", "dx", F.least("p.score", "q.score").alias("score"), F.col("p.h").alias("h"), F.col("p.w").alias("w"), F.col("p.data").alias("fixed"), F.col("q.data").alias("moving"))

    def align(r: dict) -> dict:
        f, m = (np.asarray(r[k], float).reshape(r["h"], r["w"]) for k in ("fixed", "moving"))
        y, x, weight = kernels.find_offset(f, m)
        return {"a": r["a"], "b": r["b"], "dy": r["dy"] + y, "dx": r["dx"] + x, "weight": weight * r["score"]}

    return kernels.rows_to(rows, "a bigint, b bigint, dy double, dx double, weight double", align)


def arrange(tiles: DataFrame, images: DataFrame, cell: float, passes: int = 6, first_excess: float = 3.0, excess: float = 1.5, least_overlap: float = 0.02, least_score: float = 0.035, moved: float = 1.0, relax_steps: int = 150) -> DataFrame:
    """Positions of tiles (id, y, x, h, w) that meet the offsets found in their pixels (image_id, h, w, data).

    Each pass finds the overlapping pairs, registers those that are new or whose offset changed by ``moved`` or more, keeps
    the other offsets, places the tiles along the heaviest offsets and relaxes the rest. It ends when no pair is new or
    changed. Tables are written between passes; nothing but counts reaches the driver.
    """
    edges = known = None
    tiles = materialize(tiles.select("id", "y", "x", "h", "w"))
    if tiles.limit(2).count() < 2:
        return tiles
    for k in range(passes):
        now = materialize(overlaps(tile_boxes(tiles), cell, least_overlap))
        state = pair_delta(known, now, moved) if known is not None else now.select("a", "b", F.lit("new").alias("state"))
        todo = materialize(now.join(state.filter("state in ('new', 'changed')").select("a", "b"), ["a", "b"]))
        if todo.isEmpty():
            break
        found = tile_offsets(todo, tiles, images, first_excess if k == 0 else excess, least_score)
        alive = now.select("a", "b")
        edges = materialize(found if edges is None else layout.upsert_edges(edges.join(alive, ["a", "b"]), found))
        if edges.isEmpty():
            break
        weighted = materialize(layout.weights_to_range(edges, 0.0, 1.0))
        placed, _ = layout.strongest_layout(tiles.select("id"), weighted)
        # Parts keep their place: each is put where its tiles lay on average.
        part = placed.join(tiles.select("id", F.col("y").alias("oy"), F.col("x").alias("ox")), "id")
        shift = part.groupBy("component").agg(F.avg(F.col("oy") - F.col("y")).alias("sy"), F.avg(F.col("ox") - F.col("x")).alias("sx"))
        start = materialize(part.join(shift, "component").select("id", (F.col("y") + F.col("sy")).alias("y"), (F.col("x") + F.col("sx")).alias("x")))
        relaxed = layout.relax(start, weighted, cutoff=0.1, most=relax_steps)
        known = now
        tiles = materialize(relaxed.join(tiles.select("id", "h", "w"), "id").select("id", "y", "x", "h", "w"))
    return tiles
