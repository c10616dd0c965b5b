"""More queries for the engine's own operators, each over whole tables, with the SQL that gives the same rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions import geometry as G
from lattica.operators import grids, kernels, layout, mesh, records, refine, transforms
from lattica.operators import rectangles as rect
from lattica.plans import views as V
from lattica.plans.reference import query, r
from lattica.sources.tables import load


@query(f"""WITH {V.TILES} SELECT a.id AS a, b.id AS b, a.max_x>b.min_x AND a.min_x<b.max_x AND a.max_y>b.min_y AND a.min_y<b.max_y AS intersects, greatest(a.min_y,b.min_y)<least(a.max_y,b.max_y) AND greatest(a.min_x,b.min_x)<least(a.max_x,b.max_x) AS valid FROM tiles a JOIN tiles b ON b.id=a.id+1""")
def rect_intersects(spark: SparkSession, d: str) -> DataFrame:
    """Whether each tile intersects the next one, and whether their common part is a valid rectangle."""
    t = V.tiles(spark, d).drop("p_size")
    a = t.select((F.col("id") + 1).alias("b"), F.col("id").alias("a"), *G.Rect.of().columns("a_"))
    b = t.select(F.col("id").alias("b"), *G.Rect.of().columns("b_"))
    x, y = G.Rect.of("a_"), G.Rect.of("b_")
    return a.join(b, "b").select("a", "b", x.intersects(y).alias("intersects"), x.clip(y).valid().alias("valid"))


@query("""WITH s AS (SELECT DISTINCT image_id, h, image_id%3000-500 AS start, 256+image_id%900 AS n FROM images WHERE h IS NOT NULL)
SELECT image_id, CASE WHEN n<=h THEN least(greatest(start,0),h-n) END AS roi_begin, CASE WHEN n<=h THEN least(greatest(start,0),h-n)+n END AS roi_end, greatest(start,0) AS cut_begin, greatest(greatest(start,0),least(start+n,h)) AS cut_end FROM s""")
def roi_ranges(spark: SparkSession, d: str) -> DataFrame:
    s = load(spark, d, "images").filter("h is not null").select("image_id", "h").distinct()
    start, n = F.col("image_id") % 3000 - 500, F.col("image_id") % 900 + 256
    made = grids.range_columns(start, n, F.col("h"), F.lit(0))
    return s.select("image_id", *[c.alias(a) for c, a in zip(made, ("roi_begin", "roi_end", "cut_begin", "cut_end"), strict=True)])


@query(f"""WITH {V.TILES}, {V.PAIRS}, s AS (SELECT a AS id, 0 AS side, a, b FROM pairs UNION ALL SELECT b, 1, a, b FROM pairs), n AS (SELECT id, count(*) AS n FROM s GROUP BY id)
SELECT s.a, s.b, max(CASE WHEN side=0 THEN n END) AS n_a, max(CASE WHEN side=1 THEN n END) AS n_b FROM s JOIN n USING (id) GROUP BY s.a, s.b""")
def overlap_fan_out(spark: SparkSession, d: str) -> DataFrame:
    """Each pair as two rows of a tile and its side, so that a tile is met once; what is found per tile joins back to the pair."""
    p = rect.overlapping_pairs(V.tiles(spark, d), V.CELL).select("a", "b")
    sides = p.select("a", "b", F.inline(F.array(F.struct(F.lit(0).alias("side"), F.col("a").alias("id")), F.struct(F.lit(1).alias("side"), F.col("b").alias("id")))))
    per = sides.groupBy("id").agg(F.count("*").alias("n"))
    back = sides.join(per, "id")
    return back.groupBy("a", "b").agg(*[F.max(F.when(F.col("side") == k, F.col("n"))).alias(c) for k, c in ((0, "n_a"), (1, "n_b"))])


@query(f"""WITH {V.TILES}, {V.PAIRS} SELECT a, b FROM pairs JOIN part p ON p.p_partkey=a JOIN part q ON q.p_partkey=b WHERE p.p_size/50.0>=0.35 AND q.p_size/50.0>=0.35""")
def feature_filter(spark: SparkSession, d: str) -> DataFrame:
    """Pairs both of whose tiles score enough."""
    t = V.tiles(spark, d)
    good = t.filter(F.col("p_size") / 50.0 >= 0.35).select("id")
    p = rect.overlapping_pairs(t, V.CELL).select("a", "b")
    return p.join(good.withColumnRenamed("id", "a"), "a", "left_semi").join(good.withColumnRenamed("id", "b"), "b", "left_semi").select("a", "b")


@query("""SELECT DISTINCT stat_id, px_min=px_max OR px_max=0 AS solid, CASE WHEN px_min=px_max OR px_max=0 THEN 0.0 ELSE 1.0 END::DOUBLE AS weight FROM image_stats WHERE isfinite(px_min) AND isfinite(px_max)""")
def solid_colour(spark: SparkSession, d: str) -> DataFrame:
    """Images of one colour only, which can't be registered and weigh nothing."""
    s = load(spark, d, "image_stats").filter("px_min is not null and px_max is not null and not isnan(px_min) and not isnan(px_max) and abs(px_min) <> double('Infinity') and abs(px_max) <> double('Infinity')")
    solid = (F.col("px_min") == F.col("px_max")) | (F.col("px_max") == 0)
    return s.select("stat_id", solid.alias("solid"), F.when(solid, 0.0).otherwise(1.0).alias("weight")).distinct()


@query(f"""WITH {V.PIXELS}, e AS (SELECT image_id, min(v) AS lo, max(v) AS hi FROM pixels GROUP BY image_id) SELECT image_id, lo, hi, count(*) FILTER (WHERE v=lo) AS n_lo, count(*) FILTER (WHERE v=hi) AS n_hi FROM pixels JOIN e USING (image_id) GROUP BY ALL""")
def image_extrema(spark: SparkSession, d: str) -> DataFrame:
    i = V.image_arrays(spark, d)
    lo, hi = F.array_min("data"), F.array_max("data")
    times = lambda x: F.size(F.filter("data", lambda v: v == x)).cast("bigint")
    return i.select("image_id", lo.alias("lo"), hi.alias("hi"), times(lo).alias("n_lo"), times(hi).alias("n_hi"))


@query(f"""WITH {V.PIXELS}, q AS (SELECT image_id, quantile_cont(v, 0.9) AS cut FROM pixels GROUP BY image_id) SELECT image_id, y, x, round(v,6)+0.0 AS v FROM pixels JOIN q USING (image_id) WHERE v>=cut""")
def correlation_threshold(spark: SparkSession, d: str) -> DataFrame:
    """Pixels of each correlation image at or above its percentile."""
    px = V.pixels(spark, d)
    cut = px.groupBy("image_id").agg(F.percentile("v", 0.9).alias("cut"))
    return px.join(cut, "image_id").filter("v >= cut").select("image_id", "y", "x", r("v"))


@query(f"""WITH {V.PIXELS}, l AS (SELECT image_id, floor(abs(v)*100)::INT AS intensity, count(*) AS n FROM pixels GROUP BY ALL) SELECT image_id::VARCHAR AS path, intensity, n FROM l""")
def histogram_text(spark: SparkSession, d: str) -> DataFrame:
    """Histograms parsed from their text lines, which are written from the images first."""
    px = V.pixels(spark, d).groupBy("image_id", F.floor(F.abs("v") * 100).cast("int").alias("i")).count()
    line = F.format_string("  %d: (%d,%d,%d) #000000 gray(%d)", "count", "i", "i", "i", "i")
    lines = px.select(F.col("image_id").cast("string").alias("path"), line.alias("line"))
    return records.histogram_lines(lines.unionByName(lines.select("path", F.lit("Histogram:").alias("line"))))


@query("""WITH s AS (SELECT DISTINCT image_id, image_full_path, h, w, registered_at FROM images WHERE h IS NOT NULL AND w IS NOT NULL) SELECT image_full_path, arg_max(struct_pack(h:=h,w:=w), row(registered_at, image_id)).h AS h, arg_max(struct_pack(h:=h,w:=w), row(registered_at, image_id)).w AS w FROM s GROUP BY image_full_path""")
def image_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Size of each image file, as registered last: asked of the catalogue, no pixel is read."""
    s = load(spark, d, "images").filter("h is not null and w is not null")
    last = s.groupBy("image_full_path").agg(F.max_by(F.struct("h", "w"), F.struct("registered_at", "image_id")).alias("s"))
    return last.select("image_full_path", "s.h", "s.w")


@query(f"""WITH {V.CONTROL} SELECT tf_id, idx, t_y + CASE WHEN idx%5=1 THEN 10 ELSE 0 END AS t_y, t_x, s_y, s_x FROM control_points WHERE idx%5<>0 UNION ALL SELECT tf_id, idx+1000000, t_y, t_x, s_y, s_x FROM control_points WHERE idx%7=0""")
def control_edits(spark: SparkSession, d: str) -> DataFrame:
    """Control points added, moved and removed in one go."""
    cp = V.control_points(spark, d)
    none = lambda *cs: [F.lit(None).cast("double").alias(c) for c in cs]
    gone = cp.filter("idx % 5 = 0").select("tf_id", "idx", F.lit("remove").alias("action"), *none(*transforms.POINT))
    moved = cp.filter("idx % 5 = 1").select("tf_id", "idx", F.lit("put").alias("action"), (F.col("t_y") + 10).alias("t_y"), *none("t_x", "s_y", "s_x"))
    new = cp.filter("idx % 7 = 0").select("tf_id", (F.col("idx") + 1_000_000).alias("idx"), F.lit("put").alias("action"), *transforms.POINT)
    return transforms.edited(cp, gone.unionByName(moved).unionByName(new))


@query(f"""WITH {V.ALIGNMENT} SELECT record_id AS tf_id, round(radians(-angle),6)+0.0 AS angle, round(peak_y-25,4)+0.0 AS dy, round(peak_x+50,4)+0.0 AS dx, 125.0::DOUBLE AS c_y, 150.0::DOUBLE AS c_x FROM alignment""")
def rigid_builder(spark: SparkSession, d: str) -> DataFrame:
    """Rigid transforms of alignment records between images of 250 x 300 and 200 x 400."""
    a = V.alignment(spark, d).select(F.col("record_id").alias("tf_id"), "angle", "peak_y", "peak_x", *[F.lit(float(v)).alias(c) for c, v in (("h", 250), ("w", 300), ("h_fixed", 200), ("w_fixed", 400))])
    return transforms.rigid_of_records(a).select("tf_id", r("angle"), r("dy", 4), r("dx", 4), "c_y", "c_x")


def _placed(spark: SparkSession, d: str) -> DataFrame:
    return V.nodes(spark, d).withColumns({"h": F.lit(100.0), "w": F.lit(100.0)})


_CORNERS = f"""{V.TILES}, {V.NODES}, o AS (SELECT min(y) AS oy, min(x) AS ox FROM nodes), c AS (SELECT id AS tf_id, i::INT AS idx, y-oy+(i//2)*100.0::DOUBLE AS t_y, x-ox+(i%2)*100.0::DOUBLE AS t_x, (i//2)*100.0::DOUBLE AS s_y, (i%2)*100.0::DOUBLE AS s_x FROM nodes, o, range(4) t(i))"""


@query(f"WITH {_CORNERS} SELECT * FROM c")
def layout_transforms(spark: SparkSession, d: str) -> DataFrame:
    return transforms.layout_transforms(_placed(spark, d)).select("tf_id", "idx", *transforms.POINT)


@query(f"""WITH {_CORNERS} SELECT tf_id AS id, 'image: '||tf_id||'.png GridTransform_double_2_2 vp 8 '||string_agg(t_x::BIGINT||' '||t_y::BIGINT, ' ' ORDER BY idx)||' fp 7 0 1 1 0 0 100 100' AS entry FROM c GROUP BY tf_id""")
def layout_mosaic(spark: SparkSession, d: str) -> DataFrame:
    return transforms.layout_mosaic(_placed(spark, d))


@query()
def component_merge(spark: SparkSession, d: str) -> DataFrame:
    """Five displaced parts of a layout brought together by the offsets between them, until none is left apart."""
    p = F.col("id") % 5
    placed = V.nodes(spark, d).select("id", p.alias("part"), (F.col("y") + p * 7).alias("y"), (F.col("x") - p * 5).alias("x"))
    return layout.merge_all_parts(placed, V.edges(spark, d)).select("id", "part", r("y", 3), r("x", 3))


def _asked(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    cp = V.control_points(spark, d)
    return cp.select("tf_id", F.col("idx").alias("q"), (F.col("t_y") + 1.5).alias("y"), (F.col("t_x") + 2.5).alias("x")), cp


@query()
def multiquadric_map(spark: SparkSession, d: str) -> DataFrame:
    q, cp = _asked(spark, d)
    return mesh.map_by(q, cp, mesh.multiquadric).select("tf_id", "q", r("y", 3), r("x", 3))


@query()
def local_rigid(spark: SparkSession, d: str) -> DataFrame:
    return mesh.local_rigid(*_asked(spark, d)).select("tf_id", "q", *[r(c, 3) for c in ("angle", "dy", "dx", "c_y", "c_x")])


@query()
def grid_resample(spark: SparkSession, d: str) -> DataFrame:
    """Each mesh as a regular grid of points 25 apart over its source box."""
    g = mesh.grid_by(V.control_points(spark, d), 25.0)
    return g.select("tf_id", (F.col("i") * 10_000 + F.col("j")).alias("cell"), r("y", 3), r("x", 3))


@query()
def peak_offsets(spark: SparkSession, d: str) -> DataFrame:
    """Heaviest bright part of each image: its offset from the centre and its weight."""

    def peak(row: dict) -> dict:
        y, x, weight = kernels.find_peak(np.abs(np.asarray(row["data"], float).reshape(row["h"], row["w"])), percent=90.0)
        return {"image_id": row["image_id"], "y": y, "x": x, "weight": weight}

    return kernels.rows_to(V.image_arrays(spark, d), "image_id bigint, y double, x double, weight double", peak).select("image_id", r("y", 4), r("x", 4), r("weight", 4))


@query()
def overlap_masks(spark: SparkSession, d: str) -> DataFrame:
    """Shifts of each image's padded correlation at which between a quarter and three quarters are shared."""

    def shifts(row: dict) -> dict:
        n = 8 + row["image_id"] % 5
        mask = kernels.overlap_mask((8, 8), (8, 6), (2 * n, 2 * n), 0.25, 0.75)
        return {"image_id": row["image_id"], "n_shifts": int(mask.sum()), "n_all": mask.size}

    return kernels.rows_to(V.image_arrays(spark, d).select("image_id"), "image_id bigint, n_shifts bigint, n_all bigint", shifts)


@query()
def noise_fills(spark: SparkSession, d: str) -> DataFrame:
    """Each image padded for correlation, with noise outside a mask and at its extrema; what lies inside stays as it is."""

    def fill(row: dict) -> dict:
        v, k = np.asarray(row["data"], float).reshape(row["h"], row["w"]), row["image_id"]
        mask = np.abs(np.add.outer(np.arange(row["h"]), -np.arange(row["w"]))) < 4
        pad, masked, ends = kernels.padded(v, 16, 16, k), kernels.masked_with_noise(v, mask, k), kernels.extrema_with_noise(v, k)
        kept = bool((pad[4:12, 4:12] == v).all() and (masked[mask] == v[mask]).all())
        return {"image_id": k, "kept": kept, "within": bool(pad.min() >= v.min() and pad.max() <= v.max() and ends.min() > v.min() and ends.max() < v.max())}

    return kernels.rows_to(V.image_arrays(spark, d), "image_id bigint, kept boolean, within boolean", fill)


@query()
def grid_refinement(spark: SparkSession, d: str) -> DataFrame:
    """Control points of each label's mean image against itself moved by a row, refined on a grid of points."""
    mean = V.pixels(spark, d).groupBy("label", "y", "x").agg(F.avg("v").alias("v")).groupBy("label").agg(F.array_sort(F.collect_list(F.struct("y", "x", "v"))).alias("p"))

    def refined(row: dict) -> dict:
        v = np.kron(np.asarray(row["data"], float).reshape(8, 8), np.ones((4, 4)))
        corners = np.array([(y, x, y, x) for y in (0.0, 31.0) for x in (0.0, 31.0)])
        out = refine.refine(v, np.roll(v, 1, axis=0), corners, cell=16, spacing=16, passes=3)
        return {"label": row["label"], "n": len(out), "dy": float(np.mean(out[:, 0] - out[:, 2])), "dx": float(np.mean(out[:, 1] - out[:, 3]))}

    images = mean.select("label", F.transform("p", lambda p: p["v"]).alias("data"))
    return kernels.rows_to(images, f"label {dict(images.dtypes)['label']}, n bigint, dy double, dx double", refined).select("label", "n", r("dy", 3), r("dx", 3))
