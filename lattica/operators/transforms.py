"""Point transforms as tables: parsed transforms, control points, and maps of points through them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions.geometry import rotate, shortest_decimal, similarity, similarity_inverse
from lattica.sources.tables import materialize

POINT = ["t_y", "t_x", "s_y", "s_x"]


def rigid_parameters(parsed: DataFrame) -> DataFrame:
    """(tf_id, angle, scale, dy, dx, c_y, c_x) of rigid, similarity and translation transforms (tf_id, transform_type, vp, fp)."""
    g = lambda c, i: F.get(c, F.lit(i))
    kind = F.col("transform_type")
    rigid, sim, leg = (kind.startswith(k) for k in ("Rigid2D", "CenteredSimilarity2D", "Legendre"))
    return parsed.filter(rigid | sim | leg).select(
        "tf_id",
        F.when(rigid, g("vp", 0)).when(sim, g("vp", 1)).otherwise(0.0).alias("angle"),
        F.when(sim, g("vp", 0)).otherwise(1.0).alias("scale"),
        F.when(rigid, g("vp", 2)).when(sim, g("vp", 5)).otherwise(g("fp", 1)).alias("dy"),
        F.when(rigid, g("vp", 1)).when(sim, g("vp", 4)).otherwise(g("fp", 0)).alias("dx"),
        F.when(rigid, g("fp", 1)).when(sim, g("vp", 3)).otherwise(g("fp", 3)).alias("c_y"),
        F.when(rigid, g("fp", 0)).when(sim, g("vp", 2)).otherwise(g("fp", 2)).alias("c_x"),
    )


def grid_points(parsed: DataFrame) -> DataFrame:
    """Control points of grid transforms: targets as written, sources spread over the image by row and column."""
    g = lambda i: F.get("fp", F.lit(i))
    rows = parsed.filter(F.col("transform_type").startswith("Grid")).select("tf_id", "vp", (g(1) + 1).cast("int").alias("gw"), (g(2) + 1).cast("int").alias("gh"), g(5).alias("w"), g(6).alias("h"))
    p = rows.select("tf_id", "gw", "gh", "w", "h", "vp", F.explode(F.sequence(F.lit(0), (F.size("vp") / 2 - 1).cast("int"))).alias("idx"))
    return p.select("tf_id", "idx", F.get("vp", F.col("idx") * 2 + 1).alias("t_y"), F.get("vp", F.col("idx") * 2).alias("t_x"), (F.expr("idx div gw") * F.col("h") / F.greatest(F.col("gh") - 1, F.lit(1))).alias("s_y"), ((F.col("idx") % F.col("gw")) * F.col("w") / F.greatest(F.col("gw") - 1, F.lit(1))).alias("s_x"))


def mesh_points(parsed: DataFrame) -> DataFrame:
    """Control points of mesh transforms: sources normalised to the image's box, targets as written."""
    g = lambda i: F.get("fp", F.lit(i))
    rows = parsed.filter(F.col("transform_type").startswith("Mesh")).select("tf_id", "vp", g(3).alias("x0"), g(4).alias("y0"), g(5).alias("w"), g(6).alias("h"))
    p = rows.filter(F.size("vp") >= 4).select("*", F.explode(F.sequence(F.lit(0), (F.size("vp") / 4 - 1).cast("int"))).alias("idx"))
    v = lambda k: F.get("vp", F.col("idx") * 4 + k)
    return p.select("tf_id", "idx", v(3).alias("t_y"), v(2).alias("t_x"), (F.col("y0") + v(1) * F.col("h")).alias("s_y"), (F.col("x0") + v(0) * F.col("w")).alias("s_x"))


def legendre_points(parsed: DataFrame) -> DataFrame:
    """The four corners of translations written as Legendre polynomials."""
    g = lambda i: F.get("fp", F.lit(i))
    rows = parsed.filter(F.col("transform_type").startswith("Legendre"))
    corner = lambda i, y, x: F.struct(F.lit(i).alias("idx"), (g(1) + y * 2 * g(3)).alias("t_y"), (g(0) + x * 2 * g(2)).alias("t_x"), (y * 2 * g(3)).alias("s_y"), (x * 2 * g(2)).alias("s_x"))
    return rows.select("tf_id", F.inline(F.array(*[corner(i, float(i // 2), float(i % 2)) for i in range(4)])))


def control_points(parsed: DataFrame) -> DataFrame:
    """Control points (tf_id, idx, t_y, t_x, s_y, s_x) of all transforms that have them."""
    return grid_points(parsed).unionByName(mesh_points(parsed)).unionByName(legendre_points(parsed))


def map_points(points: DataFrame, params: DataFrame, inverse: bool = False) -> DataFrame:
    """Points (tf_id, ..., y, x) through their rigid or similarity transforms; points of unknown transforms are dropped."""
    c = F.col
    f = similarity_inverse if inverse else similarity
    y, x = f(c("y"), c("x"), c("angle"), c("scale"), c("c_y"), c("c_x"), c("dy"), c("dx"))
    kept = [k for k in points.columns if k not in ("y", "x")]
    return points.join(params, "tf_id").select(*kept, y.alias("y"), x.alias("x"))


def fixed_bounds(cp: DataFrame) -> DataFrame:
    """Bounding box of each transform's targets and sources."""
    return cp.groupBy("tf_id").agg(*[f(c).alias(f"{n}_{c}") for c in POINT for n, f in (("min", F.min), ("max", F.max))])


def translated(cp: DataFrame, dy: float, dx: float, fixed: bool = True) -> DataFrame:
    """Targets (or sources) shifted."""
    y, x = ("t_y", "t_x") if fixed else ("s_y", "s_x")
    return cp.withColumn(y, F.col(y) + dy).withColumn(x, F.col(x) + dx)


def rotated(cp: DataFrame, angle: float, cy: float, cx: float) -> DataFrame:
    """Sources turned about a centre."""
    y, x = rotate(F.col("s_y") - cy, F.col("s_x") - cx, F.lit(angle))
    return cp.select(*[c for c in cp.columns if c not in ("s_y", "s_x")], (y + cy).alias("s_y"), (x + cx).alias("s_x"))


def flipped(cp: DataFrame, cy: float) -> DataFrame:
    """Sources mirrored about a horizontal line."""
    return cp.withColumn("s_y", 2 * cy - F.col("s_y"))


def scaled(cp: DataFrame, k: float, fixed: bool = True, warped: bool = True) -> DataFrame:
    for c in [*(["t_y", "t_x"] if fixed else []), *(["s_y", "s_x"] if warped else [])]:
        cp = cp.withColumn(c, F.col(c) * k)
    return cp


def without_duplicates(cp: DataFrame, digits: int = 3) -> DataFrame:
    """Control points without NaN, of equal rounded ones the first by idx."""
    good = cp.filter(~(F.isnan("t_y") | F.isnan("t_x") | F.isnan("s_y") | F.isnan("s_x")))
    keys = [F.round(c, digits).alias(f"r_{c}") for c in POINT]
    first = good.groupBy("tf_id", *keys).agg(F.min_by(F.struct("idx", *POINT), "idx").alias("p"))
    return first.select("tf_id", "p.idx", *[f"p.{c}" for c in POINT])


def to_zero_origin(cp: DataFrame) -> DataFrame:
    """Targets of all transforms shifted so that their box begins at (0, 0)."""
    box = F.broadcast(cp.agg(F.min("t_y").alias("oy"), F.min("t_x").alias("ox")))
    return cp.crossJoin(box).withColumn("t_y", F.col("t_y") - F.col("oy")).withColumn("t_x", F.col("t_x") - F.col("ox")).drop("oy", "ox")


def nearest_control(points: DataFrame, cp: DataFrame, cell: float) -> DataFrame:
    """(tf_id, q, idx, dist): the control point whose target lies nearest to each point (tf_id, q, y, x), the lower idx of equal ones.

    Points look in the 3 x 3 grid cells about their own; what is found within one cell's side is the nearest. The points
    without such a neighbour look again with cells four times as large, until all have found one; points of a transform
    without control points have no row.
    """
    around = F.explode(F.array(*[F.lit(d) for d in (-1, 0, 1)]))
    dist = F.hypot(F.col("y") - F.col("t_y"), F.col("x") - F.col("t_x"))

    def best(pairs: DataFrame) -> DataFrame:
        b = pairs.groupBy("tf_id", "q").agg(F.min(F.struct(dist.alias("dist"), F.col("idx"))).alias("b"))
        return b.select("tf_id", "q", "b.idx", "b.dist")

    def close(asked: DataFrame, side: float) -> DataFrame:
        grid = lambda c: F.floor(F.col(c) / side)
        near = asked.withColumn("gy", grid("y")).withColumn("gx", grid("x")).withColumn("o", around).withColumn("gy", F.col("gy") + F.col("o")).withColumn("o", around).withColumn("gx", F.col("gx") + F.col("o"))
        have = cp.select("tf_id", "idx", "t_y", "t_x", grid("t_y").alias("gy"), grid("t_x").alias("gx"))
        return best(near.join(have, ["tf_id", "gy", "gx"])).filter(F.col("dist") <= side)

    finite = lambda df, y, x: df.filter(f"abs({y}) < 1e300 and abs({x}) < 1e300")
    cp = finite(cp, "t_y", "t_x")
    todo = materialize(finite(points.select("tf_id", "q", "y", "x"), "y", "x").join(cp.select("tf_id").distinct(), "tf_id", "left_semi"))
    found, side = [], cell
    while not found or not todo.isEmpty():
        found.append(materialize(close(todo, side)))
        todo = materialize(todo.join(found[-1].select("tf_id", "q"), ["tf_id", "q"], "left_anti"))
        side *= 4
    return reduce(DataFrame.unionByName, found)


def transform_text(cp: DataFrame, digits: int = 3) -> DataFrame:
    """(tf_id, text): control targets of each transform as ``vp n x y ...``, numbers in their shortest form."""
    n = lambda c: shortest_decimal(F.col(f"p.{c}"), digits)
    rows = cp.groupBy("tf_id").agg(F.array_sort(F.collect_list(F.struct("idx", "t_x", "t_y"))).alias("points"))
    pair = lambda p: F.concat(shortest_decimal(p["t_x"], digits), F.lit(" "), shortest_decimal(p["t_y"], digits))
    return rows.select("tf_id", F.concat(F.lit("vp "), (F.size("points") * 2).cast("string"), F.lit(" "), F.array_join(F.transform("points", pair), " ")).alias("text"))


def corner_points(sizes: DataFrame) -> DataFrame:
    """Corners BL, BR, TL, TR of images (id, h, w, angle, dy, dx), turned about their centre and shifted."""
    at = lambda i, y, x: F.struct(F.lit(i).alias("corner"), (F.col("h") * y).alias("s_y"), (F.col("w") * x).alias("s_x"))
    c = sizes.select("*", F.inline(F.array(at(0, 0.0, 0.0), at(1, 0.0, 1.0), at(2, 1.0, 0.0), at(3, 1.0, 1.0))))
    y, x = similarity(F.col("s_y"), F.col("s_x"), F.col("angle"), F.lit(1.0), F.col("h") / 2, F.col("w") / 2, F.col("dy"), F.col("dx"))
    return c.select("id", "corner", y.alias("y"), x.alias("x"))


def triangle_metrics(tri: DataFrame) -> DataFrame:
    """Angles at A, B, C and centroid of triangles (tri, ay, ax, by, bx, cy, cx)."""
    from lattica.functions.geometry import arc_angle

    c = F.col
    a = F.abs(arc_angle(c("ay"), c("ax"), c("by"), c("bx"), c("cy"), c("cx")))
    b = F.abs(arc_angle(c("by"), c("bx"), c("ay"), c("ax"), c("cy"), c("cx")))
    return tri.select("tri", a.alias("angle_a"), b.alias("angle_b"), (3.141592653589793 - a - b).alias("angle_c"), ((c("ay") + c("by") + c("cy")) / 3).alias("m_y"), ((c("ax") + c("bx") + c("cx")) / 3).alias("m_x"))


def edited(cp: DataFrame, edits: DataFrame) -> DataFrame:
    """Control points after ``edits`` (tf_id, idx, action, t_y, t_x, s_y, s_x): ``remove`` drops a point, ``put`` adds or replaces one.

    A null in a put point leaves that coordinate as it was. Of several edits of one point the removal counts, else the greatest.
    """
    last = edits.groupBy("tf_id", "idx").agg(F.max(F.struct("action", *POINT)).alias("e"), F.max(F.when(F.col("action") == "remove", 1)).alias("gone"))
    both = cp.select("tf_id", "idx", F.struct(*POINT).alias("c")).join(last, ["tf_id", "idx"], "full").filter("gone is null")
    return both.select("tf_id", "idx", *[F.coalesce(f"e.{p}", f"c.{p}").alias(p) for p in POINT])


def rigid_of_records(records: DataFrame) -> DataFrame:
    """Rigid transforms (tf_id, angle, scale, dy, dx, c_y, c_x) of alignment records (tf_id, angle in degrees, peak_y, peak_x, h, w, h_fixed, w_fixed).

    The moving image turns about its centre; the peak shifts it from where both images share their centres.
    """
    c = F.col
    return records.select("tf_id", F.radians(-c("angle")).alias("angle"), F.lit(1.0).alias("scale"), ((c("h_fixed") - c("h")) / 2 + c("peak_y")).alias("dy"), ((c("w_fixed") - c("w")) / 2 + c("peak_x")).alias("dx"), (c("h") / 2).alias("c_y"), (c("w") / 2).alias("c_x"))


def layout_transforms(placed: DataFrame) -> DataFrame:
    """Control points of tiles (id, y, x, h, w) of a layout: the corners of each, where its centre lies at (y, x); the layout begins at (0, 0)."""
    at = lambda i, y, x: F.struct(F.lit(i).alias("idx"), (F.col("y") - F.col("h") / 2 + F.col("h") * y).alias("t_y"), (F.col("x") - F.col("w") / 2 + F.col("w") * x).alias("t_x"), (F.col("h") * y).alias("s_y"), (F.col("w") * x).alias("s_x"))
    corners = placed.select(F.col("id").alias("tf_id"), F.inline(F.array(at(0, 0.0, 0.0), at(1, 0.0, 1.0), at(2, 1.0, 0.0), at(3, 1.0, 1.0))))
    return to_zero_origin(corners)


def layout_mosaic(placed: DataFrame, digits: int = 3) -> DataFrame:
    """(id, entry) of each tile of a layout as a mosaic's text: its image and its corners as a grid transform."""
    n = lambda v: shortest_decimal(v, digits)
    points = layout_transforms(placed).groupBy("tf_id").agg(F.array_sort(F.collect_list(F.struct("idx", "t_x", "t_y"))).alias("p"), F.max("s_y").alias("h"), F.max("s_x").alias("w"))
    pair = F.array_join(F.transform("p", lambda p: F.concat(n(p["t_x"]), F.lit(" "), n(p["t_y"]))), " ")
    text = F.concat(F.lit("image: "), F.col("tf_id").cast("string"), F.lit(".png GridTransform_double_2_2 vp 8 "), pair, F.lit(" fp 7 0 1 1 0 0 "), n(F.col("w")), F.lit(" "), n(F.col("h")))
    return points.select(F.col("tf_id").alias("id"), text.alias("entry"))
