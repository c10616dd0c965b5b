"""Queries for the engine's own operators, each over whole tables, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions import geometry as G
from lattica.functions.mosaic_text import entry_file, entry_transform
from lattica.operators import grids, kernels, layout, mesh, parsing, pixels, records, sections, transforms
from lattica.operators import rectangles as rect
from lattica.plans import views as V
from lattica.sources.tables import load, materialize

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r(c: str, n: int = 6) -> F.Column:
    """Rounded for comparison, without negative zeros."""
    return (F.round(c, n) + 0.0).alias(c)


def _bounds(prefix: str = "") -> list[F.Column]:
    return [r(prefix + s) for s in G.SIDES]


# Rectangles


@query(f"""WITH {V.TILES} SELECT id, max_y-min_y AS h, max_x-min_x AS w, (max_y-min_y)*(max_x-min_x) AS area, (min_y+max_y)/2 AS c_y, (min_x+max_x)/2 AS c_x FROM tiles""")
def rect_props(spark: SparkSession, d: str) -> DataFrame:
    t = G.Rect.of()
    return V.tiles(spark, d).select("id", t.height.alias("h"), t.width.alias("w"), t.area.alias("area"), t.center_y.alias("c_y"), t.center_x.alias("c_x"))


@query(f"""WITH {V.TILES}, s AS (SELECT id, (min_y+max_y)/2-30.25 AS y0, (min_x+max_x)/2-30.25 AS x0 FROM tiles)
SELECT id, y0 AS min_y, x0 AS min_x, y0+60.5 AS max_y, x0+60.5 AS max_x, floor(y0)::DOUBLE AS round_min_y, floor(x0)::DOUBLE AS round_min_x, floor(y0)+61.0 AS round_max_y, floor(x0)+61.0 AS round_max_x FROM s""")
def rect_resize_round(spark: SparkSession, d: str) -> DataFrame:
    t = G.Rect.of().with_size(F.lit(60.5), F.lit(60.5))
    return V.tiles(spark, d).select("id", *t.columns(), *t.safe_round().columns("round_"))


@query(f"""WITH {V.TILES} SELECT id, min_y*0.5 AS o_min_y, min_x*0.5 AS o_min_x, max_y*0.5 AS o_max_y, max_x*0.5 AS o_max_x, (min_y+max_y)/2-25 AS c_min_y, (min_x+max_x)/2-25 AS c_min_x, (min_y+max_y)/2+25 AS c_max_y, (min_x+max_x)/2+25 AS c_max_x,
 min_y+3 AS t_min_y, min_x-4 AS t_min_x, max_y+3 AS t_max_y, max_x-4 AS t_max_x FROM tiles""")
def rect_scale_translate(spark: SparkSession, d: str) -> DataFrame:
    t, half = G.Rect.of(), F.lit(0.5)
    return V.tiles(spark, d).select("id", *t.scale_on_origin(half).columns("o_"), *t.scale_on_center(half).columns("c_"), *t.translate(F.lit(3.0), F.lit(-4.0)).columns("t_"))


@query(f"""WITH {V.TILES}, {V.PAIRS} SELECT a, b, least(ay0,by0) AS u_min_y, least(ax0,bx0) AS u_min_x, greatest(ay1,by1) AS u_max_y, greatest(ax1,bx1) AS u_max_x, min_y, min_x, max_y, max_x FROM pairs""")
def rect_union_intersect(spark: SparkSession, d: str) -> DataFrame:
    a, b = G.Rect.of("a_"), G.Rect.of("b_")
    return rect.overlapping_pairs(V.tiles(spark, d), V.CELL).select("a", "b", *a.union(b).columns("u_"), *a.clip(b).columns())


@query(f"""WITH {V.TILES}, {V.PAIRS} SELECT a, b, round((max_y-min_y)*(max_x-min_x)/10000,6) AS overlap, round((max_y-min_y)*(max_x-min_x)/10000,6) AS overlap_norm, min_y, min_x, max_y, max_x, dy, dx FROM pairs WHERE (max_y-min_y)*(max_x-min_x)/10000 > 0.05""")
def tile_overlaps(spark: SparkSession, d: str) -> DataFrame:
    return rect.overlaps(V.tiles(spark, d), V.CELL, 0.05).select("a", "b", r("overlap"), r("overlap_norm"), *G.SIDES, "dy", "dx")


@query(f"""WITH {V.TILES}, {V.PAIRS}, both_ AS (SELECT a AS id, b AS o FROM pairs UNION ALL SELECT b, a FROM pairs) SELECT id, count(*) AS n, string_agg(o::VARCHAR, ',' ORDER BY o) AS others FROM both_ GROUP BY id""")
def tile_neighbours(spark: SparkSession, d: str) -> DataFrame:
    n = rect.neighbours(rect.overlapping_pairs(V.tiles(spark, d), V.CELL))
    return n.select("id", "n", F.array_join(F.col("others").cast("array<string>"), ",").alias("others"))


@query(f"""WITH {V.TILES}, small AS (SELECT id, min_y, min_x, min_y+78 AS max_y, min_x+78 AS max_x FROM tiles), p AS (SELECT a.id AS a, b.id AS b FROM small a JOIN small b ON a.id<b.id AND a.max_x>b.min_x AND a.min_x<b.max_x AND a.max_y>b.min_y AND a.min_y<b.max_y)
SELECT id FROM small EXCEPT (SELECT a FROM p UNION SELECT b FROM p)""")
def isolated_tiles(spark: SparkSession, d: str) -> DataFrame:
    t = V.tiles(spark, d).withColumn("max_y", F.col("min_y") + 78).withColumn("max_x", F.col("min_x") + 78)
    return rect.isolated(t, rect.overlapping_pairs(t, V.CELL))


@query(f"""WITH {V.TILES}, {V.PAIRS}, moved AS (SELECT id, p_size, min_y + (CASE WHEN id%7=0 THEN 40 ELSE 0 END) AS min_y, min_x, max_y + (CASE WHEN id%7=0 THEN 40 ELSE 0 END) AS max_y, max_x FROM tiles),
n AS (SELECT a.id AS a, b.id AS b, (b.min_y+b.max_y)/2-(a.min_y+a.max_y)/2 AS dy, (b.min_x+b.max_x)/2-(a.min_x+a.max_x)/2 AS dx FROM moved a JOIN moved b ON a.id<b.id AND a.max_x>b.min_x AND a.min_x<b.max_x AND a.max_y>b.min_y AND a.min_y<b.max_y)
SELECT coalesce(o.a,n.a) AS a, coalesce(o.b,n.b) AS b, CASE WHEN o.a IS NULL THEN 'new' WHEN n.a IS NULL THEN 'removed' WHEN sqrt((n.dy-o.dy)**2+(n.dx-o.dx)**2)>=1 THEN 'changed' ELSE 'unchanged' END AS state FROM pairs o FULL JOIN n ON o.a=n.a AND o.b=n.b""")
def overlap_delta(spark: SparkSession, d: str) -> DataFrame:
    t = V.tiles(spark, d)
    up = F.when(F.col("id") % 7 == 0, 40.0).otherwise(0.0)
    moved = t.withColumn("min_y", F.col("min_y") + up).withColumn("max_y", F.col("max_y") + up)
    return rect.pair_delta(rect.overlaps(t, V.CELL), rect.overlaps(moved, V.CELL))


@query(f"""WITH {V.TILES} SELECT id, greatest(min_y,205.5) AS min_y, greatest(min_x,150.0) AS min_x, least(max_y,700.0) AS max_y, least(max_x,1900.25) AS max_x FROM tiles WHERE max_y>205.5 AND min_y<700 AND max_x>150 AND min_x<1900.25""")
def region_tiles(spark: SparkSession, d: str) -> DataFrame:
    return rect.region_clip(V.tiles(spark, d), G.Rect(*[F.lit(v) for v in (205.5, 150.0, 700.0, 1900.25)]))


@query(f"WITH {V.TILES} SELECT min(min_y) AS min_y, min(min_x) AS min_x, max(max_y) AS max_y, max(max_x) AS max_x FROM tiles")
def mosaic_bounds(spark: SparkSession, d: str) -> DataFrame:
    return rect.bounds(V.tiles(spark, d))


@query(f"WITH {V.TILES}, o AS (SELECT min(min_y) AS oy, min(min_x) AS ox FROM tiles) SELECT id, min_y-oy AS min_y, min_x-ox AS min_x, max_y-oy AS max_y, max_x-ox AS max_x FROM tiles, o")
def zero_origin(spark: SparkSession, d: str) -> DataFrame:
    return rect.to_zero_origin(V.tiles(spark, d))


@query(f"""WITH {V.TILES}, b AS (SELECT id, id%10*1.0 AS z, min_y, min_x, max_y, max_x FROM tiles) SELECT id FROM b WHERE z+1>=4 AND z<=5 AND max_y>=300 AND min_y<=600 AND max_x>=300 AND min_x<=2000""")
def box_touch(spark: SparkSession, d: str) -> DataFrame:
    z = (F.col("id") % 10).cast("double")
    a = [z, F.col("min_y"), F.col("min_x"), z + 1, F.col("max_y"), F.col("max_x")]
    return V.tiles(spark, d).filter(G.boxes_touch(a, [F.lit(v) for v in (4.0, 300.0, 300.0, 5.0, 600.0, 2000.0)])).select("id")


_SIZES = "sizes AS (SELECT DISTINCT image_id AS id, h, w FROM images WHERE h IS NOT NULL AND w IS NOT NULL)"


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "images").filter("h is not null and w is not null").select(F.col("image_id").alias("id"), "h", "w").distinct()


@query(f"WITH {_SIZES} SELECT id, ceil(h/512.0)::INT AS rows, ceil(w/512.0)::INT AS cols FROM sizes")
def tile_grid(spark: SparkSession, d: str) -> DataFrame:
    return grids.tile_grid(_sizes(spark, d), 512.0)


@query(f"""WITH {_SIZES}, dims AS (SELECT *, (ceil(h/1024.0)+1)::INT AS nr, (ceil(w/1024.0)+1)::INT AS nc FROM sizes) SELECT id, i::INT AS "row", j::INT AS col, floor(i*(h-1)/(nr-1))::BIGINT AS y, floor(j*(w-1)/(nc-1))::BIGINT AS x FROM dims, unnest(range(nr)) t(i), unnest(range(nc)) u(j)""")
def itk_grid(spark: SparkSession, d: str) -> DataFrame:
    return grids.edge_grid(_sizes(spark, d), 1024.0)


@query(f"""WITH {_SIZES}, dims AS (SELECT *, ceil(h/1024.0)::INT AS nr, ceil(w/1024.0)::INT AS nc FROM sizes) SELECT id, i::INT AS "row", j::INT AS col, round_even(i*1024.0::DOUBLE+512-(nr*1024-h)/2.0::DOUBLE,0)::BIGINT AS y, round_even(j*1024.0::DOUBLE+512-(nc*1024-w)/2.0::DOUBLE,0)::BIGINT AS x FROM dims, unnest(range(nr)) t(i), unnest(range(nc)) u(j)""")
def centered_grid(spark: SparkSession, d: str) -> DataFrame:
    return grids.centred_grid(_sizes(spark, d), 1024.0)


@query("SELECT DISTINCT image_id AS id, 4096.0/greatest(h,w) AS scale FROM images WHERE h IS NOT NULL AND w IS NOT NULL")
def largest_dimension_scale(spark: SparkSession, d: str) -> DataFrame:
    return _sizes(spark, d).select("id", (4096.0 / F.greatest("h", "w")).alias("scale"))


# Pixels


@query(f"WITH {V.PIXELS} SELECT image_id, round(quantile_cont(v,0.5),6)+0.0 AS median, round(avg(v),6)+0.0 AS mean, round(stddev_pop(v),6)+0.0 AS std, round(min(v),6)+0.0 AS min, round(max(v),6)+0.0 AS max FROM pixels GROUP BY image_id")
def image_stats(spark: SparkSession, d: str) -> DataFrame:
    return pixels.image_stats(V.pixels(spark, d)).select("image_id", *[r(c) for c in ("median", "mean", "std", "min", "max")])


@query(f"WITH {V.PIXELS} SELECT count(v) AS n, round(avg(v),6)+0.0 AS mean, round(stddev_pop(v),6) AS std, round(min(v),6)+0.0 AS min, round(max(v),6)+0.0 AS max FROM pixels")
def image_stats_merged(spark: SparkSession, d: str) -> DataFrame:
    return pixels.merged_stats(V.pixels(spark, d)).select("n", r("mean"), r("std"), r("min"), r("max"))


@query(f"WITH {V.PIXELS} SELECT image_id, least(floor((v+1)/(2.0/64)),63)::INT AS bin, count(*) AS n FROM pixels WHERE v BETWEEN -1 AND 1 GROUP BY ALL")
def image_histogram(spark: SparkSession, d: str) -> DataFrame:
    return pixels.histogram(V.pixels(spark, d), 64, -1.0, 1.0)


_HIST = f"{V.PIXELS}, hist AS (SELECT image_id, least(floor((v+1)/(2.0/64)),63)::INT AS bin, count(*) AS n FROM pixels WHERE v BETWEEN -1 AND 1 GROUP BY ALL)"


@query(f"WITH {_HIST} SELECT bin, sum(n)::BIGINT AS n, coalesce(sum(sum(n)) OVER (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0)::BIGINT AS below FROM hist GROUP BY bin")
def histogram_merged(spark: SparkSession, d: str) -> DataFrame:
    return pixels.merged_histogram(pixels.histogram(V.pixels(spark, d), 64, -1.0, 1.0))


@query(f"""WITH {_HIST}, run AS (SELECT *, sum(n) OVER (PARTITION BY image_id ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY image_id) AS total FROM hist)
SELECT image_id, round(-1+least(min(bin)+1,64)*(2.0/64),6) AS cutoff FROM run WHERE upto > total*0.9 GROUP BY image_id""")
def intensity_cutoff(spark: SparkSession, d: str) -> DataFrame:
    return pixels.intensity_at(pixels.histogram(V.pixels(spark, d), 64, -1.0, 1.0), 0.9, 64, -1.0, 1.0).select("image_id", r("cutoff"))


@query(f"""WITH {V.PIXELS}, b AS (SELECT image_id, y//2 AS by_, x//2 AS bx_, stddev_pop(v) AS sd FROM pixels GROUP BY ALL) SELECT image_id, round(sum(sd),6) AS score FROM b WHERE by_*2<2 OR by_*2>=6 OR bx_*2<2 OR bx_*2>=6 GROUP BY image_id""")
def prune_score(spark: SparkSession, d: str) -> DataFrame:
    return pixels.prune_score(V.pixels(spark, d), 2, 8, 8, 0.25).select("image_id", r("score"))


_NORM = f"{V.PIXELS}, norm AS (SELECT p.image_id, label, y, x, coalesce((v-lo)/nullif(hi-lo,0),0) AS v FROM pixels p JOIN (SELECT image_id, min(v) AS lo, max(v) AS hi FROM pixels GROUP BY image_id) e USING (image_id))"


@query(f"WITH {_NORM} SELECT image_id, y, x, round(v,6)+0.0 AS v FROM norm")
def normalise(spark: SparkSession, d: str) -> DataFrame:
    return pixels.normalised(V.pixels(spark, d)).select("image_id", "y", "x", r("v"))


@query(f"WITH {_NORM} SELECT image_id, 7-y AS y, 7-x AS x, round(1-pow(greatest(least((v-0.1)/(0.9-0.1),1),0),1/2.0),6)+0.0 AS v FROM norm")
def level_gamma_flip(spark: SparkSession, d: str) -> DataFrame:
    p = pixels.level_gamma(pixels.normalised(V.pixels(spark, d)), 0.1, 0.9, 2.0, invert=True)
    return pixels.flipped(p, 8, 8, flip=True, flop=True).select("image_id", "y", "x", r("v"))


@query(f"WITH {V.PIXELS} SELECT y, x, round(max(v),6) AS v FROM pixels GROUP BY y, x")
def shade_bright(spark: SparkSession, d: str) -> DataFrame:
    return pixels.shade_image(V.pixels(spark, d)).select("y", "x", r("v"))


@query(f"WITH {V.PIXELS}, low AS (SELECT y, x, min(v) AS v FROM pixels GROUP BY y, x) SELECT y, x, round(v-(SELECT min(v) FROM low),6)+0.0 AS v FROM low")
def shade_dark(spark: SparkSession, d: str) -> DataFrame:
    return pixels.shade_image(V.pixels(spark, d), bright=False).select("y", "x", r("v"))


@query(f"""WITH {_NORM}, shade AS (SELECT y, x, max(v) AS s FROM norm GROUP BY y, x), most AS (SELECT image_id, max(v) AS m FROM norm GROUP BY image_id)
SELECT image_id, y, x, round(greatest(least(coalesce(v/nullif(m,0)/nullif(s/(SELECT max(s) FROM shade),0),0),1),0),6)+0.0 AS v FROM norm JOIN shade USING (y,x) JOIN most USING (image_id)""")
def shade_correct(spark: SparkSession, d: str) -> DataFrame:
    n = pixels.normalised(V.pixels(spark, d))
    return pixels.shade_corrected(n, pixels.shade_image(n)).select("image_id", "y", "x", r("v"))


@query(f"""WITH {_NORM}, low AS (SELECT y, x, min(v) AS s FROM norm GROUP BY y, x) SELECT image_id, y, x, round(v-(s-(SELECT min(s) FROM low)),6)+0.0 AS v FROM norm JOIN low USING (y,x)""")
def shade_correct_dark(spark: SparkSession, d: str) -> DataFrame:
    n = pixels.normalised(V.pixels(spark, d))
    return pixels.shade_corrected(n, pixels.shade_image(n, bright=False), bright=False).select("image_id", "y", "x", r("v"))


@query(f"""WITH {V.PIXELS} SELECT image_id, (y//4)::INT AS cy, (x//4)::INT AS cx, count(*) FILTER (WHERE (y+x+label)%5<>0)/16.0::DOUBLE AS coverage FROM pixels GROUP BY ALL HAVING count(*) FILTER (WHERE (y+x+label)%5<>0)/16.0 > 0.8""")
def masked_cells(spark: SparkSession, d: str) -> DataFrame:
    m = V.pixels(spark, d).withColumn("valid", (F.col("y") + F.col("x") + F.col("label")) % 5 != 0)
    return pixels.cell_coverage(m, 4, 0.8)


@query(f"""WITH {V.PIXELS} SELECT i.image_id, y::INT AS y, x::INT AS x, round(coalesce(v,-9.0),6)+0.0 AS v FROM (SELECT DISTINCT image_id FROM pixels) i CROSS JOIN range(6) a(y) CROSS JOIN range(5) b(x) LEFT JOIN (SELECT image_id, y-5 AS y, x+1 AS x, v FROM pixels) p USING (image_id, y, x)""")
def crop_pad(spark: SparkSession, d: str) -> DataFrame:
    return pixels.crop(V.pixels(spark, d), 5, -1, 6, 5, -9.0).select("image_id", "y", "x", r("v"))


@query(f"""WITH {V.PIXELS} SELECT image_id, (y//3)::INT AS "row", (x//4)::INT AS col, y%3 AS y, x%4 AS x, round(v,6)+0.0 AS v FROM pixels""")
def image_to_tiles(spark: SparkSession, d: str) -> DataFrame:
    return pixels.to_tiles(V.pixels(spark, d), 3, 4).select("image_id", "row", "col", "y", "x", r("v"))


@query(f"WITH {V.PIXELS} SELECT image_id, (y//2)::INT AS y, (x//2)::INT AS x, round(sum(v)/4,6)+0.0 AS v FROM pixels GROUP BY ALL")
def pyramid_level(spark: SparkSession, d: str) -> DataFrame:
    return pixels.halved(V.pixels(spark, d)).select("image_id", "y", "x", r("v"))


@query("""WITH a AS (SELECT i::INT AS i, (0.5 + (CASE WHEN i>=4 THEN i-4 ELSE 3-i END)*4/3.0::DOUBLE) AS e, abs(i-4)::DOUBLE AS o FROM range(9) t(i)) SELECT y.i AS y, x.i AS x, round(sqrt(y.e*y.e+x.o*x.o),6) AS v FROM a y, a x WHERE y.i<8""")
def distance_image(spark: SparkSession, d: str) -> DataFrame:
    px = spark.range(8 * 9).select(F.floor(F.col("id") / 9).cast("int").alias("y"), (F.col("id") % 9).cast("int").alias("x"))
    return px.select("y", "x", F.round(pixels.distance_to_centre(F.col("y"), F.col("x"), 8, 9), 6).alias("v"))


_PLACED = f"""{V.PIXELS}, placed AS (SELECT image_id AS k, (image_id%23)*5+y AS y, (image_id%19)*5+x AS x, v, sqrt(pow(0.5+(CASE WHEN y>=4 THEN y-4 ELSE 3-y END)*4/3.0::DOUBLE,2)+pow(0.5+(CASE WHEN x>=4 THEN x-4 ELSE 3-x END)*4/3.0::DOUBLE,2)) AS dist FROM pixels)"""


def _placed(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("image_id")
    return V.pixels(spark, d).select(k.alias("key"), ((k % 23) * 5 + F.col("y")).alias("y"), ((k % 19) * 5 + F.col("x")).alias("x"), "v", F.round(pixels.distance_to_centre(F.col("y"), F.col("x"), 8, 8), 9).alias("dist"))


@query(f"""WITH {_PLACED}, best AS (SELECT y, x, arg_min(struct_pack(v:=v,dist:=dist,k:=k), row(round(dist,9),k)) AS b FROM placed GROUP BY y, x) SELECT y, x, round(greatest(b.v,0),6)+0.0 AS v, round(b.dist,6) AS dist, b.k AS key FROM best""")
def zbuffer_composite(spark: SparkSession, d: str) -> DataFrame:
    return pixels.composite(_placed(spark, d)).select("y", "x", r("v"), r("dist"), "key")


@query(f"""WITH {_PLACED}, best AS (SELECT y, x, arg_min(v, row(round(dist,9),k)) AS v FROM placed GROUP BY y, x) SELECT (y//32)::BIGINT AS "row", (x//32)::BIGINT AS col, count(*) AS n, round(sum(greatest(v,0)),4) AS total FROM best GROUP BY ALL""")
def optimized_tiles(spark: SparkSession, d: str) -> DataFrame:
    c = pixels.composite(_placed(spark, d))
    return c.groupBy(F.floor(F.col("y") / 32).alias("row"), F.floor(F.col("x") / 32).alias("col")).agg(F.count("*").alias("n"), F.round(F.sum("v"), 4).alias("total"))


@query(f"""WITH {_NORM} SELECT a.image_id, round(coalesce(avg(abs(a.v-b.v)) FILTER (WHERE a.v>0 AND a.v<1 AND b.v>0 AND b.v<1),1),6) AS score FROM norm a JOIN norm b ON b.image_id=a.image_id+1 AND a.y=b.y AND a.x=b.x GROUP BY a.image_id""")
def quality_score(spark: SparkSession, d: str) -> DataFrame:
    return pixels.quality_scores(V.pixels(spark, d)).select("image_id", r("score"))


# Layout


_LAYOUT = f"{V.TILES}, {V.PAIRS}, {V.EDGES}, {V.NODES}, both_ AS (SELECT a, b, dy, dx, weight FROM edges UNION ALL SELECT b, a, -dy, -dx, weight FROM edges)"
_TENSION = """SELECT e.a AS id, sum(b.y-a.y-dy) AS net_y, sum(b.x-a.x-dx) AS net_x, sum((b.y-a.y-dy)*weight)/sum(weight) AS weighted_y, sum((b.x-a.x-dx)*weight)/sum(weight) AS weighted_x FROM both_ e JOIN {n} a ON a.id=e.a JOIN {n} b ON b.id=e.b GROUP BY e.a"""


def _relax_sql(k: int) -> str:
    parts, name = [], "nodes"
    for i in range(k):
        parts.append(f"t{i} AS ({_TENSION.format(n=name)}), n{i} AS (SELECT n.id, y+0.95*coalesce(weighted_y,0) AS y, x+0.95*coalesce(weighted_x,0) AS x FROM {name} n LEFT JOIN t{i} USING (id))")
        name = f"n{i}"
    return f"WITH {_LAYOUT}, {', '.join(parts)} SELECT id, round(y,4)+0.0 AS y, round(x,4)+0.0 AS x FROM {name}"


@query(f"WITH {_LAYOUT}, t AS ({_TENSION.format(n='nodes')}) SELECT id, round(net_y,5)+0.0 AS net_y, round(net_x,5)+0.0 AS net_x, round(weighted_y,5)+0.0 AS weighted_y, round(weighted_x,5)+0.0 AS weighted_x FROM t")
def tension(spark: SparkSession, d: str) -> DataFrame:
    return layout.tensions(V.nodes(spark, d), V.edges(spark, d)).select("id", *[r(c, 5) for c in ("net_y", "net_x", "weighted_y", "weighted_x")])


@query(f"WITH {_LAYOUT}, t AS ({_TENSION.format(n='nodes')}) SELECT round(max(sqrt(net_y**2+net_x**2)),5) AS most, round(min(sqrt(net_y**2+net_x**2)),5) AS least FROM t")
def max_tension(spark: SparkSession, d: str) -> DataFrame:
    size = F.hypot("net_y", "net_x")
    return layout.tensions(V.nodes(spark, d), V.edges(spark, d)).agg(F.round(F.max(size), 5).alias("most"), F.round(F.min(size), 5).alias("least"))


@query(f"WITH {_LAYOUT} SELECT a, b, round((weight-(SELECT min(weight) FROM edges))/((SELECT max(weight) FROM edges)-(SELECT min(weight) FROM edges))*0.75+0.25,6) AS weight FROM edges")
def weight_rescale(spark: SparkSession, d: str) -> DataFrame:
    return layout.weights_to_range(V.edges(spark, d), 0.25, 1.0).select("a", "b", r("weight"))


@query(f"WITH {_LAYOUT} SELECT a, b, round(weight/(SELECT max(weight) FROM edges),6) AS weight FROM edges")
def weight_normalise(spark: SparkSession, d: str) -> DataFrame:
    return layout.weights_to_maximum(V.edges(spark, d)).select("a", "b", r("weight"))


@query(_relax_sql(3))
def relax_k3(spark: SparkSession, d: str) -> DataFrame:
    e = materialize(V.edges(spark, d))
    n = V.nodes(spark, d)
    for _ in range(3):
        n = layout.relax_step(n, e)
    return n.select("id", r("y", 4), r("x", 4))


@query()
def relax_converged(spark: SparkSession, d: str) -> DataFrame:
    return layout.relax(V.nodes(spark, d), V.edges(spark, d)).select("id", r("y", 3), r("x", 3))


@query(f"""WITH RECURSIVE {V.TILES}, {V.PAIRS}, w AS (SELECT a, b FROM pairs WHERE (max_y-min_y)*(max_x-min_x) > 1900), both_ AS (SELECT a, b FROM w UNION SELECT b, a FROM w),
walk(id, c) AS (SELECT id, id FROM tiles UNION SELECT b, c FROM walk JOIN both_ ON both_.a=walk.id WHERE c < b) SELECT id, min(c) AS component FROM walk GROUP BY id""")
def layout_components(spark: SparkSession, d: str) -> DataFrame:
    e = V.edges(spark, d).filter("weight > 0.19")
    return layout.components(V.nodes(spark, d).select("id"), e)


@query(f"WITH {_LAYOUT} SELECT a, b, dy, dx, CASE WHEN a%5=0 THEN 1.0 ELSE round(weight,6) END AS weight FROM edges")
def edge_upsert(spark: SparkSession, d: str) -> DataFrame:
    e = V.edges(spark, d)
    new = e.filter("a % 5 = 0").withColumn("weight", F.lit(1.0))
    return layout.upsert_edges(e, new).select("a", "b", "dy", "dx", r("weight"))


@query()
def strongest_tree(spark: SparkSession, d: str) -> DataFrame:
    return layout.strongest_layout(V.nodes(spark, d).select("id"), V.edges(spark, d))[1].select("a", "b", r("weight"))


@query()
def tree_layout(spark: SparkSession, d: str) -> DataFrame:
    return layout.strongest_layout(V.nodes(spark, d).select("id"), V.edges(spark, d))[0].select("id", "component", r("y"), r("x"))


@query(f"""WITH {_LAYOUT}, placed AS (SELECT id, id%3 AS part, y+(id%3)*7 AS y, x-(id%3)*5 AS x FROM nodes), pr AS (SELECT a.part AS pa, b.part AS pb, count(*) AS n, avg(a.y+dy-b.y) AS sy, avg(a.x+dx-b.x) AS sx FROM both_ e JOIN placed a ON a.id=e.a JOIN placed b ON b.id=e.b WHERE a.part<b.part GROUP BY ALL),
mv AS (SELECT pb, arg_max(struct_pack(pa:=pa,sy:=sy,sx:=sx), row(n,-pa)) AS m FROM pr GROUP BY pb) SELECT id, coalesce(m.pa,part) AS part, round(y+coalesce(m.sy,0),4)+0.0 AS y, round(x+coalesce(m.sx,0),4)+0.0 AS x FROM placed LEFT JOIN mv ON pb=part""")
def component_shift(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("id") % 3
    placed = V.nodes(spark, d).select("id", p.alias("part"), (F.col("y") + p * 7).alias("y"), (F.col("x") - p * 5).alias("x"))
    return layout.merge_parts(placed, V.edges(spark, d)).select("id", "part", r("y", 4), r("x", 4))


@query(f"WITH {_LAYOUT} SELECT round(avg(y),6) AS y, round(avg(x),6) AS x FROM nodes")
def layout_centre(spark: SparkSession, d: str) -> DataFrame:
    return V.nodes(spark, d).agg(F.round(F.avg("y"), 6).alias("y"), F.round(F.avg("x"), 6).alias("x"))


# Alignment records


@query(f"""WITH {V.ALIGNMENT}, top AS (SELECT stos_id, flip, arg_max(struct_pack(record_id:=record_id,peak_y:=peak_y,peak_x:=peak_x,weight:=weight,angle:=angle), row(weight,-record_id)) AS q FROM alignment GROUP BY ALL),
b AS (SELECT stos_id, arg_max(struct_pack(q:=q,flip:=flip), row(q.weight, NOT flip)) AS z FROM top GROUP BY stos_id) SELECT stos_id, z.q.record_id AS record_id, z.q.peak_y AS peak_y, z.q.peak_x AS peak_x, z.q.weight AS weight, z.q.angle AS angle, z.flip AS flip FROM b""")
def best_angle(spark: SparkSession, d: str) -> DataFrame:
    return records.best_records(V.alignment(spark, d))


@query(f"WITH {V.ALIGNMENT} SELECT record_id, round(radians(angle),6)+0.0 AS rangle, peak_y*2 AS s_y, peak_x*2 AS s_x, round(sqrt(peak_y*peak_y+peak_x*peak_x),6) AS size, 0.0-peak_y AS inv_y, 0.0-peak_x AS inv_x, 10+peak_y AS t_y, 20-peak_x AS adj_x FROM alignment")
def record_columns(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    a = V.alignment(spark, d)
    return a.select("record_id", (F.round(F.radians("angle"), 6) + 0.0).alias("rangle"), (c("peak_y") * 2).alias("s_y"), (c("peak_x") * 2).alias("s_x"), F.round(F.hypot("peak_y", "peak_x"), 6).alias("size"), (0.0 - c("peak_y")).alias("inv_y"), (0.0 - c("peak_x")).alias("inv_x"), (10 + c("peak_y")).alias("t_y"), (20 - c("peak_x")).alias("adj_x"))


@query(f"WITH {V.ALIGNMENT}, cut AS (SELECT stos_id, quantile_cont(weight,0.5) AS q FROM alignment GROUP BY stos_id) SELECT record_id FROM alignment JOIN cut USING (stos_id) WHERE weight>q AND peak_y*peak_y+peak_x*peak_x<=10000")
def finalise_points(spark: SparkSession, d: str) -> DataFrame:
    return records.heavier_than(V.alignment(spark, d), 0.5, "stos_id", 100.0).select("record_id")


@query(f"WITH {V.ALIGNMENT} SELECT stos_id, round(sum(peak_y*weight)/nullif(sum(weight),0),3)+0.0 AS y, round(sum(peak_x*weight)/nullif(sum(weight),0),3)+0.0 AS x, round(quantile_cont(weight,0.5) FILTER (WHERE weight>0),6) AS w FROM alignment GROUP BY stos_id")
def net_displacement(spark: SparkSession, d: str) -> DataFrame:
    w = F.col("weight")
    mean = lambda c: (F.round(F.sum(F.col(c) * w) / F.nullif(F.sum(w), F.lit(0.0)), 3) + 0.0)
    return V.alignment(spark, d).groupBy("stos_id").agg(mean("peak_y").alias("y"), mean("peak_x").alias("x"), F.round(F.percentile(F.when(w > 0, w), 0.5), 6).alias("w"))


# Transforms


def _parsed(spark: SparkSession, d: str) -> DataFrame:
    """Valid transforms of slice-to-slice records and mosaic entries, under their table and id."""
    return parsing.p3_transforms(spark, d).select(F.concat_ws(":", "source_table", "record_id").alias("tf_id"), "transform_type", "vp", "fp")


def parse_sql(texts: str) -> str:
    """Valid transforms as ``parsed``, of the texts s under tf_id."""
    return rf"""tok AS (SELECT tf_id, string_split_regex(trim(s, ' '||chr(9)||chr(10)||chr(13)), '\s+') AS t FROM ({texts}) u),
kind AS (SELECT tf_id, t[1] AS transform_type, list_position(t,'fp') AS f, t FROM tok WHERE t[2]='vp' AND list_position(t,'fp')>0 AND regexp_full_match(t[3],'\d+') AND regexp_full_match(coalesce(t[list_position(t,'fp')+1],''),'\d+')),
num AS (SELECT tf_id, transform_type, t[3]::BIGINT AS nv, t[f+1]::BIGINT AS nf, t[4:f-1] AS v, t[f+2:] AS p FROM kind WHERE len(list_filter(t[4:f-1]||t[f+2:], lambda x: NOT regexp_full_match(x,'[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?')))=0),
dbl AS (SELECT tf_id, transform_type, nv, nf, list_transform(v, lambda x: x::DOUBLE) AS vp, list_transform(p, lambda x: x::DOUBLE) AS fp FROM num WHERE nv=len(v) AND nf=len(p)),
parsed AS (SELECT tf_id, transform_type, vp, fp FROM dbl WHERE len(list_filter(vp||fp, lambda x: abs(x)>=1.79769e308))=0 AND ((transform_type='LegendrePolynomialTransform_double_2_2_1' AND nv=6 AND nf=4) OR (transform_type='Rigid2DTransform_double_2_2' AND nv=3 AND nf=2) OR (transform_type='CenteredSimilarity2DTransform_double_2_2' AND nv=6 AND nf=0)
 OR (transform_type='GridTransform_double_2_2' AND nf=7 AND nv=2*(fp[2]+1)*(fp[3]+1)) OR (transform_type='MeshTransform_double_2_2' AND nf=8 AND nv=4*fp[8])))"""


STOS_TEXTS = "SELECT DISTINCT stos_id AS tf_id, transform_str AS s FROM stos_files"
PARSE = parse_sql(
    r"""SELECT 'stos_files:'||stos_id AS tf_id, transform_str AS s FROM stos_files
UNION SELECT 'mosaic_tiles:'||entry_id, regexp_replace(regexp_replace(image_to_transform, '^\s*image\s*:\s*', '', 'i'), '^(\S.*?\.[A-Za-z][A-Za-z0-9]{0,4}|\S+)(\s|$)', '') FROM mosaic_tiles"""
)


@query(f"WITH {PARSE} SELECT tf_id, transform_type, len(vp)::INT AS n_vp, len(fp)::INT AS n_fp, round(coalesce(list_sum(vp),0),3)+0.0 AS sum_vp, round(coalesce(list_sum(fp),0),3)+0.0 AS sum_fp FROM parsed")
def transform_parse(spark: SparkSession, d: str) -> DataFrame:
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda a, x: a + x), 3) + 0.0
    return _parsed(spark, d).select("tf_id", "transform_type", F.size("vp").alias("n_vp"), F.size("fp").alias("n_fp"), total("vp").alias("sum_vp"), total("fp").alias("sum_fp"))


_PARAMS = f"""{PARSE}, params AS (SELECT tf_id, CASE WHEN transform_type[1]='R' THEN vp[1] WHEN transform_type[1]='C' THEN vp[2] ELSE 0 END AS angle, CASE WHEN transform_type[1]='C' THEN vp[1] ELSE 1 END AS scale,
 CASE WHEN transform_type[1]='R' THEN vp[3] WHEN transform_type[1]='C' THEN vp[6] ELSE fp[2] END AS dy, CASE WHEN transform_type[1]='R' THEN vp[2] WHEN transform_type[1]='C' THEN vp[5] ELSE fp[1] END AS dx,
 CASE WHEN transform_type[1]='R' THEN fp[2] WHEN transform_type[1]='C' THEN vp[4] ELSE fp[4] END AS c_y, CASE WHEN transform_type[1]='R' THEN fp[1] WHEN transform_type[1]='C' THEN vp[3] ELSE fp[3] END AS c_x FROM parsed WHERE transform_type[1] IN ('R','C','L')),
q AS (SELECT tf_id, k AS q, (k%4)*100.0::DOUBLE AS y, (k//4)*50.0::DOUBLE AS x, angle, scale, dy, dx, c_y, c_x FROM params, range(8) t(k))"""


def _points(params: DataFrame) -> DataFrame:
    k = F.explode(F.sequence(F.lit(0), F.lit(7))).alias("q")
    return params.select("tf_id", k).select("tf_id", F.col("q").cast("bigint").alias("q"), ((F.col("q") % 4) * 100.0).alias("y"), (F.floor(F.col("q") / 4) * 50.0).alias("x"))


@query(f"WITH {_PARAMS} SELECT tf_id, q, round(scale*(cos(angle)*(y-c_y)-sin(angle)*(x-c_x))+c_y+dy,4)+0.0 AS y, round(scale*(sin(angle)*(y-c_y)+cos(angle)*(x-c_x))+c_x+dx,4)+0.0 AS x FROM q")
def rigid_map(spark: SparkSession, d: str) -> DataFrame:
    p = transforms.rigid_parameters(_parsed(spark, d))
    return transforms.map_points(_points(p), p).select("tf_id", "q", r("y", 4), r("x", 4))


@query(f"WITH {_PARAMS} SELECT tf_id, q, round((cos(angle)*(y-dy-c_y)+sin(angle)*(x-dx-c_x))/scale+c_y,4)+0.0 AS y, round((cos(angle)*(x-dx-c_x)-sin(angle)*(y-dy-c_y))/scale+c_x,4)+0.0 AS x FROM q")
def rigid_inverse(spark: SparkSession, d: str) -> DataFrame:
    p = transforms.rigid_parameters(_parsed(spark, d))
    return transforms.map_points(_points(p), p, inverse=True).select("tf_id", "q", r("y", 4), r("x", 4))


_POINTS = f"""{PARSE}, cp AS (
SELECT tf_id, i::INT AS idx, vp[2*i+2] AS t_y, vp[2*i+1] AS t_x, (i//(fp[2]+1)::INT)*fp[7]/greatest(fp[3],1) AS s_y, (i%(fp[2]+1)::INT)*fp[6]/greatest(fp[2],1) AS s_x FROM parsed, range(len(vp)//2) t(i) WHERE transform_type[1]='G'
UNION ALL SELECT tf_id, i::INT, vp[4*i+4], vp[4*i+3], fp[5]+vp[4*i+2]*fp[7], fp[4]+vp[4*i+1]*fp[6] FROM parsed, range(len(vp)//4) t(i) WHERE transform_type[1]='M'
UNION ALL SELECT tf_id, i::INT, fp[2]+(i//2)*2*fp[4], fp[1]+(i%2)*2*fp[3], (i//2)*2*fp[4], (i%2)*2*fp[3] FROM parsed, range(4) t(i) WHERE transform_type[1]='L')"""


@query(f"WITH {_POINTS} SELECT tf_id, idx, round(t_y,4)+0.0 AS t_y, round(t_x,4)+0.0 AS t_x, round(s_y,4)+0.0 AS s_y, round(s_x,4)+0.0 AS s_x FROM cp")
def transform_points(spark: SparkSession, d: str) -> DataFrame:
    return transforms.control_points(_parsed(spark, d)).select("tf_id", "idx", *[r(c, 4) for c in transforms.POINT])


@query(f"WITH {_POINTS} SELECT tf_id, " + ", ".join(f"round(min({c}),4)+0.0 AS min_{c}, round(max({c}),4)+0.0 AS max_{c}" for c in transforms.POINT) + " FROM cp GROUP BY tf_id")
def transform_bounds(spark: SparkSession, d: str) -> DataFrame:
    b = transforms.fixed_bounds(transforms.control_points(_parsed(spark, d)))
    return b.select("tf_id", *[r(c, 4) for c in b.columns if c != "tf_id"])


@query(f"WITH {V.CONTROL} SELECT tf_id, idx, t_y*0.5+3 AS t_y, t_x*0.5-2 AS t_x, round(cos(0.5)*(40-s_y-10)-sin(0.5)*(s_x-5)+10,6)+0.0 AS s_y, round(sin(0.5)*(40-s_y-10)+cos(0.5)*(s_x-5)+5,6)+0.0 AS s_x FROM control_points")
def control_motions(spark: SparkSession, d: str) -> DataFrame:
    cp = transforms.translated(transforms.scaled(V.control_points(spark, d), 0.5, warped=False), 3.0, -2.0)
    return transforms.rotated(transforms.flipped(cp, 20.0), 0.5, 10.0, 5.0).select("tf_id", "idx", "t_y", "t_x", r("s_y"), r("s_x"))


@query(f"WITH {V.CONTROL} SELECT tf_id, idx, t_y-(SELECT min(t_y) FROM control_points) AS t_y, t_x-(SELECT min(t_x) FROM control_points) AS t_x, s_y, s_x FROM control_points")
def transform_zero_origin(spark: SparkSession, d: str) -> DataFrame:
    return transforms.to_zero_origin(V.control_points(spark, d)).select("tf_id", "idx", *transforms.POINT)


@query(f"WITH {V.CONTROL} SELECT tf_id, min(idx) AS idx, t_y, t_x, s_y, s_x FROM control_points GROUP BY tf_id, t_y, t_x, s_y, s_x")
def control_distinct(spark: SparkSession, d: str) -> DataFrame:
    cp = V.control_points(spark, d)
    return transforms.without_duplicates(cp.unionByName(cp.withColumn("idx", F.col("idx") + 1_000_000)))


@query(f"""WITH {V.CONTROL}, q AS (SELECT tf_id, idx AS q, s_y+3 AS y, s_x+1 AS x FROM control_points) SELECT q.tf_id, q, arg_min(idx, row(sqrt((q.y-t_y)**2+(q.x-t_x)**2), idx)) AS idx, round(min(sqrt((q.y-t_y)**2+(q.x-t_x)**2)),6) AS dist FROM q JOIN control_points c ON c.tf_id=q.tf_id GROUP BY ALL""")
def nearest_control(spark: SparkSession, d: str) -> DataFrame:
    cp = V.control_points(spark, d)
    q = cp.select("tf_id", F.col("idx").alias("q"), (F.col("s_y") + 3).alias("y"), (F.col("s_x") + 1).alias("x"))
    return transforms.nearest_control(q, cp, 10.0).select("tf_id", "q", "idx", r("dist"))


@query(f"""WITH {V.CONTROL} SELECT tf_id, 'vp '||(2*count(*))::VARCHAR||' '||string_agg(t_x::BIGINT::VARCHAR||' '||t_y::BIGINT::VARCHAR, ' ' ORDER BY idx) AS text FROM control_points GROUP BY tf_id""")
def transform_serialise(spark: SparkSession, d: str) -> DataFrame:
    return transforms.transform_text(V.control_points(spark, d))


@query("""WITH s AS (SELECT DISTINCT image_id AS id, h, w FROM images WHERE h IS NOT NULL AND w IS NOT NULL), c AS (SELECT *, i::INT AS corner, (i//2)*h AS y, (i%2)*w AS x FROM s, range(4) t(i))
SELECT id, corner, round(cos(0.3)*(y-h/2.0)-sin(0.3)*(x-w/2.0)+h/2.0+7,4)+0.0 AS y, round(sin(0.3)*(y-h/2.0)+cos(0.3)*(x-w/2.0)+w/2.0-3,4)+0.0 AS x FROM c""")
def corner_points(spark: SparkSession, d: str) -> DataFrame:
    s = _sizes(spark, d).select("id", F.col("h").cast("double").alias("h"), F.col("w").cast("double").alias("w"), F.lit(0.3).alias("angle"), F.lit(7.0).alias("dy"), F.lit(-3.0).alias("dx"))
    return transforms.corner_points(s).select("id", "corner", r("y", 4), r("x", 4))


@query(f"""WITH {V.CONTROL}, t AS (SELECT idx AS tri, t_y AS ay, t_x AS ax, t_y+4 AS by_, t_x+1 AS bx, t_y+1 AS cy, t_x+5 AS cx FROM control_points) SELECT tri, round(acos(9/sqrt(442)),6) AS angle_a, round(acos(8/sqrt(425)),6) AS angle_b, round(pi()-acos(9/sqrt(442))-acos(8/sqrt(425)),6) AS angle_c, round((ay+by_+cy)/3,6) AS m_y, round((ax+bx+cx)/3,6) AS m_x FROM t""")
def triangle_angles(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    t = V.control_points(spark, d).select(c("idx").alias("tri"), c("t_y").alias("ay"), c("t_x").alias("ax"), (c("t_y") + 4).alias("by"), (c("t_x") + 1).alias("bx"), (c("t_y") + 1).alias("cy"), (c("t_x") + 5).alias("cx"))
    return transforms.triangle_metrics(t).select("tri", *[r(x) for x in ("angle_a", "angle_b", "angle_c", "m_y", "m_x")])


@query("""WITH s AS (SELECT DISTINCT image_id, h, w FROM images WHERE h IS NOT NULL AND w IS NOT NULL), c AS (SELECT greatest(h,w) AS scale, count(*) AS n FROM s GROUP BY ALL) SELECT scale FROM c ORDER BY n DESC, scale LIMIT 1""")
def common_scale(spark: SparkSession, d: str) -> DataFrame:
    return _sizes(spark, d).agg(F.mode(F.greatest("h", "w"), True).alias("scale"))


# Records and text


_ENTRY = r"""e AS (SELECT DISTINCT entry_id, tile_dir, mosaic_full_path, replace(replace(image_to_transform, chr(13)||chr(10), chr(10)), chr(13), chr(10)) AS t FROM mosaic_tiles),
f AS (SELECT entry_id, mosaic_full_path, regexp_replace(t, '^\s*image\s*:\s*', '', 'i') AS rest, t FROM e),
g AS (SELECT entry_id, mosaic_full_path, trim(regexp_extract(rest, '^(\S.*?\.[A-Za-z][A-Za-z0-9]{0,4})(\s|$)', 1)) AS name, rest FROM f),
entries AS (SELECT entry_id, mosaic_full_path, regexp_extract(replace(name, '\', '/'), '([^/]*)$', 1) AS image, trim(substr(rest, length(name)+1), ' '||chr(9)||chr(10)) AS transform FROM g)"""


@query(f"WITH {_ENTRY} SELECT entry_id, image, length(transform)::INT AS n_text, md5(transform) AS digest FROM entries")
def mosaic_parse(spark: SparkSession, d: str) -> DataFrame:
    t = load(spark, d, "mosaic_tiles").select("entry_id", entry_file(F.col("image_to_transform")).alias("image"), F.trim(F.regexp_replace(entry_transform(F.col("image_to_transform")), r"\r\n|\r", "\n"), F.lit(" \t\n")).alias("t")).distinct()
    return t.select("entry_id", "image", F.length("t").alias("n_text"), F.md5("t").alias("digest"))


@query("""SELECT DISTINCT stos_id, try_cast(nullif(regexp_extract(stos_name,'^(\\d+)-(\\d+)_',1),'') AS INT) AS mapped_section, try_cast(nullif(regexp_extract(stos_name,'^(\\d+)-(\\d+)_',2),'') AS INT) AS control_section, nullif(regexp_extract(stos_name,'_ctrl-([^_]+)',1),'') AS control_channel,
 nullif(regexp_extract(stos_name,'_map-([^_]+)',1),'') AS mapped_channel, try_cast(string_split(regexp_replace(stos_name,'\\.[A-Za-z]+$',''),'_')[-1] AS INT) AS name_downsample FROM stos_files""")
def file_info(spark: SparkSession, d: str) -> DataFrame:
    f = records.stos_name_fields(F.col("stos_name"))
    keep = ["mapped_section", "control_section", "control_channel", "mapped_channel", "name_downsample"]
    return load(spark, d, "stos_files").select("stos_id", *[f[k].alias(k) for k in keep]).distinct()


@query("""SELECT DISTINCT entry_id, try_cast(p[1] AS INT) AS section, p[2] AS channel, p[3] AS source, try_cast(p[-1] AS INT) AS file_downsample FROM (SELECT entry_id, string_split(regexp_replace(regexp_extract(replace(mosaic_full_path,'\\','/'),'([^/]*)$',1),'\\.mosaic$',''),'_') AS p FROM mosaic_tiles)""")
def mosaic_file_info(spark: SparkSession, d: str) -> DataFrame:
    f = records.mosaic_name_fields(F.col("mosaic_full_path"))
    return load(spark, d, "mosaic_tiles").select("entry_id", *[v.alias(k) for k, v in f.items()]).distinct()


@query("""SELECT mosaic_full_path, count(*) AS n, sum(('0x'||substr(md5(image_to_transform),1,12))::BIGINT)::VARCHAR AS checksum FROM (SELECT DISTINCT entry_id, mosaic_full_path, image_to_transform FROM mosaic_tiles) GROUP BY mosaic_full_path""")
def mosaic_checksum(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "mosaic_tiles").select("entry_id", "mosaic_full_path", "image_to_transform").distinct()
    return records.checksums(e, "mosaic_full_path", "image_to_transform")


@query("""SELECT mosaic_full_path, min(number_of_images) AS claimed, count(DISTINCT entry_id) AS n FROM mosaic_tiles GROUP BY mosaic_full_path HAVING min(number_of_images)<>count(DISTINCT entry_id)""")
def mosaic_count_mismatch(spark: SparkSession, d: str) -> DataFrame:
    g = load(spark, d, "mosaic_tiles").select("entry_id", "mosaic_full_path", "number_of_images").distinct().groupBy("mosaic_full_path").agg(F.min("number_of_images").alias("claimed"), F.count("entry_id").alias("n"))
    return g.filter("claimed <> n")


def _lines(spark: SparkSession, d: str) -> DataFrame:
    """Mosaic files written out from the entries and cut into lines again."""
    e = load(spark, d, "mosaic_tiles").select(F.col("mosaic_full_path").alias("path"), "entry_id", entry_file(F.col("image_to_transform")).alias("image"), F.trim(F.regexp_replace(entry_transform(F.col("image_to_transform")), r"\s+", " ")).alias("transform"))
    text = records.mosaic_text(e.filter("transform <> ''").select("path", "image", "transform").distinct())
    return text.select("path", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


@query()
def mosaic_round_trip(spark: SparkSession, d: str) -> DataFrame:
    return records.mosaic_entries(_lines(spark, d)).select("path", "image", F.md5("transform").alias("digest"))


@query()
def mosaic_header(spark: SparkSession, d: str) -> DataFrame:
    return records.mosaic_header(_lines(spark, d))


@query()
def stos_round_trip(spark: SparkSession, d: str) -> DataFrame:
    s = load(spark, d, "stos_files").dropDuplicates(["stos_id"]).filter("control_image_full_path is not null and mapped_image_full_path is not null")
    one = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    dims = F.array(*[F.lit(v) for v in (1.0, 1.0, 100.0, 200.0)])
    t = records.stos_text(s.select(F.col("stos_id").alias("path"), one("control_image_full_path").alias("control_image"), one("mapped_image_full_path").alias("mapped_image"), dims.alias("control_dims"), dims.alias("mapped_dims"), one("transform_str").alias("transform"), one("control_mask_full_path").alias("control_mask"), one(F.coalesce("mapped_mask_full_path", F.lit(""))).alias("mapped_mask")))
    f = records.stos_fields(t.select("path", F.posexplode(F.split("text", "\n")).alias("line_no", "line")))
    return f.select(F.col("path").alias("stos_id"), "control_image", "mapped_image", F.element_at("mapped_dims", 4).alias("h"), F.md5("transform").alias("digest"), "control_mask")


@query("""SELECT DISTINCT image_id, try_cast(nullif(regexp_extract(replace(image_full_path,'\\','/'),'([^/.]+)\\.[^/.]*\\s*$',1),'') AS INT) AS tile_id FROM images""")
def tile_ids(spark: SparkSession, d: str) -> DataFrame:
    i = load(spark, d, "images").select("image_id", "image_full_path").distinct()
    name = F.regexp_extract(F.translate("image_full_path", "\\", "/"), r"([^/.]+)\.[^/.]*\s*$", 1)
    return i.select("image_id", name.try_cast("int").alias("tile_id"))


@query("""SELECT DISTINCT stos_id, regexp_replace(regexp_replace('1.500 2.000 3.25 -0.10 7','(\\.\\d*?)0+( |$)','\\1\\2','g'),'\\.( |$)','\\1','g') AS text FROM stos_files""")
def compressed_numbers(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "stos_files").select("stos_id").distinct().select("stos_id", records.compressed_numbers(F.lit("1.500 2.000 3.25 -0.10 7")).alias("text"))


@query(rf"""WITH {_ENTRY}, u AS (SELECT 'mosaic_tiles' AS source_table, entry_id AS record_id, transform AS t FROM entries UNION SELECT 'stos_files', stos_id, transform_str FROM stos_files)
SELECT source_table, record_id, array_to_string(list_transform(string_split_regex(t, '\s+'), lambda x: CASE WHEN regexp_full_match(x, '[+-]?\d+\.\d+([eE][+-]?\d+)?') THEN regexp_replace(regexp_replace(x, '(\.\d*?)0+($|[eE])', '\1\2'), '\.($|[eE])', '\1') ELSE x END), ' ') AS text FROM u""")
def compressed_transforms(spark: SparkSession, d: str) -> DataFrame:
    """The transforms of mosaics and slice-to-slice files with their numbers in shortest form."""
    t = F.trim(F.regexp_replace(entry_transform(F.col("image_to_transform")), r"\r\n|\r", "\n"), F.lit(" \t\n"))
    m = load(spark, d, "mosaic_tiles").select(F.lit("mosaic_tiles").alias("source_table"), F.col("entry_id").alias("record_id"), t.alias("t"))
    s = load(spark, d, "stos_files").select(F.lit("stos_files").alias("source_table"), F.col("stos_id").alias("record_id"), F.col("transform_str").alias("t"))
    return m.unionByName(s).distinct().select("source_table", "record_id", records.compressed_numbers(F.col("t")).alias("text"))


@query("""WITH s AS (SELECT DISTINCT image_id, h FROM images WHERE h>0) SELECT image_id, pow(2,ceil(log2(h))) AS p2, CASE WHEN 0.2>=0.5 THEN h ELSE round(h+h*(1-(0.2+0.5))*2,6)::DOUBLE END::DOUBLE AS padded FROM s""")
def power_of_two(spark: SparkSession, d: str) -> DataFrame:
    h = F.col("h").cast("double")
    return load(spark, d, "images").filter("h > 0").select("image_id", "h").distinct().select("image_id", G.nearest_power_of_two(h).alias("p2"), F.round(G.dimension_with_overlap(h, F.lit(0.2)), 6).alias("padded"))


@query("""SELECT section_no, channel_name, bpp, count(*) AS n, round(avg(px_mean),4) AS mean, round(min(px_min),4)+0.0 AS min, round(max(px_max),4)+0.0 AS max FROM (SELECT DISTINCT stat_id, section_no, channel_name, bpp, px_mean, px_min, px_max FROM image_stats WHERE isfinite(px_mean) AND isfinite(px_min) AND isfinite(px_max) AND px_max<1e308) GROUP BY ALL""")
def tileset_stats(spark: SparkSession, d: str) -> DataFrame:
    ok = " and ".join(f"{c} is not null and not isnan({c}) and abs({c}) < 1e308" for c in ("px_mean", "px_min", "px_max"))
    s = load(spark, d, "image_stats").filter(ok).select("stat_id", "section_no", "channel_name", "bpp", "px_mean", "px_min", "px_max").distinct()
    return s.groupBy("section_no", "channel_name", "bpp").agg(F.count("*").alias("n"), F.round(F.avg("px_mean"), 4).alias("mean"), (F.round(F.min("px_min"), 4) + 0.0).alias("min"), (F.round(F.max("px_max"), 4) + 0.0).alias("max"))


# Sections


@query(f"""WITH {V.SECTIONS}, r AS (SELECT section, row_number() OVER (ORDER BY section)-1 AS k FROM sections), m AS (SELECT floor(max(k)/2)::BIGINT AS mid FROM r)
SELECT a.section AS mapped, b.section AS control FROM r a, r b, m WHERE (a.k<mid AND b.k>a.k AND b.k-a.k<=2 AND b.k<=mid) OR (a.k>mid AND b.k<a.k AND a.k-b.k<=2 AND b.k>=mid)""")
def section_pairs(spark: SparkSession, d: str) -> DataFrame:
    return sections.section_pairs(V.sections(spark, d))


@query(f"WITH {V.SECTIONS}, q AS (SELECT i::INT AS asked FROM range(40) t(i)) SELECT asked, arg_min(section, row(abs(section-asked), section)) AS section FROM q, sections GROUP BY asked")
def nearest_section(spark: SparkSession, d: str) -> DataFrame:
    return sections.nearest_section(spark.range(40).select(F.col("id").cast("int").alias("asked")), V.sections(spark, d))


@query(f"""WITH RECURSIVE {V.SECTIONS}, r AS (SELECT section, row_number() OVER (ORDER BY section)-1 AS k FROM sections), m AS (SELECT floor(max(k)/2)::BIGINT AS mid FROM r) SELECT section, ceil(abs(k-mid)/2.0)::INT AS depth FROM r, m""")
def section_tree(spark: SparkSession, d: str) -> DataFrame:
    return sections.tree_depth(materialize(sections.section_pairs(V.sections(spark, d))))


@query(f"""WITH {V.CONTROL}, {V.SECTIONS} SELECT tf_id AS section, idx, t_y+tf_id*10 AS y, t_x-tf_id*3 AS x FROM control_points JOIN sections ON section=tf_id""")
def volume_map(spark: SparkSession, d: str) -> DataFrame:
    s = V.sections(spark, d).select(F.col("section").alias("tf_id"), F.lit(0.0).alias("angle"), F.lit(1.0).alias("scale"), (F.col("section") * 10.0).alias("dy"), (F.col("section") * -3.0).alias("dx"), F.lit(0.0).alias("c_y"), F.lit(0.0).alias("c_x"))
    p = V.control_points(spark, d).select("tf_id", "idx", F.col("t_y").alias("y"), F.col("t_x").alias("x"))
    return transforms.map_points(p, s).select(F.col("tf_id").alias("section"), "idx", "y", "x")


# Numeric kernels


def _image_pairs(spark: SparkSession, d: str) -> DataFrame:
    i = V.image_arrays(spark, d)
    other = i.select((F.col("image_id") - 1).alias("image_id"), F.col("data").alias("moving"))
    return i.join(other, "image_id").select(F.col("image_id").alias("a"), (F.col("image_id") + 1).alias("b"), "h", "w", F.col("data").alias("fixed"), "moving")


@query()
def phase_offset(spark: SparkSession, d: str) -> DataFrame:
    return kernels.offsets(_image_pairs(spark, d)).select("a", "b", r("dy", 4), r("dx", 4), r("weight", 4))


@query()
def feature_score(spark: SparkSession, d: str) -> DataFrame:
    return kernels.feature_scores(V.image_arrays(spark, d), 4).select("image_id", r("score"))


@query()
def angle_search(spark: SparkSession, d: str) -> DataFrame:
    return kernels.angle_search(_image_pairs(spark, d)).select("a", "b", "angle", "flipped", r("dy", 4), r("dx", 4), r("weight", 4))


def _queries_and_points(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    cp = V.control_points(spark, d)
    return cp.select("tf_id", F.col("idx").alias("q"), (F.col("s_y") + 1.5).alias("y"), (F.col("s_x") + 2.5).alias("x")), cp


@query()
def mesh_map(spark: SparkSession, d: str) -> DataFrame:
    return mesh.map_by(*_queries_and_points(spark, d), mesh.mesh_map).select("tf_id", "q", r("y", 5), r("x", 5))


@query()
def rbf_map(spark: SparkSession, d: str) -> DataFrame:
    return mesh.map_by(*_queries_and_points(spark, d), mesh.thin_plate).select("tf_id", "q", r("y", 4), r("x", 4))


@query()
def mesh_with_fallback(spark: SparkSession, d: str) -> DataFrame:
    return mesh.map_by(*_queries_and_points(spark, d)).select("tf_id", "q", r("y", 4), r("x", 4))


@query()
def transform_compose(spark: SparkSession, d: str) -> DataFrame:
    cp = V.control_points(spark, d)
    return mesh.composed(cp, cp).select("tf_id", "idx", r("t_y", 4), r("t_x", 4), "s_y", "s_x")


# Warping and assembling


def _placement(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    i = load(spark, d, "embeddings").select(F.col("vec_id").alias("image_id"), F.lit(8).alias("h"), F.lit(8).alias("w"))
    k = F.col("image_id")
    p = i.select(k.alias("tf_id"), ((k % 7) * 0.1).alias("angle"), F.lit(1.0).alias("scale"), ((k % 23) * 5.0).alias("dy"), ((k % 19) * 5.0).alias("dx"), F.lit(3.5).alias("c_y"), F.lit(3.5).alias("c_x"))
    return i, p


_WARP = f"""{V.PIXELS}, par AS (SELECT vec_id AS k, (vec_id%7)*0.1::DOUBLE AS g, (vec_id%23)*5.0::DOUBLE AS dy, (vec_id%19)*5.0::DOUBLE AS dx FROM embeddings),
place AS (SELECT k, g, dy, dx, (dy::BIGINT+i-4) AS y, (dx::BIGINT+j-4) AS x FROM par, range(16) a(i), range(16) b(j)),
back AS (SELECT k, y, x, floor(round(cos(g)*(y-dy-3.5)+sin(g)*(x-dx-3.5)+3.5,3)+0.5)::INT AS sy, floor(round(cos(g)*(x-dx-3.5)-sin(g)*(y-dy-3.5)+3.5,3)+0.5)::INT AS sx FROM place),
warp AS (SELECT b.k AS k, b.y AS y, b.x AS x, p.v AS v, sy, sx FROM back b JOIN pixels p ON p.image_id=b.k AND p.y=b.sy AND p.x=b.sx)"""


@query(f"""WITH {_WARP}, best AS (SELECT y, x, arg_min(struct_pack(v:=v,k:=k), row(round(sqrt(pow(0.5+(CASE WHEN sy>=4 THEN sy-4 ELSE 3-sy END)*4/3.0::DOUBLE,2)+pow(0.5+(CASE WHEN sx>=4 THEN sx-4 ELSE 3-sx END)*4/3.0::DOUBLE,2)),9),k)) AS b FROM warp WHERE y>=20 AND y<90 AND x>=10 AND x<70 GROUP BY y, x) SELECT y, x, round(greatest(b.v,0),6)+0.0 AS v, b.k AS key FROM best""")
def assemble_region(spark: SparkSession, d: str) -> DataFrame:
    from lattica.operators.assemble import assembled

    return assembled(V.pixels(spark, d), *_placement(spark, d), 8, 8, (20, 10, 90, 70)).select("y", "x", r("v"), "key")


@query(f"WITH {V.CONTROL} SELECT tf_id, idx, t_y*0.5 AS t_y, t_x*0.5 AS t_x, s_y*0.5 AS s_y, s_x*0.5 AS s_x FROM control_points")
def stos_scale(spark: SparkSession, d: str) -> DataFrame:
    from lattica.operators.refine import scaled_records

    return scaled_records(V.control_points(spark, d), 2.0, 4.0)


@query(f"WITH {V.CONTROL} SELECT tf_id, idx, t_y, t_x, s_y, s_x FROM control_points WHERE t_y BETWEEN 10 AND 50 AND t_x BETWEEN 20 AND 70")
def points_in_rectangle(spark: SparkSession, d: str) -> DataFrame:
    from lattica.operators.refine import points_in

    return points_in(V.control_points(spark, d), (10.0, 20.0), (50.0, 70.0))


@query(f"WITH {V.SECTIONS} SELECT section, CASE WHEN section%3=0 THEN 'new' ELSE 'old' END AS name FROM sections UNION ALL SELECT 100, 'new'")
def volume_upsert(spark: SparkSession, d: str) -> DataFrame:
    from lattica.operators.refine import upserted

    v = V.sections(spark, d).select("section", F.lit("old").alias("name"))
    new = v.filter("section % 3 = 0").select("section").unionByName(spark.range(1).select(F.lit(100).alias("section"))).withColumn("name", F.lit("new"))
    return upserted(v, new)


@query("""SELECT DISTINCT image_id, CASE WHEN bpp=16 THEN (CASE WHEN h<256 THEN 'uint8' WHEN h<32768 THEN 'int16' ELSE 'uint16' END) ELSE 'uint8' END AS kind FROM images WHERE h IS NOT NULL""")
def pixel_kind(spark: SparkSession, d: str) -> DataFrame:
    from lattica.sources.images import pixel_kind as kind

    i = load(spark, d, "images").filter("h is not null").select("image_id", "bpp", "h").distinct()
    return i.select("image_id", kind(F.when(F.col("bpp") == 16, "I").otherwise("L"), F.lit(0), F.col("h")).alias("kind"))


@query("""SELECT section_no, n_open, n_deleted, last_h FROM (SELECT section_no, count(*) FILTER (WHERE deleted_at IS NULL) AS n_open, count(*) FILTER (WHERE deleted_at IS NOT NULL) AS n_deleted, arg_max(h, row(registered_at, image_id)) FILTER (WHERE h IS NOT NULL) AS last_h FROM (SELECT DISTINCT image_id, section_no, deleted_at, registered_at, h FROM images) GROUP BY section_no)""")
def image_catalogue(spark: SparkSession, d: str) -> DataFrame:
    i = load(spark, d, "images").select("image_id", "section_no", "deleted_at", "registered_at", "h").distinct()
    return i.groupBy("section_no").agg(F.count_if(F.col("deleted_at").isNull()).alias("n_open"), F.count_if(F.col("deleted_at").isNotNull()).alias("n_deleted"), F.max_by("h", F.when(F.col("h").isNotNull(), F.struct("registered_at", "image_id"))).alias("last_h"))


@query("""SELECT DISTINCT stos_id, coalesce(control_mask_full_path,'') <> '' AS has_control_mask, coalesce('999', downsample) AS downsample FROM stos_files""")
def stos_override(spark: SparkSession, d: str) -> DataFrame:
    s = load(spark, d, "stos_files").select("stos_id", "control_mask_full_path", "downsample").distinct()
    return records.overridden(s, {"downsample": F.lit("999")}).select("stos_id", (F.coalesce("control_mask_full_path", F.lit("")) != "").alias("has_control_mask"), "downsample").distinct()


@query()
def arrange_tiles(spark: SparkSession, d: str) -> DataFrame:
    """Tiles of 8 x 8 pixels laid four apart, arranged by what their overlaps show; each label is a mosaic of its own far from the others."""
    from lattica.operators.arrange import arrange

    i = V.image_arrays(spark, d)
    k = F.col("image_id")
    t = i.select(k.alias("id"), (F.floor(k / 20) * 5.0).alias("y"), ((k % 20) * 5.0).alias("x"), F.lit(8.0).alias("h"), F.lit(8.0).alias("w"))
    return arrange(t, i, 8.0, passes=1, first_excess=1.5, relax_steps=24).select("id", r("y", 2), r("x", 2))


# Tiles and their boxes


@query("""WITH s AS (SELECT DISTINCT image_id, section_no, h, w FROM images), f AS (SELECT section_no, arg_min(struct_pack(h:=h,w:=w), image_id) FILTER (WHERE h IS NOT NULL AND w IS NOT NULL) AS b FROM s GROUP BY section_no)
SELECT image_id, CASE WHEN h IS NULL OR w IS NULL THEN b.h ELSE h END AS box_h, CASE WHEN h IS NULL OR w IS NULL THEN b.w ELSE w END AS box_w FROM s LEFT JOIN f ON f.section_no IS NOT DISTINCT FROM s.section_no""")
def mapped_box_fill(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of images, those of the section's first image where they are unknown."""
    s = load(spark, d, "images").select("image_id", "section_no", "h", "w").distinct()
    known = F.col("h").isNotNull() & F.col("w").isNotNull()
    first = s.filter(known).groupBy(F.col("section_no").alias("s")).agg(F.min_by(F.struct("h", "w"), "image_id").alias("b"))
    j = s.join(first, F.col("section_no").eqNullSafe(F.col("s")), "left")
    return j.select("image_id", F.when(known, F.col("h")).otherwise(F.col("b.h")).alias("box_h"), F.when(known, F.col("w")).otherwise(F.col("b.w")).alias("box_w"))


@query("""SELECT DISTINCT image_id, CASE WHEN abs(h-4080)<=1.1 AND abs(w-4080)<=1.1 THEN 1.0::DOUBLE WHEN abs(h/4080.0::DOUBLE-w/4080.0::DOUBLE)<0.01 THEN round(h/4080.0::DOUBLE,6) END AS scale FROM images WHERE h IS NOT NULL AND w IS NOT NULL""")
def transform_scale(spark: SparkSession, d: str) -> DataFrame:
    """Scale of each image relative to a box of 4080 x 4080; null where height and width disagree."""
    h, w = F.col("h") / 4080.0, F.col("w") / 4080.0
    same = (F.abs(F.col("h") - 4080) <= 1.1) & (F.abs(F.col("w") - 4080) <= 1.1)
    return _sizes(spark, d).select(F.col("id").alias("image_id"), F.when(same, 1.0).when(F.abs(h - w) < 0.01, F.round(h, 6)).alias("scale"))


@query(f"""WITH {V.TILES}, {V.PAIRS}, c AS (SELECT a, b, i AS k, CASE WHEN i<2 THEN min_y ELSE max_y END AS y, CASE WHEN i%2=0 THEN min_x ELSE max_x END AS x, ay0, ax0 FROM pairs, range(4) t(i)),
m AS (SELECT a, b, cos(0.1)*(y-ay0-50)+sin(0.1)*(x-ax0-50)+50 AS sy, cos(0.1)*(x-ax0-50)-sin(0.1)*(y-ay0-50)+50 AS sx FROM c) SELECT a, b, round(min(sy),4)+0.0 AS min_y, round(min(sx),4)+0.0 AS min_x, round(max(sy),4)+0.0 AS max_y, round(max(sx),4)+0.0 AS max_x FROM m GROUP BY a, b""")
def overlap_source_rect(spark: SparkSession, d: str) -> DataFrame:
    """Where the common rectangle of two tiles lies in the first one's image, which is turned by a tenth about its centre."""
    p = rect.overlapping_pairs(V.tiles(spark, d), V.CELL)
    a, common = G.Rect.of("a_"), G.Rect.of("a_").clip(G.Rect.of("b_"))
    back = [G.similarity_inverse(y, x, F.lit(0.1), F.lit(1.0), F.lit(50.0), F.lit(50.0), a.min_y, a.min_x) for y in (common.min_y, common.max_y) for x in (common.min_x, common.max_x)]
    ys, xs = [y for y, _ in back], [x for _, x in back]
    return p.select("a", "b", F.least(*ys).alias("min_y"), F.least(*xs).alias("min_x"), F.greatest(*ys).alias("max_y"), F.greatest(*xs).alias("max_x")).select("a", "b", *[r(s, 4) for s in G.SIDES])


@query(f"""WITH {_SIZES}, dims AS (SELECT *, ceil(h/1024.0)::INT AS nr, ceil(w/1024.0)::INT AS nc FROM sizes), g AS (SELECT id, i, j, round_even(i*1024.0::DOUBLE+512-(nr*1024-h)/2.0::DOUBLE,0) AS y, round_even(j*1024.0::DOUBLE+512-(nc*1024-w)/2.0::DOUBLE,0) AS x, h, w FROM dims, unnest(range(nr)) t(i), unnest(range(nc)) u(j)),
m AS (SELECT id, i::INT AS "row", j::INT AS col, round_even(y*0.5::DOUBLE+100.3,0)::BIGINT AS t_y, round_even(x*0.5::DOUBLE-50.3,0)::BIGINT AS t_x, h, w FROM g) SELECT id, "row", col, t_y, t_x FROM m WHERE t_y>=0 AND t_x>=0 AND t_y<h AND t_x<w""")
def grid_targets(spark: SparkSession, d: str) -> DataFrame:
    """Targets of grid points under a transform, those outside the image left out."""
    s = _sizes(spark, d)
    g = grids.centred_grid(s, 1024.0).join(s, "id")
    g = g.select("id", "row", "col", "h", "w", F.bround(F.col("y") * 0.5 + 100.3).cast("bigint").alias("t_y"), F.bround(F.col("x") * 0.5 - 50.3).cast("bigint").alias("t_x"))
    return g.filter(pixels.in_bounds(F.col("t_y"), F.col("t_x"), F.col("h"), F.col("w"))).drop("h", "w")


@query(f"WITH {V.TILES}, {V.PAIRS}, {V.EDGES}, {V.NODES} SELECT a, b, dy, dx, round(weight,6) AS weight FROM edges WHERE a%9<>0 AND b%9<>0")
def node_removal(spark: SparkSession, d: str) -> DataFrame:
    n = V.nodes(spark, d)
    return layout.without_nodes(n, V.edges(spark, d), n.filter("id % 9 = 0"))[1].select("a", "b", "dy", "dx", r("weight"))


@query(f"WITH {V.PIXELS} SELECT y, x, round(avg(v),6)+0.0 AS v FROM pixels GROUP BY y, x")
def combined_image(spark: SparkSession, d: str) -> DataFrame:
    return pixels.combined(V.pixels(spark, d), F.avg).select("y", "x", r("v"))


@query("""SELECT DISTINCT record_id, round(atan2(peak_y+0.0, peak_x+0.0),6)+0.0 AS angle, abs(peak_y-peak_x)<0.01 AS alike FROM alignment_records WHERE isfinite(peak_y) AND isfinite(peak_x) AND (peak_y<>0 OR peak_x<>0)""")
def arc_angles(spark: SparkSession, d: str) -> DataFrame:
    """Angle of each peak from the x axis about the origin, and whether its coordinates are alike."""
    a = load(spark, d, "alignment_records").filter("abs(peak_y) < 1e308 and abs(peak_x) < 1e308 and (peak_y <> 0 or peak_x <> 0)").select("record_id", "peak_y", "peak_x").distinct()
    z = F.lit(0.0)
    return a.select("record_id", (F.round(G.arc_angle(z, z, z, F.lit(1.0), F.col("peak_y"), F.col("peak_x")), 6) + 0.0).alias("angle"), (F.abs(F.col("peak_y") - F.col("peak_x")) < 0.01).alias("alike"))

