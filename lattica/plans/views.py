"""Domain tables derived from the given ones, for the engine's own operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.operators.rectangles import overlaps
from lattica.sources.tables import load

TILE = 100.0
#: Grid cell of the overlap join: the size of a tile.
CELL = 100.0


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles of a mosaic: id and bounds, from part."""
    p = load(spark, sf_dir, "part")
    y = F.floor(F.col("p_partkey") / 50) * 80 + (F.col("p_size") % 11) - 5
    x = (F.col("p_partkey") % 50) * 80 + (F.round(F.col("p_retailprice") * 100).cast("bigint") % 11) - 5
    return p.select(F.col("p_partkey").alias("id"), y.cast("double").alias("min_y"), x.cast("double").alias("min_x"), (y + TILE).cast("double").alias("max_y"), (x + TILE).cast("double").alias("max_x"), "p_size")


TILES = """tiles AS (SELECT p_partkey AS id, p_size, (floor(p_partkey/50.0)*80 + p_size%11 - 5)::DOUBLE AS min_y, ((p_partkey%50)*80 + round(p_retailprice*100)::BIGINT%11 - 5)::DOUBLE AS min_x,
 (floor(p_partkey/50.0)*80 + p_size%11 + 95)::DOUBLE AS max_y, ((p_partkey%50)*80 + round(p_retailprice*100)::BIGINT%11 + 95)::DOUBLE AS max_x FROM part)"""
PAIRS = """pairs AS (SELECT a.id AS a, b.id AS b, a.min_y AS ay0, a.min_x AS ax0, a.max_y AS ay1, a.max_x AS ax1, b.min_y AS by0, b.min_x AS bx0, b.max_y AS by1, b.max_x AS bx1,
 greatest(a.min_y,b.min_y) AS min_y, greatest(a.min_x,b.min_x) AS min_x, least(a.max_y,b.max_y) AS max_y, least(a.max_x,b.max_x) AS max_x,
 (b.min_y+b.max_y)/2-(a.min_y+a.max_y)/2 AS dy, (b.min_x+b.max_x)/2-(a.min_x+a.max_x)/2 AS dx
 FROM tiles a JOIN tiles b ON a.id<b.id AND a.max_x>b.min_x AND a.min_x<b.max_x AND a.max_y>b.min_y AND a.min_y<b.max_y)"""


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of 8 x 8 pixels in long form (image_id, label, y, x, v), from embeddings."""
    e = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), "label", F.posexplode("embedding").alias("pos", "f"))
    return e.select("image_id", "label", F.expr("cast(pos div 8 as int)").alias("y"), (F.col("pos") % 8).alias("x"), F.col("f").cast("double").alias("v"))


PIXELS = "pixels AS (SELECT vec_id AS image_id, label, ((i-1)//8)::INT AS y, ((i-1)%8)::INT AS x, embedding[i]::DOUBLE AS v FROM embeddings, range(1,65) t(i))"


def image_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same images in array form (image_id, label, h, w, data)."""
    e = load(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("image_id"), "label", F.lit(8).alias("h"), F.lit(8).alias("w"), F.col("embedding").cast("array<double>").alias("data"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offsets a to b between overlapping tiles, with jitter and the overlap as weight."""
    t = tiles(spark, sf_dir)
    size = t.select(F.col("id").alias("b"), "p_size")
    o = overlaps(t, CELL).join(size, "b")
    return o.select("a", "b", (F.col("dy") + F.col("p_size") % 3 - 1).alias("dy"), (F.col("dx") + F.col("p_size") % 5 - 2).alias("dx"), F.col("overlap").alias("weight"))


EDGES = "edges AS (SELECT a, b, dy + p_size%3 - 1 AS dy, dx + p_size%5 - 2 AS dx, (max_y-min_y)*(max_x-min_x)/((ay1-ay0)*(ax1-ax0)) AS weight FROM pairs JOIN (SELECT p_partkey, p_size FROM part) p ON b=p_partkey)"


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tile centres as nodes of a layout."""
    return tiles(spark, sf_dir).select("id", ((F.col("min_y") + F.col("max_y")) / 2).alias("y"), ((F.col("min_x") + F.col("max_x")) / 2).alias("x"))


NODES = "nodes AS (SELECT id, (min_y+max_y)/2 AS y, (min_x+max_x)/2 AS x FROM tiles)"


def control_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Control points (tf_id, idx, t_y, t_x, s_y, s_x) of one transform per nation, from supplier."""
    s = load(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    sy, sx = (F.floor(k / 10) * 10).cast("double"), ((k % 10) * 10).cast("double")
    j = F.round(F.col("s_acctbal")).cast("bigint")
    return s.select(F.col("s_nationkey").alias("tf_id"), k.alias("idx"), (sy + F.abs(j) % 7).alias("t_y"), (sx + F.abs(j) % 5).alias("t_x"), sy.alias("s_y"), sx.alias("s_x"))


CONTROL = """control_points AS (SELECT s_nationkey AS tf_id, s_suppkey AS idx, floor(s_suppkey/10.0)*10 + abs(round(s_acctbal)::BIGINT)%7 AS t_y, (s_suppkey%10)*10.0::DOUBLE + abs(round(s_acctbal)::BIGINT)%5 AS t_x,
 floor(s_suppkey/10.0)*10 AS s_y, ((s_suppkey%10)*10)::DOUBLE AS s_x FROM supplier)"""


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Section numbers that have records: those of nations without multiples of seven."""
    return load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("section")).filter("section % 7 <> 0")


SECTIONS = "sections AS (SELECT n_nationkey AS section FROM nation WHERE n_nationkey%7<>0)"


def alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment records whose numbers are all there, each once."""
    r = load(spark, sf_dir, "alignment_records").dropDuplicates(["record_id"])
    whole = " and ".join(f"{c} is not null and abs({c}) < 1e308" for c in ("peak_y", "peak_x", "weight", "angle"))
    return r.filter(whole + " and stos_id is not null and flip is not null")


ALIGNMENT = """alignment AS (SELECT DISTINCT record_id, stos_id, peak_y, peak_x, weight, angle, flip FROM alignment_records WHERE stos_id IS NOT NULL AND flip IS NOT NULL
 AND isfinite(peak_y) AND isfinite(peak_x) AND isfinite(weight) AND isfinite(angle))"""
