from datetime import datetime as D

from pyspark.sql import functions as F

from lattica.functions.mosaic_text import entry_file, entry_transform
from lattica.functions.paths import base_name, resolved_path
from lattica.operators.orphans import image_lives, mosaic_references, orphan_references, stos_references

IMAGES = "image_full_path string, registered_at timestamp, deleted_at timestamp, key string"
REFS = "key string, at timestamp, record_id bigint"


def test_paths(spark):
    cases = {
        ("/a/b.png", "/s"): "/a/b.png", (" \\a\\b.png\r\n", "/s"): "/a/b.png", ("../../c/./d//e.png", "/v/Stos/004"): "/v/c/d/e.png", ("x/../y.png", "/v\\w/"): "/v/w/y.png",
        ("/../a", None): "/a", ("C:\\x\\y.png", "/v"): "C:/x/y.png", ("\u00a0/a/b\u3000", None): "/a/b", ("a.png", None): "a.png",
    }
    df = spark.createDataFrame([(p, b, w) for (p, b), w in cases.items()], "p string, b string, w string")
    for r in df.select("p", "w", resolved_path(F.col("p"), F.col("b")).alias("got")).collect():
        assert r.got == r.w, r.p
    assert spark.range(1).select(base_name(F.lit("C:\\scan\\t1.png "))).first()[0] == "t1.png"


def test_mosaic_text(spark):
    rows = [("image:\nt1.png\nRigid 1 2\n", "t1.png", "Rigid 1 2"), ("image: ./a/t2.png Grid vp 1", "t2.png", "Grid vp 1"), ("IMAGE:\r\nC:\\x\\t 3.png \r\nMesh", "t 3.png", "Mesh"), ("image:t4.png", "t4.png", ""), ("", "", "")]
    for r in spark.createDataFrame(rows, "e string, n string, t string").select("n", "t", entry_file(F.col("e")).alias("gn"), F.trim(entry_transform(F.col("e"))).alias("gt")).collect():
        assert (r.gn, r.gt.strip()) == (r.n, r.t)


def test_lives(spark):
    t = lambda d, h=0: D(2021, 1, d, h)
    images = spark.createDataFrame([("/a", t(1), t(3), "x"), ("/a", t(5), None, "x"), ("/a", t(5), None, "x"), ("/b", t(2), t(2), "x"), (None, t(1), None, "x"), ("/c", None, None, "x"), ("/d", t(2, 5), t(2, 7), "x")], IMAGES)
    refs = [("/a", t(1), 1), ("/a", t(3), 2), ("/a", t(4), 3), ("/a", t(9), 4), ("/b", t(2), 5), ("/c", t(2), 6), ("/d", t(2, 6), 7), ("/d", t(2, 7), 8), ("/d", t(2, 4), 9), ("/e", t(2), 10), ("/a", None, 11), ("/a", t(4), 3)]
    got = orphan_references(spark.createDataFrame(refs, REFS), image_lives(images))
    assert sorted(r.record_id for r in got.select("record_id").distinct().collect()) == [2, 3, 5, 6, 8, 9, 10, 11]
    none = spark.createDataFrame([], REFS)
    assert orphan_references(none, image_lives(images)).count() == 0
    assert orphan_references(spark.createDataFrame(refs, REFS), image_lives(images.limit(0))).count() == len(refs)


def test_references_skip_blanks_and_extra_columns(spark):
    stos = spark.createDataFrame([(1, "/v", None, " \n", "../m.png", D(2021, 1, 1), 5)], "stos_id bigint, stos_dir string, control_image_full_path string, mapped_image_full_path string, control_mask_full_path string, recorded_at timestamp, key int")
    assert [tuple(r) for r in stos_references(stos).select("field_name", "key").collect()] == [("control_mask_full_path", "/m.png")]
    tiles = spark.createDataFrame([(1, "/t//x/", "image: y/z.png Rigid", D(2021, 1, 1), "k"), (2, "/t", None, None, "k")], "entry_id bigint, tile_dir string, image_to_transform string, recorded_at timestamp, name string")
    assert [r.key for r in mosaic_references(tiles).collect()] == ["/t/x/z.png"]


def test_hot_key(spark):
    """A key with most rows still answers each of them."""
    images = spark.createDataFrame([("/hot", D(2021, 1, 2), D(2021, 1, 5), "")], IMAGES)
    refs = spark.range(20_000).select(F.lit("/hot").alias("key"), F.expr("timestamp'2021-01-01' + make_interval(0,0,0,cast(id % 6 as int))").alias("at"), F.col("id").alias("record_id"))
    days = 20_000 / 6
    assert abs(orphan_references(refs, image_lives(images)).count() - 3 * days) < 6
