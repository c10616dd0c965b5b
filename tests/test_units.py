import random
from datetime import datetime as D
from datetime import timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.functions import units as U
from lattica.operators import changepoints as C
from lattica.operators.changepoints import segment


@pytest.mark.parametrize(("text", "want"), [("16", 16), (" 016 ", 16), ("16.0", 16), ("0.0625", 16), ("0,5", 2), ("6.25%", 16), ("100%", 1), ("1/16", 16), ("1 : 16", 16), ("16:1", 16), ("level 4", 16), ("Level0", 1), ("lvl 3", 8), ("2^5", 32), ("x4", 4), ("64x", 64), ("ds8", 8), ("3", None), ("", None), ("?", None), ("unknown", None), (None, None), ("0", None), ("3:2", None)])
def test_downsample(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(U.downsample_factor(F.col("t"))).first()[0] == want


@pytest.mark.parametrize(("text", "want"), [("12nm 13nm", 1.0), ("[µm] 1 2", 1e3), ("1 x 2 μm", 1e3), ("3 mm", 1e6), ("5 x 6 px", 0.0), ("1 1 3 4", None), ("NM", 1.0), ("comma", None), (None, None)])
def test_unit(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(U.unit_in(F.col("t"))).first()[0] == want


@pytest.mark.parametrize(("text", "want"), [("knife mark at 3 mm from the edge", None), ("section thickness 70 nm; coordinates in microns", 1e3), ("Koordinaten in Nanometer, field of view 40 µm", 1.0), ("control points given in mm", 1e6), ("units: nm", 1.0), ("unit of points = micrometers", 1e3), ("two points, 3 mm apart", None), (None, None)])
def test_remark(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(U.remark_unit(F.col("t"))).first()[0] == want


def test_name(spark):
    names = spark.createDataFrame([("5-3_a_16.stos",), ("5-3_a_full.stos",), ("x_7.stos",), (None,)], "t string")
    assert [r[0] for r in names.select(U.name_downsample(F.col("t"))).collect()] == [16, None, None, None]


def test_changepoints_are_exact(spark):
    rng = np.random.default_rng(2)
    rows = [(s, t, f"{s}{t}", (rng.random(3) * 4).tolist()) for s, n in (("hot", 3000), ("b", 9), ("c", 1)) for t in range(n)]
    got = {r.id: r.level for r in segment(spark.createDataFrame(rows, "source string, at int, id string, costs array<double>"), 3, 1.5).collect()}
    for source in ("hot", "b", "c"):
        cost = np.array([r[3] for r in rows if r[0] == source])
        best = cost[0].copy()
        for c in cost[1:]:
            best = np.minimum(best, best.min() + 1.5) + c
        level = [got[f"{source}{t}"] for t in range(len(cost))]
        paid = sum(c[k] for c, k in zip(cost, level, strict=True)) + 1.5 * sum(a != b for a, b in zip(level, level[1:], strict=False))
        assert abs(paid - best.min()) < 1e-6


def test_planted_unit_changes(spark):
    random.seed(4)
    rows, want = [], {}
    units = ["pixels", "full_pixels", "pixels", "µm", "pixels", "pixels", "mm", "pixels"]
    for i in range(400):
        unit, nm, x = units[i // 25 % 8], 4.0, random.uniform(900, 1100)
        v = {"pixels": x / 16, "full_pixels": x, "µm": x * nm / 1e3, "mm": x * nm / 1e6}[unit]
        rows.append((i, "a" if i % 2 else None, D(2021, 1, 1) + timedelta(hours=i), [v, v * 1.01], 16.0, nm))
        want[i] = (unit, round(x))
    rows.append((1000, "a", None, [0.0], 16.0, None))
    schema = "stos_id bigint, folder string, at timestamp, values array<double>, factor double, pixel_nm double"
    df = spark.createDataFrame(rows, schema).withColumn("written", F.lit("t")).withColumn("source", F.lit("clash"))
    got = {r.stos_id: (r.written_in, r.values_px[0]) for r in C.written_lengths(df).collect()}
    assert got.pop(1000)[1] == 0 and got == want
    assert C.written_lengths(df.limit(0)).count() == 0


def test_planted_downsamples(spark):
    texts = ["16"] * 40 + ["1/16"] * 10 + ["6.25 %"] * 10 + ["level 4"] * 10 + ["0.0625", "2^4", "16:1", "none", None, "level 0"]
    df = spark.createDataFrame([(i, "s", D(2021, 1, 1) + timedelta(hours=i), t) for i, t in enumerate(texts)], "stos_id bigint, stos_dir string, recorded_at timestamp, downsample string")
    got = {r.stos_id: r.factor for r in C.written_downsamples(df).collect()}
    assert all(abs(got[i] - 16) < 1e-9 for i in range(73)) and set(range(len(texts))) - set(got) == {73, 74}
