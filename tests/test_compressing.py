from pyspark.sql import functions as F

from lattica.operators import records


def test_numbers_with_exponents_and_signs(spark):
    rows = spark.createDataFrame([("Rigid vp 2\n+1.50e+10\t-2.000E-3 +0.10 100 1.0x 5. 12.3400",), (None,), ("",)], "t string")
    got = [r[0] for r in rows.select(records.compressed_numbers(F.col("t"))).collect()]
    assert got == ["Rigid vp 2 +1.5e+10 -2E-3 +0.1 100 1.0x 5. 12.34", None, ""]
