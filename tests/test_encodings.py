"""Encodings of positions beyond what their SQL twins show."""

import pytest
from pyspark.sql import functions as F

from terraloom.functions import encodings


def test_lengths_and_nulls(spark):
    df = spark.createDataFrame([(10.0, 20.0), (None, 20.0), (-90.0, 180.0)], "lat double, lon double")
    sizes = {"direct": 2, "cartesian3d": 3, "wrap": 4, "grid": 12, "spherec": 18, "spherecplus": 36, "spherem": 30, "spheremplus": 48, "theory": 18, "sphericalharmonics": 25}
    rows = df.select(*[encodings.encoding(n, F.col("lat"), F.col("lon"), count=3, degrees=5).alias(n) for n in sizes]).collect()
    for row in rows:
        assert {n: len(row[n]) for n in sizes} == sizes
    assert all(x is not None for n in sizes for x in [*rows[0][n], *rows[2][n]])
    assert rows[1]["cartesian3d"] == [None] * 3


def test_harmonics_of_one_degree_sum_to_a_constant(spark):
    """The squares of all orders of degree l add up to (2 l + 1) / (4 pi) anywhere, also of high degrees."""
    import math

    df = spark.createDataFrame([(12.5, -77.0), (-61.0, 149.0)], "lat double, lon double")
    for (values,) in df.select(encodings.harmonics(F.col("lat"), F.col("lon"), 40)).collect():
        for deg in (0, 1, 7, 39):
            own = values[deg * deg : (deg + 1) ** 2]
            assert sum(v * v for v in own) == pytest.approx((2 * deg + 1) / (4 * math.pi))


def test_frequencies_and_names(spark):
    assert encodings.frequencies(1, 2.0, 360.0) == [0.5]
    assert encodings.frequencies(3, 1.0, 100.0) == pytest.approx([1.0, 0.1, 0.01])
    with pytest.raises(ValueError):
        encodings.frequencies(0)
    with pytest.raises(ValueError):
        encodings.encoding("none", F.lit(0.0), F.lit(0.0))
