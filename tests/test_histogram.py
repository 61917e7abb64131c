import math

import pytest
from pyspark.sql import functions as F

from sluicegate.operators import histogram as H


@pytest.mark.parametrize("n, size, last", [(10, 102, 1000.0), (102, 102, 1000.0),
                                           (103, 103, 1e6), (150, 150, 1e6)])
def test_hybrid_bounds(n, size, last):
    bounds = H.hybrid_bounds(n)
    assert len(bounds) == size and bounds[:3] == [0.0, 10.0, 20.0] and bounds[100] == 1000.0
    assert math.isclose(bounds[-2], last, rel_tol=1e-9) and bounds[-1] == math.inf


def test_pow2_bounds():
    bounds = H.pow2_bounds(100)
    assert len(bounds) == 100 and bounds[:4] == [0.0, 1.0, 2.0, 4.0] and bounds[-2] == 2.0 ** 97
    assert H.pow2_bounds(2) == [0.0, math.inf] and H.pow2_bounds(1030)[-2] == math.inf


@pytest.mark.parametrize("low, high, first", [(1.0, 1e6, 1.1513954), (0.1, 100.0, 0.1073031),
                                              (100.0, 10_000.0, 104.8113134)])
def test_log_bounds(low, high, first):
    bounds = H.log_bounds(100, low, high)
    assert len(bounds) == 100 and math.isclose(bounds[1], first, rel_tol=1e-6)
    assert math.isclose(bounds[-2], high, rel_tol=1e-9)
    assert H.log_bounds(2) == [0.0, math.inf]
    with pytest.raises(ValueError):
        H.log_bounds(10, 0.0)


def test_values_belong_to_the_first_bound_not_below(spark):
    data = [-5.0, 0.0, 0.5, 1.0, 1.5, 2.0, 1e9, math.inf, math.nan, None]
    df = spark.createDataFrame([(v,) for v in data], "x double")
    got = {r.bucket: r.n for r in H.histogram(df, F.col("x"), [0.0, 1.0, 2.0, math.inf]).collect()}
    assert got == {0: 2, 1: 2, 2: 2, 3: 2}


def test_events_histogram(spark):
    events = spark.read.parquet("/root/testdata/sf0.01/events.parquet")
    hist = H.histogram(events, F.col("value"), H.pow2_bounds(10)).orderBy("bucket").collect()
    assert [r.n for r in hist] == [0, 180, 210, 383, 723, 1200, 2038, 2492, 2015, 759]
    assert [r.bound_2dp for r in hist][:3] == [0.0, 1.0, 2.0]
