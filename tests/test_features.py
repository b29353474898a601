import datetime as dt

import pytest
from pyspark.sql import functions as F

from rows import listings
from staylens.functions import fixed
from staylens.functions.expressions import cut, round2, season
from staylens.operators.features import clean_listings, enrich, price_bounds


def _cut_values(spark, values, edges, labels):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    return [r[0] for r in df.select(cut("x", edges, labels)).collect()]


@pytest.mark.parametrize("edges,labels,probe,expect", [
    (fixed.HOST_CATEGORY_EDGES, fixed.HOST_CATEGORY_LABELS,
     [0, 1, 2, 5, 6, 20, 21, None],
     [None, "Single Property", "Small Portfolio", "Small Portfolio", "Medium Portfolio",
      "Medium Portfolio", "Large Portfolio", None]),
    (fixed.HOST_EXPERIENCE_EDGES, fixed.HOST_EXPERIENCE_LABELS,
     [0, 1, 10, 11, 50, 51, 100, 101],
     [None, "New (0-10 reviews)", "New (0-10 reviews)", "Growing (11-50)", "Growing (11-50)",
      "Experienced (51-100)", "Experienced (51-100)", "Veteran (>100)"]),
    (fixed.OCCUPANCY_BAND_EDGES, fixed.OCCUPANCY_BAND_LABELS,
     [0.0, 0.2, 0.2000001, 1.0, 1.01],
     [None, "0-20%", "20-40%", "80-100%", None]),
    (fixed.MIN_NIGHTS_EDGES, fixed.MIN_NIGHTS_LABELS,
     [0, 1, 3, 4, 7, 30, 31],
     [None, "1 night", "2-3 nights", "4-7 nights", "4-7 nights", "1-4 weeks", "1+ months"]),
    (fixed.GUEST_TYPE_EDGES, fixed.GUEST_TYPE_LABELS,
     [1, 4, 5, 15, 16, 30, 31],
     ["Tourist (1 night)", "Short Stay (2-4 nights)", "Extended Stay (5-15 nights)",
      "Extended Stay (5-15 nights)", "Monthly (16-30 nights)", "Monthly (16-30 nights)",
      "Long-term (30+ nights)"]),
    (fixed.PRICE_RANGE_EDGES, fixed.PRICE_RANGE_LABELS,
     [0, 50, 50.5, 100, 200, 500, 500.01],
     [None, "$0-50", "$51-100", "$51-100", "$101-200", "$201-500", "$500+"]),
])
def test_right_closed_bins(spark, edges, labels, probe, expect):
    got = _cut_values(spark, [None if v is None else float(v) for v in probe], edges, labels)
    assert got == expect


def test_quintiles_and_clean(spark):
    rows = [dict(price=float(p)) for p in range(1, 11)]
    rows += [dict(price=None), dict(price=0.0), dict(price=10000.0), dict(price=float("nan"))]
    clean = clean_listings(listings(spark, rows))
    assert clean.count() == 10
    b = price_bounds(clean)
    assert b.cuts == pytest.approx((2.8, 4.6, 6.4, 8.2))
    assert (b.min, b.max) == (1.0, 10.0)
    cats = dict(enrich(clean, b).groupBy("price_category").count().collect())
    assert cats == {lab: 2 for lab in fixed.PRICE_CATEGORY_LABELS}


def test_equal_quintile_edges_allowed(spark):
    clean = listings(spark, [dict(price=5.0)] * 6 + [dict(price=9.0)])
    b = price_bounds(clean)
    cats = [r[0] for r in enrich(clean, b).select("price_category").collect()]
    assert cats.count("Budget") == 6 and cats.count("Luxury") == 1


def test_distance_and_proximity(spark):
    lat, lon = fixed.BEACH_POINTS[0]
    df = listings(spark, [dict(latitude=lat, longitude=lon),
                          dict(latitude=None, longitude=None),
                          dict(latitude=lat + 0.018, longitude=lon)])
    b = price_bounds(df)
    out = enrich(df, b).orderBy("id").select("distance_to_beach", "beach_proximity").collect()
    assert out[0][0] == 0.0 and out[0][1] is None       # distance 0 -> no category
    assert out[1][0] is None and out[1][1] is None
    assert out[2][0] == pytest.approx(2.0015, abs=1e-3)  # 0.018 deg latitude
    assert out[2][1] == "Near Beach (1-3km)"


def test_seasons(spark):
    df = spark.createDataFrame([(m,) for m in range(1, 13)] + [(None,)], "m int")
    got = [r[0] for r in df.select(season("m")).collect()]
    assert got == ["Summer", "Summer", "Fall", "Fall", "Fall", "Winter", "Winter", "Winter",
                   "Spring", "Spring", "Spring", "Summer", None]


def test_enrich_columns(spark):
    df = listings(spark, [dict(price=73.0, availability_365=73, number_of_reviews=0,
                               last_review=None)])
    r = enrich(df, price_bounds(df)).collect()[0]
    assert r.occupancy_rate == pytest.approx(0.8)
    assert r.estimated_revenue == pytest.approx(73.0 * 292)
    assert r.price_per_review == 73.0
    assert r.host_experience is None and r.review_season is None


def test_rounding_half_even_like_pandas(spark):
    df = spark.createDataFrame([(0.125,), (0.375,), (2.675,), (535.6203625,)], "x double")
    got = [r[0] for r in df.select(round2("x", 2)).collect()]
    assert got == [0.12, 0.38, 2.68, 535.62]   # numpy.round gives the same
    six = df.select(round2("x", 6)).collect()[3][0]
    assert six == 535.620363   # numpy.round(535.6203625, 6)


def test_whole_numbers_are_those_of_bround(spark):
    xs = [0.5, 1.5, 2.5, -0.5, -1.5, -0.3, -0.0, 0.49999999999999994, 0.50000000000000011, 1e20,
          4503599627370495.5, 4503599627370497.0, -1e300, float("inf"), float("-inf"), None]
    df = spark.createDataFrame([(x,) for x in [*xs, float("nan")]], "x double")
    both = df.select(round2("x", 0).alias("a"), F.bround("x", 0).alias("b"))
    rows = both.collect()
    assert all(repr(r.a) == repr(r.b) for r in rows)       # with the sign of zero
    plan = df.select(round2("x", 6))._jdf.queryExecution().optimizedPlan().toString()
    assert "bround" not in plan.lower()                     # a decimal a value
