import datetime as dt

import pytest
from pyspark.sql import functions as F

from rows import listings
from staylens.functions import fixed
from staylens.operators import filters as flt
from staylens.operators import summaries as sm
from staylens.operators.features import enrich, price_bounds


def _enriched(spark, rows):
    df = listings(spark, rows)
    return enrich(df, price_bounds(df))


def test_empty_category_kept(spark):
    lat, lon = fixed.BEACH_POINTS[0]
    rows = [dict(latitude=lat + 0.001, longitude=lon, price=100.0),   # beachfront
            dict(latitude=lat + 0.001, longitude=lon, price=300.0),
            dict(latitude=lat + 0.1, longitude=lon, price=50.0)]      # inland
    out = sm.price_by_proximity(_enriched(spark, rows)).collect()
    assert [r.beach_proximity for r in out] == fixed.BEACH_PROXIMITY_LABELS
    assert [r.listings for r in out] == [2, 0, 0, 1]
    assert out[0].mean_price == 200.0 and out[0].median_price == 200.0
    assert out[1].mean_price is None and out[1].median_price is None


def test_month_gap_filled_only_in_monthly_metrics(spark):
    dates = [dt.date(2024, 1, 5), dt.date(2024, 4, 2), dt.date(2024, 4, 3), None]
    df = _enriched(spark, [dict(last_review=d) for d in dates])
    mm = sm.monthly_metrics(df).collect()
    assert [r.month for r in mm] == [dt.date(2024, 1, 31), dt.date(2024, 2, 29),
                                     dt.date(2024, 3, 31), dt.date(2024, 4, 30)]
    assert [r.listings for r in mm] == [1, 0, 0, 2]
    assert mm[1].avg_price is None
    assert sm.monthly_price_by_room(df).count() == 2


def test_single_listing_group_scored_last(spark):
    rows = [dict(neighbourhood="Solo", price=100.0)]
    rows += [dict(neighbourhood="Pair", price=p) for p in (100.0, 110.0)]
    out = sm.competition_top10(_enriched(spark, rows)).collect()
    assert [r.neighbourhood for r in out] == ["Pair", "Solo"]
    assert out[1].price_std is None and out[1].competition_score is None
    # score from rounded aggregates: 2*0.4 + 1/(7.07+1)*100*0.3 + occ*100*0.3
    occ = round((365 - 100) / 365, 2)
    assert out[0].competition_score == pytest.approx(
        round(2 * 0.4 + 1 / (7.07 + 1) * 100 * 0.3 + occ * 100 * 0.3, 2))


def test_constant_column_correlation_is_null(spark):
    rows = [dict(price=float(p), availability_365=100, number_of_reviews=p) for p in range(1, 6)]
    m = {(r.feature_x, r.feature_y): r.r for r in sm.corr_matrix(_enriched(spark, rows)).collect()}
    assert m[("price", "availability_365")] is None
    assert m[("price", "number_of_reviews")] == pytest.approx(1.0)


def test_pairwise_complete_correlation(spark):
    rows = [dict(price=1.0, reviews_per_month=1.0), dict(price=2.0, reviews_per_month=None),
            dict(price=3.0, reviews_per_month=3.0), dict(price=4.0, reviews_per_month=2.0)]
    m = {(r.feature_x, r.feature_y): r.r for r in sm.corr_matrix(_enriched(spark, rows)).collect()}
    import numpy as np
    assert m[("price", "reviews_per_month")] == pytest.approx(
        np.corrcoef([1, 3, 4], [1, 3, 2])[0, 1], abs=1e-6)


def test_ties_broken_deterministically(spark):
    rows = [dict(neighbourhood=n) for n in ("B", "A", "C", "A", "B")]
    out = sm.top_neighbourhoods(_enriched(spark, rows), k=2).collect()
    assert [(r.neighbourhood, r.listings) for r in out] == [("A", 2), ("B", 2)]
    eff = sm.top_efficiency(_enriched(spark, [dict(availability_365=0)] * 3), k=2).collect()
    assert [r.id for r in eff] == [1, 2]


def test_sweet_spot_tie_goes_to_lower_range(spark):
    rows = [dict(price=40.0, number_of_reviews=10), dict(price=80.0, number_of_reviews=10)]
    rbp = sm.reviews_by_price_range(_enriched(spark, rows))
    assert sm.sweet_spot(rbp).collect()[0][0] == "$0-50"


def test_segments_share_and_winners(spark):
    rows = [dict(minimum_nights=1, price=50.0), dict(minimum_nights=2, price=80.0),
            dict(minimum_nights=3, price=90.0), dict(minimum_nights=0)]
    seg = sm.guest_segments(_enriched(spark, rows))
    counts = {r.guest_type: r.listings for r in seg.collect()}
    assert counts == {"Tourist (1 night)": 1, "Short Stay (2-4 nights)": 2,
                      "Extended Stay (5-15 nights)": 0, "Monthly (16-30 nights)": 0,
                      "Long-term (30+ nights)": 0}
    share = {r.guest_type: r.share_pct for r in sm.market_share(seg).collect()}
    assert share["Tourist (1 night)"] == pytest.approx(33.3)
    assert sum(share.values()) == pytest.approx(100.0, abs=0.11)
    w = sm.segment_winners(seg).collect()[0]
    assert w.largest_market == "Short Stay (2-4 nights)"


def test_null_in_membership_filter(spark):
    rows = [dict(calculated_host_listings_count=1), dict(calculated_host_listings_count=0)]
    df = _enriched(spark, rows)      # the 0 count has no host category (null)
    b = price_bounds(df)
    keep_all = flt.apply_filters(df, flt.FilterSpec(host_categories=["Single Property", None]), b)
    keep_one = flt.apply_filters(df, flt.FilterSpec(host_categories=["Single Property"]), b)
    default = flt.apply_filters(df, flt.FilterSpec(), b)
    assert keep_all.count() == 2 and keep_one.count() == 1 and default.count() == 2


def test_default_price_band_is_min_to_p85(spark):
    df = _enriched(spark, [dict(price=float(p)) for p in range(1, 21)])
    b = price_bounds(df)
    f = flt.apply_filters(df, flt.FilterSpec(), b)
    assert b.p85 == pytest.approx(1 + 0.85 * 19)
    assert f.agg(F.max("price")).collect()[0][0] == 17.0


def test_categorical_top5_null_in_denominator(spark):
    rows = [dict(neighbourhood_group="N"), dict(neighbourhood_group=None)]
    out = sm.categorical_top5(_enriched(spark, rows), ["neighbourhood_group", "host_category"])
    got = {(r.column, r.value): r.pct for r in out.collect()}
    assert got[("neighbourhood_group", "N")] == 50.0
    assert got[("host_category", "Large Portfolio")] == 0.0   # empty label listed


def test_iqr_fences(spark):
    rows = [dict(price=float(p), availability_365=100) for p in range(10, 30)]
    rows.append(dict(price=5000.0, availability_365=100))
    out = flt.iqr_clean(_enriched(spark, rows))
    assert out.agg(F.max("price")).collect()[0][0] == 29.0
    fences = flt.iqr_bounds(_enriched(spark, rows))
    assert fences["occupancy_rate"][0] >= 0.0 and fences["occupancy_rate"][1] <= 1.0


def test_empty_input_gives_empty_frames(spark):
    df = _enriched(spark, [dict(price=10.0)]).where("price > 100")
    assert sm.price_by_room(df).count() == 0
    assert [r.listings for r in sm.price_by_proximity(df).collect()] == [0, 0, 0, 0]
    assert sm.monthly_metrics(df).count() == 0
    assert sm.kpi_summary(df, F.lit(True)).collect()[0].total_listings == 0
    assert sm.describe_numeric(df).where("count > 0").count() == 0


def test_room_mix_zero_filled(spark):
    rows = [dict(neighbourhood="A", room_type="Entire home/apt"),
            dict(neighbourhood="A", room_type="Private room"),
            dict(neighbourhood="B", room_type="Entire home/apt")]
    out = {(r.neighbourhood, r.room_type): (r.listings, r.pct)
           for r in sm.room_mix(_enriched(spark, rows)).collect()}
    assert out[("B", "Private room")] == (0, 0.0)
    assert out[("A", "Private room")] == (1, 50.0)


def test_column_profile_and_describe(spark):
    df = _enriched(spark, [dict(price=1.0), dict(price=2.0), dict(price=3.0),
                           dict(price=4.0, reviews_per_month=None)])
    prof = {r.column: r for r in sm.column_profile(df).collect()}
    assert prof["reviews_per_month"].null_pct == 25.0 and prof["price"].type == "double"
    d = {r.column: r for r in sm.describe_numeric(df, ["price"]).collect()}
    assert (d["price"].p50, d["price"].p25, d["price"].std) == (2.5, 1.75, 1.29)


def test_map_layer_columns_follow_colour(spark):
    df = _enriched(spark, [dict(price=10.0), dict(price=20.0)])
    occ = sm.map_points(df, "occupancy_rate", "estimated_revenue").columns
    assert occ == ["id", "latitude", "longitude", "occupancy_rate", "estimated_revenue",
                   "name", "price", "room_type"]
    cat = sm.map_points(df, "room_type", "number_of_reviews").columns
    assert cat == ["id", "latitude", "longitude", "room_type", "number_of_reviews", "name", "price"]
    with pytest.raises(ValueError):
        sm.map_points(df, "host_id", "price")
    cells = sm.map_density(df, 0.5).collect()
    assert sum(r.listings for r in cells) == 2


def test_display_formats_follow_dashboard(spark):
    df = _enriched(spark, [dict(price=1234.5, minimum_nights=1, availability_365=0),
                           dict(price=1234.5, minimum_nights=1, availability_365=0)])
    seg = {r.guest_type: r for r in sm.segment_display(sm.guest_segments(df)).collect()}
    tourist = seg["Tourist (1 night)"]
    assert tourist.avg_price == "$1234.50"            # f"${x:.2f}": no separator
    assert tourist.avg_revenue == "$450,592"           # f"${x:,.0f}"
    assert tourist.avg_occupancy == "100.0%"
    summ = {r.metric: r.value for r in sm.export_summary(df, "t").collect()}
    assert summ["Average Price"] == "$1234.50" and summ["Total Revenue"] == "$901,185"


def test_adhoc_filter_date_range_and_pattern(spark):
    rows = [dict(last_review=dt.date(2024, 1, 10), neighbourhood="Copa Norte"),
            dict(last_review=dt.date(2024, 3, 1), neighbourhood="copa sul"),
            dict(last_review=None, neighbourhood="COPA"),
            dict(last_review=dt.date(2024, 2, 1), neighbourhood="Leme")]
    df = _enriched(spark, rows)
    got = flt.adhoc_filter(df, [
        flt.ColumnFilter("last_review", between=(dt.date(2024, 1, 1), dt.date(2024, 2, 15))),
        flt.ColumnFilter("neighbourhood", pattern="copa")]).select("id").collect()
    assert [r.id for r in got] == [1]
    got = flt.adhoc_filter(df, [flt.ColumnFilter("neighbourhood", pattern="^copa")]).count()
    assert got == 3


def test_kpi_approx_hosts_opt_in(spark):
    df = _enriched(spark, [dict(host_id=h) for h in range(50)] + [dict(host_id=1)])
    exact = sm.kpi_summary(df, F.lit(True)).collect()[0]
    approx = sm.kpi_summary(df, F.lit(True), approx_hosts=True).collect()[0]
    assert exact.active_hosts == 50 and abs(approx.active_hosts - 50) <= 2


def test_empty_input_keeps_schemas(spark):
    from staylens.operators import ml
    from staylens.operators import stats as st_ops
    rows = [dict(price=float(p), number_of_reviews=p, minimum_nights=p % 7 + 1,
                 neighbourhood="N" + str(p % 3), availability_365=p * 7 % 366) for p in range(1, 60)]
    full = _enriched(spark, rows)
    empty = full.where("price < 0")
    for fn in (st_ops.price_kde, st_ops.price_histogram, lambda d: st_ops.local_trend(d, points=10),
               ml.kmeans_clusters, sm.room_mix, sm.categorical_top5, sm.describe_numeric,
               sm.price_by_room, sm.monthly_metrics, sm.corr_matrix):
        assert fn(full).schema.simpleString() == fn(empty).schema.simpleString()
