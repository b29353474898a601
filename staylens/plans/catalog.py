"""Named queries: ``(spark, sf_dir) -> DataFrame`` for each operator of the survey.

Every query reads the given tables through the listing star view
(:func:`staylens.sources.listings.listings_from_tpch`), cleans and enriches it,
applies the default filter set, then runs one operator over the whole table.
"""

from __future__ import annotations

import datetime
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from staylens.operators import filters as flt
from staylens.operators import ml
from staylens.operators import spatial
from staylens.operators import stats as st
from staylens.operators import summaries as sm
from staylens.operators.summaries import rnd
from staylens.plans.context import Context, tpch_context
from staylens.session import scratch_path
from staylens.sources import sinks
from staylens.sources.listings import (listings_from_tpch, parse_price, points_from_tpch,
                                       read_listings_csv)

Query = Callable[[SparkSession, str], DataFrame]

# Fixed parameters of the registered explorer filter.
ADHOC_GROUPS = ["AMERICA", "EUROPE"]
ADHOC_PATTERN = "nation_1"
ADHOC_PRICES = (50.0, 600.0)
ADHOC_DATES = (datetime.date(1994, 3, 1), datetime.date(1995, 2, 28))
ADHOC_ROOMS = ["1-URGENT", "3-MEDIUM"]
GENERATED_AT = "2024-01-01 00:00:00"
# Fixed parameters of the registered non-default sidebar filter.
CUSTOM_FILTER = dict(neighbourhood_group="ASIA", room_type="1-URGENT", price_range=(50.0, 500.0),
                     min_reviews=10, availability=(30, 300),
                     host_categories=("Small Portfolio", "Medium Portfolio"))
MAP_CELL_DEG = 0.01
DERIVED_DOUBLES = ("price_per_review", "occupancy_rate", "estimated_revenue", "distance_to_beach")


def _ctx(spark: SparkSession, sf_dir: str) -> Context:
    return tpch_context(spark, sf_dir)


def _q(fn: Callable[[Context], DataFrame]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(_ctx(spark, sf_dir))
    run.__name__ = fn.__name__
    run.__doc__ = fn.__doc__
    return run


# --- sources, projections, bins ------------------------------------------------------

def listings_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw listing star view (all 16 source columns)."""
    return listings_from_tpch(spark, sf_dir)


def scan_listings_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The star view written as a listings CSV with text prices (``$1,234.56``)
    under the shared scratch folder, then scanned back by the CSV source."""
    raw = listings_from_tpch(spark, sf_dir)
    cols = [(F.concat(F.lit("$"), F.format_number("price", 2)) if f == "price" else F.col(f))
            .cast("string").alias(f) for f in raw.columns]
    path = scratch_path(spark, f"listings-csv-{uuid.uuid4().hex}")
    raw.select(*cols).write.option("header", True).csv(path)
    return read_listings_csv(spark, path)


def scan_listings_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The star view as CSV files with line breaks and quotes inside names, every other
    listing in files whose columns stand in another order, scanned back in splits."""
    raw = listings_from_tpch(spark, sf_dir)
    name = F.when(F.col("id") % 3 == 0, F.concat(F.col("name"), F.lit('\n"sea, view"\n'), F.col("id"))
                  ).otherwise(F.col("name"))
    text = raw.withColumn("name", name).select(*[F.col(c).cast("string") for c in raw.columns])
    path = scratch_path(spark, f"listings-split-{uuid.uuid4().hex}")
    for i, columns in enumerate((raw.columns, raw.columns[::-1])):
        part = text.where(F.col("id") % 2 == i).select(*columns)
        part.write.option("header", True).option("escape", '"').csv(f"{path}/part={i}")
    return read_listings_csv(spark, f"{path}/part=*", multi_line=True)


def q_parse_price(c: Context) -> DataFrame:
    """Prices rendered as ``$1,234.56`` text and parsed back."""
    text = F.concat(F.lit("$"), F.format_number(F.col("price"), 2))
    return c.baseline.select("id", text.alias("price_text")).select(
        "id", "price_text", parse_price("price_text").alias("parsed_price"))


def q_clean(c: Context) -> DataFrame:
    return c.baseline.select("id", "host_id", "price", "last_review",
                             "calculated_host_listings_count")


def q_enrich_basic(c: Context) -> DataFrame:
    return c.baseline.select("id", rnd("price_per_review").alias("price_per_review"),
                             rnd("occupancy_rate").alias("occupancy_rate"),
                             rnd("estimated_revenue").alias("estimated_revenue"))


def q_enrich_season(c: Context) -> DataFrame:
    return c.baseline.select("id", "last_review", "review_month", "review_season")


def q_distance(c: Context) -> DataFrame:
    return c.baseline.select("id", rnd("distance_to_beach").alias("distance_to_beach"))


def q_price_quintile(c: Context) -> DataFrame:
    return c.baseline.select("id", "price", "price_category")


def q_host_category(c: Context) -> DataFrame:
    return c.baseline.select("id", "calculated_host_listings_count", "host_category")


def q_poi_proximity(c: Context) -> DataFrame:
    return c.baseline.select("id", "beach_proximity")


def q_host_experience(c: Context) -> DataFrame:
    return c.baseline.select("id", "number_of_reviews", "host_experience")


def q_map_points(c: Context) -> DataFrame:
    """Map layer coloured by price category, sized by price."""
    return sm.map_points(c.filtered, "price_category", "price")


def q_map_density(c: Context) -> DataFrame:
    """Listings per grid cell of MAP_CELL_DEG degrees."""
    return sm.map_density(c.filtered, MAP_CELL_DEG)


def nearest_poi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each listing's nearest point of a table of points, and its distance."""
    listings = _ctx(spark, sf_dir).baseline.select("id", "latitude", "longitude")
    found = spatial.nearest_point(listings, points_from_tpch(spark, sf_dir))
    return found.select("id", "nearest_poi", "distance_km")


# --- filters -----------------------------------------------------------------------------

def q_filter(c: Context) -> DataFrame:
    return c.filtered.select("id", "price", "host_category")


def q_filter_custom(c: Context) -> DataFrame:
    """Every sidebar control set away from its default."""
    spec = flt.FilterSpec(**CUSTOM_FILTER)
    return flt.apply_filters(c.baseline, spec, c.bounds).select(
        "id", "neighbourhood_group", "room_type", "price", "number_of_reviews",
        "availability_365", "host_category")


def _export_cols(df: DataFrame) -> DataFrame:
    """All columns; derived doubles rounded, since engines differ in the last bits."""
    return df.select(*[rnd(c).alias(c) if c in DERIVED_DOUBLES else F.col(c) for c in df.columns])


def q_export_csv(c: Context) -> DataFrame:
    """Filtered rows written as CSV under the shared scratch folder, read back."""
    src = _export_cols(c.filtered)
    path = sinks.export_csv(src, scratch_path(c.spark, f"export-csv-{uuid.uuid4().hex}"))
    return c.spark.read.schema(src.schema).option("header", True).csv(path)


def q_export_json(c: Context) -> DataFrame:
    """Filtered rows written as JSON Lines (nulls kept), read back."""
    src = _export_cols(c.filtered)
    path = sinks.export_json(src, scratch_path(c.spark, f"export-json-{uuid.uuid4().hex}"))
    return c.spark.read.schema(src.schema).json(path)


def q_export_bundle(c: Context) -> DataFrame:
    """The two-dataset export; returns the summary dataset as read back."""
    from pyspark.sql import types as T
    summary = sm.export_summary(c.filtered, GENERATED_AT)
    paths = sinks.export_bundle(_export_cols(c.filtered), summary,
                                scratch_path(c.spark, f"export-bundle-{uuid.uuid4().hex}"))
    schema = T.StructType([T.StructField("position", T.IntegerType()),
                           T.StructField("metric", T.StringType()),
                           T.StructField("value", T.StringType())])
    return c.spark.read.schema(schema).option("header", True).csv(paths["summary"])


def q_export_listings(c: Context) -> DataFrame:
    """The two-dataset export; returns the listings dataset as read back."""
    src = _export_cols(c.filtered)
    paths = sinks.export_bundle(src, sm.export_summary(c.filtered, GENERATED_AT),
                                scratch_path(c.spark, f"export-listings-{uuid.uuid4().hex}"))
    return c.spark.read.schema(src.schema).option("header", True).csv(paths["listings"])


def q_default_band(c: Context) -> DataFrame:
    b = flt.default_price_band(c.bounds, c.spark)
    return b.select(*[rnd(x).alias(x) for x in b.columns])


def q_iqr_clean(c: Context) -> DataFrame:
    return c.iqr.select("id", "price", rnd("occupancy_rate").alias("occupancy_rate"))


def q_value_domain(c: Context) -> DataFrame:
    parts = [flt.value_domain(c.baseline, col).select(F.lit(col).alias("column"),
                                                     F.col(col).cast("string").alias("value"))
             for col in ("neighbourhood_group", "room_type", "host_category")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def q_adhoc(c: Context) -> DataFrame:
    f = flt.adhoc_filter(c.filtered, [
        flt.ColumnFilter("neighbourhood_group", values=ADHOC_GROUPS),
        flt.ColumnFilter("neighbourhood", pattern=ADHOC_PATTERN),
        flt.ColumnFilter("price", between=ADHOC_PRICES)])
    return f.select("id", "neighbourhood_group", "neighbourhood", "price")


def q_adhoc_dates(c: Context) -> DataFrame:
    """Listings whose last review lies between two dates, both included."""
    f = flt.adhoc_filter(c.filtered, [flt.ColumnFilter("last_review", between=ADHOC_DATES),
                                      flt.ColumnFilter("room_type", values=ADHOC_ROOMS)])
    return f.select("id", "room_type", "last_review")


def q_explorer_kpis(c: Context) -> DataFrame:
    f = flt.adhoc_filter(c.filtered, [
        flt.ColumnFilter("neighbourhood_group", values=ADHOC_GROUPS),
        flt.ColumnFilter("neighbourhood", pattern=ADHOC_PATTERN),
        flt.ColumnFilter("price", between=ADHOC_PRICES)])
    return sm.explorer_kpis(f)


# --- summaries -----------------------------------------------------------------------------

def q_kpi(c: Context) -> DataFrame:
    return sm.kpi_summary(c.baseline, flt.filter_predicate(c.spec, c.bounds))


def q_filter_summary(c: Context) -> DataFrame:
    return sm.filter_summary(c.baseline, flt.filter_predicate(c.spec, c.bounds), c.spec,
                             c.spec.resolved_price_range(c.bounds))


def q_export_summary(c: Context) -> DataFrame:
    return sm.export_summary(c.filtered, GENERATED_AT)


def q_preview(c: Context) -> DataFrame:
    return _export_cols(sm.preview(c.filtered, 10))


def q_segment_display(c: Context) -> DataFrame:
    return sm.segment_display(sm.guest_segments(c.filtered))


def q_sweet_spot(c: Context) -> DataFrame:
    return sm.sweet_spot(sm.reviews_by_price_range(c.reviewed))


def q_segment_winners(c: Context) -> DataFrame:
    return sm.segment_winners(sm.guest_segments(c.filtered))


def q_market_share(c: Context) -> DataFrame:
    return sm.market_share(sm.guest_segments(c.filtered))


def q_stable_sample(c: Context) -> DataFrame:
    return st.stable_sample(c.iqr).select("id", "availability_365", "price", "occupancy_rate")


def q_kmeans(c: Context) -> DataFrame:
    return ml.with_clusters(c.filtered, c.kmeans()).select("id", "cluster")


def q_cluster_summary(c: Context) -> DataFrame:
    return ml.cluster_summary(ml.with_clusters(c.filtered, c.kmeans()))


def q_cluster_winners(c: Context) -> DataFrame:
    return ml.cluster_winners(q_cluster_summary(c))


def q_segmented(c: Context) -> DataFrame:
    """Every filtered listing with all its columns, its cluster and its PCA scores."""
    return _export_cols(ml.segments(c.filtered, c.kmeans(), c.pca))


def _filtered(fn):
    return _q(lambda c: fn(c.filtered))


QUERIES: dict[str, Query] = {
    # sources and projections
    "listings_view": listings_view,
    "scan_listings": scan_listings_csv,
    "scan_listings_split": scan_listings_split,
    "parse_price": _q(q_parse_price),
    "clean_listings": _q(q_clean),
    "enrich_basic": _q(q_enrich_basic),
    "enrich_season": _q(q_enrich_season),
    "distance_to_poi": _q(q_distance),
    "price_quintile": _q(q_price_quintile),
    "host_category": _q(q_host_category),
    "poi_proximity": _q(q_poi_proximity),
    "host_experience": _q(q_host_experience),
    "map_points": _q(q_map_points),
    "map_density": _q(q_map_density),
    "nearest_poi": nearest_poi,
    # filters
    "filter_listings": _q(q_filter),
    "filter_custom": _q(q_filter_custom),
    "default_price_band": _q(q_default_band),
    "iqr_clean": _q(q_iqr_clean),
    "value_domain": _q(q_value_domain),
    "adhoc_filter": _q(q_adhoc),
    "adhoc_dates": _q(q_adhoc_dates),
    # aggregations
    "kpi_summary": _q(q_kpi),
    "price_by_room": _filtered(sm.price_by_room),
    "box_by_room": _filtered(sm.box_by_room),
    "box_outliers": _q(lambda c: sm.box_outliers(c.baseline)),
    "monthly_price_by_room": _filtered(sm.monthly_price_by_room),
    "price_by_proximity": _filtered(sm.price_by_proximity),
    "count_by_proximity": _filtered(sm.count_by_proximity),
    "map_centre": _filtered(sm.map_centre),
    "top_neighbourhoods": _filtered(sm.top_neighbourhoods),
    "priciest_neighbourhoods": _filtered(sm.priciest_neighbourhoods),
    "review_activity": _filtered(sm.review_activity),
    "room_mix": _filtered(sm.room_mix),
    "revenue_by_room": _filtered(sm.revenue_by_room),
    "host_portfolio": _filtered(sm.host_portfolio),
    "corr_matrix": _filtered(sm.corr_matrix),
    "price_by_occupancy": _q(lambda c: sm.price_by_occupancy(c.iqr)),
    "reviews_by_price_range": _q(lambda c: sm.reviews_by_price_range(c.reviewed)),
    "price_review_corr": _q(lambda c: sm.price_review_corr(c.reviewed)),
    "sweet_spot": _q(q_sweet_spot),
    "experience_performance": _filtered(sm.experience_performance),
    "min_nights_hist": _filtered(sm.min_nights_hist),
    "min_nights_dist": _filtered(sm.min_nights_dist),
    "price_by_min_nights": _filtered(sm.price_by_min_nights),
    "guest_segments": _filtered(sm.guest_segments),
    "segment_display": _q(q_segment_display),
    "segment_winners": _q(q_segment_winners),
    "market_share": _q(q_market_share),
    "describe_numeric": _filtered(sm.describe_numeric),
    "categorical_top5": _filtered(sm.categorical_top5),
    "explorer_kpis": _q(q_explorer_kpis),
    "monthly_metrics": _filtered(sm.monthly_metrics),
    "price_ranges_by_room": _filtered(sm.price_ranges_by_room),
    "competition_top10": _filtered(sm.competition_top10),
    "top_efficiency": _filtered(sm.top_efficiency),
    "filter_summary": _q(q_filter_summary),
    "export_summary": _q(q_export_summary),
    "export_stats": _filtered(sm.export_stats),
    "column_profile": _filtered(sm.column_profile),
    "preview": _q(q_preview),
    "export_csv": _q(q_export_csv),
    "export_json": _q(q_export_json),
    "export_bundle": _q(q_export_bundle),
    "export_listings": _q(q_export_listings),
    # statistics
    "price_histogram": _filtered(st.price_histogram),
    "price_kde": _filtered(st.price_kde),
    "availability_trend": _q(lambda c: st.availability_trend(c.iqr)),
    "local_trend": _q(lambda c: st.local_trend(c.reviewed)),
    "stable_sample": _q(q_stable_sample),
    # segmentation
    "feature_vector": _filtered(ml.feature_vector),
    "standardised_features": _filtered(ml.standardised_features),
    "pca_scores": _q(lambda c: ml.pca_scores(c.filtered, model=c.pca)),
    "pca_loadings": _q(lambda c: ml.pca_loadings(c.filtered, model=c.pca)),
    "pca_variance": _q(lambda c: ml.pca_variance(c.filtered, model=c.pca)),
    "kmeans_clusters": _q(q_kmeans),
    "segmented_listings": _q(q_segmented),
    "cluster_summary": _q(q_cluster_summary),
    "cluster_winners": _q(q_cluster_winners),
    "feature_corr": _filtered(ml.feature_corr),
    "strong_correlations": _filtered(ml.strong_correlations),
}

FLAGSHIP = "price_by_proximity"

__all__ = ["QUERIES", "FLAGSHIP"]
