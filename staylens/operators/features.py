"""Cleaning and feature derivation for listings (all native column expressions)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staylens.functions import fixed
from staylens.functions.expressions import cut, min_distance_km, season
from staylens.operators.quantiles import exact_quantiles


def clean_listings(df: DataFrame, price: str = "price") -> DataFrame:
    """Keep rows whose price is known and strictly between 0 and 10000."""
    p = F.col(price)
    return df.where(p.isNotNull() & ~F.isnan(p)
                    & (p > F.lit(fixed.PRICE_FLOOR)) & (p < F.lit(fixed.PRICE_CEILING)))


@dataclass(frozen=True)
class PriceBounds:
    """Scalars of the cleaned, *unfiltered* price column used later as constants.

    ``cuts`` are the inner quintile edges (p20, p40, p60, p80); ``p85`` is the
    default upper bound of the price filter and ``p95`` the slider ceiling.
    """

    min: float | None
    max: float | None
    cuts: tuple[float, ...]
    p85: float | None
    p95: float | None


def price_bounds(clean: DataFrame, price: str = "price", **quantile_kw) -> PriceBounds:
    """All price scalars from one stats pass plus one selection pass."""
    probs = [0.0, *fixed.PRICE_CATEGORY_PROBS, fixed.DEFAULT_PRICE_UPPER_PROB,
             fixed.PRICE_SLIDER_MAX_PROB, 1.0]
    q = exact_quantiles(clean, price, probs, **quantile_kw).get(())
    if q is None:
        return PriceBounds(None, None, (), None, None)
    return PriceBounds(q[0], q[-1], tuple(q[1:5]), q[5], q[6])


def price_category(price: str, bounds: PriceBounds) -> F.Column:
    """Quintile labels; lowest edge included (``qcut``).  Equal edges are allowed:
    a price goes to the first bin whose upper edge is >= the price."""
    if bounds.min is None:
        return F.lit(None).cast("string")
    edges = [bounds.min, *bounds.cuts, bounds.max]
    return cut(price, [float(e) for e in edges], fixed.PRICE_CATEGORY_LABELS,
               include_lowest=True)


DERIVED_ORDER = ["price_per_review", "occupancy_rate", "estimated_revenue", "price_category",
                 "review_month", "review_season", "host_category", "distance_to_beach",
                 "beach_proximity", "host_experience"]


def derive(clean: DataFrame) -> DataFrame:
    """Every derived column that does not need table-wide bounds.

    This is the table to keep (cache / write): filters and groupings on the
    categories then read stored values instead of re-evaluating the distance
    expressions that Catalyst would inline into each pushed-down predicate.
    """
    avail = F.col("availability_365")
    occupied = F.lit(365) - avail
    month = F.month("last_review")
    return clean.select(
        "*",
        (F.col("price") / (F.col("number_of_reviews") + F.lit(1))).alias("price_per_review"),
        (occupied / F.lit(365.0)).alias("occupancy_rate"),
        (F.col("price") * occupied).alias("estimated_revenue"),
        month.alias("review_month"),
        season(month).alias("review_season"),
        cut("calculated_host_listings_count", fixed.HOST_CATEGORY_EDGES,
            fixed.HOST_CATEGORY_LABELS).alias("host_category"),
        min_distance_km("latitude", "longitude").alias("distance_to_beach"),
    ).select(
        "*",
        cut("distance_to_beach", fixed.BEACH_PROXIMITY_EDGES,
            fixed.BEACH_PROXIMITY_LABELS).alias("beach_proximity"),
        cut("number_of_reviews", fixed.HOST_EXPERIENCE_EDGES,
            fixed.HOST_EXPERIENCE_LABELS).alias("host_experience"),
    )


def finish(derived: DataFrame, bounds: PriceBounds) -> DataFrame:
    """Add the price quintile label and put the columns in the dashboard's order."""
    base_cols = [c for c in derived.columns if c not in DERIVED_ORDER]
    out = derived.withColumn("price_category", price_category("price", bounds))
    return out.select(*base_cols, *DERIVED_ORDER)


def enrich(clean: DataFrame, bounds: PriceBounds) -> DataFrame:
    """Derived columns, in the dashboard's order, appended to the listing columns."""
    return finish(derive(clean), bounds)
