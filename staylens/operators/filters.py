"""Filters and predicates: the sidebar filter set, IQR fences, ad-hoc filters."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staylens.functions import fixed
from staylens.operators.features import PriceBounds
from staylens.operators.quantiles import exact_quantiles

ALL = "All"


@dataclass(frozen=True)
class FilterSpec:
    """The dashboard's filter widgets as data.

    ``price_range=None`` means the default band ``[min, p85]`` of the unfiltered
    table; ``host_categories=None`` means every category including null (the
    default multiselect holds all unique values, null included).
    """

    neighbourhood_group: str = ALL
    room_type: str = ALL
    price_range: tuple[float, float] | None = None
    min_reviews: int = fixed.MIN_REVIEWS_DEFAULT
    availability: tuple[int, int] = fixed.AVAILABILITY_DEFAULT
    host_categories: Sequence[str | None] | None = field(default=None)

    def __post_init__(self):
        # hashable (the spec keys the per-session context memo)
        if self.host_categories is not None:
            object.__setattr__(self, "host_categories", tuple(self.host_categories))
        if self.price_range is not None:
            object.__setattr__(self, "price_range", tuple(self.price_range))
        object.__setattr__(self, "availability", tuple(self.availability))

    def resolved_price_range(self, bounds: PriceBounds) -> tuple[float, float] | None:
        if self.price_range is not None:
            return self.price_range
        if bounds.min is None:
            return None
        return (bounds.min, bounds.p85)


def membership(c: str | Column, values: Sequence) -> Column:
    """``isin`` that also matches null when None is among the values."""
    x = F.col(c) if isinstance(c, str) else c
    vals = [v for v in values if v is not None]
    pred = x.isin(*vals) if vals else F.lit(False)
    if any(v is None for v in values):
        pred = pred | x.isNull()
    return pred


def filter_predicate(spec: FilterSpec, bounds: PriceBounds) -> Column:
    pred = F.lit(True)
    if spec.neighbourhood_group != ALL:
        pred = pred & (F.col("neighbourhood_group") == F.lit(spec.neighbourhood_group))
    if spec.room_type != ALL:
        pred = pred & (F.col("room_type") == F.lit(spec.room_type))
    band = spec.resolved_price_range(bounds)
    if band is not None:
        pred = pred & (F.col("price") >= F.lit(float(band[0]))) & (
            F.col("price") <= F.lit(float(band[1])))
    pred = pred & (F.col("number_of_reviews") >= F.lit(int(spec.min_reviews)))
    lo, hi = spec.availability
    pred = pred & (F.col("availability_365") >= F.lit(int(lo))) & (
        F.col("availability_365") <= F.lit(int(hi)))
    if spec.host_categories is not None:
        pred = pred & membership("host_category", spec.host_categories)
    return pred


def apply_filters(df: DataFrame, spec: FilterSpec, bounds: PriceBounds) -> DataFrame:
    """The filtered table.  Bounds are literals, so the predicate pushes down."""
    return df.where(filter_predicate(spec, bounds))


def default_price_band(bounds: PriceBounds, spark) -> DataFrame:
    """Default band and slider limits of the price filter as one row."""
    return spark.createDataFrame(
        [(bounds.min, bounds.p85, bounds.p95)],
        "price_min double, price_default_max double, price_slider_max double")


def iqr_bounds(df: DataFrame, cols: Sequence[str] = ("price", "occupancy_rate"),
               clamp: dict | None = None, **quantile_kw) -> dict[str, tuple[float, float]]:
    """1.5 x IQR fences per column, all from one unpivoted quantile pass."""
    clamp = clamp if clamp is not None else {"occupancy_rate": (0.0, 1.0)}
    stacked = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("col"), F.col(c).cast("double").alias("v")) for c in cols
    ])).alias("s")).select("s.col", "s.v")
    q = exact_quantiles(stacked, "v", [0.25, 0.75], ["col"], **quantile_kw)
    out = {}
    for c in cols:
        if (c,) not in q:
            out[c] = (None, None)
            continue
        q1, q3 = q[(c,)]
        lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        if c in clamp:
            lo, hi = max(clamp[c][0], lo), min(clamp[c][1], hi)
        out[c] = (lo, hi)
    return out


def iqr_clean(df: DataFrame, cols: Sequence[str] = ("price", "occupancy_rate"),
              **quantile_kw) -> DataFrame:
    """Drop rows missing any column, then keep rows inside every IQR fence.

    Both fences come from the same (non-null) input, as in the dashboard.
    """
    base = df.dropna(subset=list(cols))
    fences = iqr_bounds(base, cols, **quantile_kw)
    pred = F.lit(True)
    for c, (lo, hi) in fences.items():
        if lo is None:
            return base.limit(0)
        pred = pred & (F.col(c) >= F.lit(float(lo))) & (F.col(c) <= F.lit(float(hi)))
    return base.where(pred)


def value_domain(df: DataFrame, col: str) -> DataFrame:
    """Distinct values for a picker, null included."""
    return df.select(col).distinct()


@dataclass(frozen=True)
class ColumnFilter:
    """One ad-hoc explorer filter: membership, numeric/date range or text pattern."""

    column: str
    values: Sequence | None = None
    between: tuple | None = None
    pattern: str | None = None


def adhoc_filter(df: DataFrame, filters: Sequence[ColumnFilter]) -> DataFrame:
    """Per-column explorer filters; text patterns are case-insensitive."""
    pred = F.lit(True)
    for f in filters:
        c = F.col(f.column)
        if f.values is not None:
            pred = pred & membership(c, f.values)
        if f.between is not None:
            pred = pred & c.between(F.lit(f.between[0]), F.lit(f.between[1]))
        if f.pattern is not None:
            pred = pred & c.rlike("(?i)" + f.pattern)
    return df.where(pred)


def top_k_members(df: DataFrame, key: str, k: int = 10) -> DataFrame:
    """Keys of the ``k`` largest groups (count desc, then key): a bounded table."""
    return (df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), F.asc(key)).limit(k).select(key))


def keep_top_k(df: DataFrame, key: str, k: int = 10) -> DataFrame:
    """Rows whose ``key`` is among the ``k`` most frequent (broadcast semi join of
    a table of at most ``k`` rows)."""
    return df.join(F.broadcast(top_k_members(df, key, k)), key, "left_semi")


def with_reviews_filter(df: DataFrame) -> DataFrame:
    """Listings with at least one review."""
    return df.where(F.col("number_of_reviews") > 0)
