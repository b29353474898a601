"""Grouped summaries, KPIs and profiles.

Conventions:

* R1 - where the dashboard rounds, ``round2(x, 2)`` (as ``Series.round``); statistics it
  shows unrounded are rounded to :data:`DIGITS` decimals so results are stable
  across engines and summation orders.
* R2 - grouping by an ordered category keeps every label (count 0, means null)
  and drops null keys: a tiny label dimension is left-joined to the aggregate.
* R3 - every top-k has an explicit last sort key.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from staylens.functions import fixed
from staylens.functions.expressions import (EXACT_TYPE, cut, exact_avg, exact_sum, label_dimension,
                                            nan_to_null, round2, safe_corr, sorted_small)
from staylens.operators.filters import keep_top_k
from staylens.operators.quantiles import quantile_frame, summary

DIGITS = 6


def rnd(c: str | Column, digits: int = DIGITS) -> Column:
    return round2(c, digits)


def _avg(c: str) -> Column:
    return exact_avg(c)


def grouped_summary(df: DataFrame, key: str, aggs: Sequence[tuple[str, Column]],
                    labels: Sequence[str] | None = None,
                    medians: Sequence[tuple[str, str]] = (),
                    counts: Sequence[str] = (), digits: int | None = 2) -> DataFrame:
    """``groupBy(key).agg(...)`` with medians, R2 completion and rounding.

    ``aggs`` are ``(name, aggregate)``; ``medians`` are ``(name, column)``;
    ``counts`` names the count columns (filled with 0 for empty categories).
    """
    data = df.where(F.col(key).isNotNull())
    if labels is not None:
        # only label rows survive the completion join: aggregating just those
        # bounds the aggregate (and its broadcast) by len(labels)
        data = data.where(F.col(key).isin(*labels))
    if medians:
        out = _with_medians(data, key, aggs, medians)
    else:
        out = data.groupBy(key).agg(*[a.alias(n) for n, a in aggs])
    names = [n for n, _ in aggs] + [n for n, _ in medians]
    if labels is not None:
        dim = label_dimension(df.sparkSession, labels, key)
        out = dim.join(F.broadcast(out), key, "left")
    sel = [F.col(key)]
    for n in names:
        c = F.col(n)
        if n in counts:
            sel.append(F.coalesce(c, F.lit(0)).cast("long").alias(n))
        elif digits is not None:
            sel.append(rnd(c, digits).alias(n))
        else:
            sel.append(c.alias(n))
    if labels is not None:
        return sorted_small(out, "rank").select(*sel)
    return out.select(*sel)


def _with_medians(data: DataFrame, key: str, aggs: Sequence[tuple[str, Column]],
                  medians: Sequence[tuple[str, str]]) -> DataFrame:
    """The grouped aggregate joined with exact medians, whatever the number of groups."""
    out = data.groupBy(key).agg(*[a.alias(n) for n, a in aggs])
    for name, col in medians:
        out = out.join(quantile_frame(data, col, [0.5], [name], [key]), key, "left")
    return out


# --- E1-E4 KPIs --------------------------------------------------------------------

def kpi_summary(baseline: DataFrame, kept: Column, approx_hosts: bool = False) -> DataFrame:
    """Listings, mean price, mean occupancy and distinct hosts of the rows for which ``kept``
    holds, with their change against the whole table (share %, % difference, percentage
    points).

    One scan: rows are added up per host, with and without ``kept`` (combined in the
    tasks, so that a hot host is one row a task), then the hosts are.  That counts hosts
    exactly; ``approx_hosts=True`` opts into ``approx_count_distinct`` (HyperLogLog++,
    about 1% error, no key shuffle)."""
    sums = {}
    for p, own in (("f_", kept), ("b_", F.lit(True))):
        sums[p + "n"] = F.count(F.when(own, 1))
        for name, col in (("price", "price"), ("occ", "occupancy_rate")):
            value = F.when(own, F.col(col).cast(EXACT_TYPE))
            sums[f"{p}{name}"], sums[f"{p}{name}_n"] = F.sum(value), F.count(value)
    if approx_hosts:
        one = baseline.agg(*[c.alias(n) for n, c in sums.items()],
                           F.approx_count_distinct(F.when(kept, F.col("host_id"))).alias("f_hosts"),
                           F.approx_count_distinct("host_id").alias("b_hosts"))
    else:
        hosts = baseline.groupBy("host_id").agg(*[c.alias(n) for n, c in sums.items()])
        named = F.col("host_id").isNotNull()
        one = hosts.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) if n.endswith("n")
                          else F.sum(n).alias(n) for n in sums],
                        F.count(F.when(named & (F.col("f_n") > 0), 1)).alias("f_hosts"),
                        F.count(F.when(named, 1)).alias("b_hosts"))

    def mean(name):
        return F.try_divide(F.col(name).cast("double"), F.col(f"{name}_n")).alias(name)

    j = one.select("f_n", "b_n", "f_hosts", "b_hosts",
                   *[mean(p + name) for p in ("f_", "b_") for name in ("price", "occ")])
    return j.select(
        F.col("f_n").alias("total_listings"),
        rnd(F.try_divide(F.col("f_n") * F.lit(100.0), F.col("b_n")), 2).alias("share_of_total_pct"),
        rnd("f_price", 2).alias("avg_price"),
        rnd((F.try_divide(F.col("f_price"), F.col("b_price")) - 1) * 100, 2).alias("price_diff_pct"),
        rnd(F.col("f_occ") * 100, 2).alias("avg_occupancy_pct"),
        rnd(F.col("f_occ") * 100 - F.col("b_occ") * 100, 2).alias("occupancy_diff_pp"),
        F.col("f_hosts").alias("active_hosts"),
        rnd(F.try_divide(F.col("f_hosts") * F.lit(100.0), F.col("b_hosts")), 2).alias("hosts_share_pct"),
    )


# --- E5-E9 price pages ---------------------------------------------------------------

def price_by_room(df: DataFrame) -> DataFrame:
    return grouped_summary(
        df, "room_type",
        [("mean_price", _avg("price")), ("std_price", F.stddev_samp("price")),
         ("listings", F.count("price"))],
        medians=[("median_price", "price")], counts=["listings"])


def box_by_room(df: DataFrame) -> DataFrame:
    """Quartiles (linear), whiskers at the furthest points inside 1.5 x IQR, and
    the number of outliers per room type."""
    data = df.where(F.col("room_type").isNotNull() & F.col("price").isNotNull())
    q = quantile_frame(data, "price", [0.25, 0.5, 0.75], ["q1", "median", "q3"], by=["room_type"])
    fences = q.select("*", (F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))).alias("lo_f"),
                      (F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))).alias("hi_f"))
    j = data.join(F.broadcast(fences), "room_type")  # one row per room type, bounded
    inside = (F.col("price") >= F.col("lo_f")) & (F.col("price") <= F.col("hi_f"))
    agg = j.groupBy("room_type", "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col("price"))).alias("lower_whisker"),
        F.max(F.when(inside, F.col("price"))).alias("upper_whisker"),
        F.count(F.when(~inside, F.lit(1))).alias("outliers"),
        F.count(F.lit(1)).alias("listings"))
    return agg.select("room_type", *[rnd(c).alias(c) for c in
                                     ("q1", "median", "q3", "lower_whisker", "upper_whisker")],
                      "outliers", "listings")


def box_outliers(df: DataFrame) -> DataFrame:
    """The outlier points of :func:`box_by_room` (row level, distributed)."""
    data = df.where(F.col("room_type").isNotNull() & F.col("price").isNotNull())
    q = quantile_frame(data, "price", [0.25, 0.75], ["q1", "q3"], by=["room_type"])
    j = data.join(F.broadcast(q), "room_type")
    iqr = F.col("q3") - F.col("q1")
    out = j.where((F.col("price") < F.col("q1") - 1.5 * iqr) | (F.col("price") > F.col("q3") + 1.5 * iqr))
    return out.select("room_type", "id", "price")


def monthly_price_by_room(df: DataFrame) -> DataFrame:
    """Mean price per (month end, room type); absent pairs stay absent."""
    return (df.where(F.col("last_review").isNotNull() & F.col("room_type").isNotNull())
            .groupBy(F.last_day("last_review").alias("month"), "room_type")
            .agg(rnd(exact_avg("price")).alias("avg_price")))


def price_by_proximity(df: DataFrame) -> DataFrame:
    return grouped_summary(
        df, "beach_proximity",
        [("mean_price", _avg("price")), ("listings", F.count("price"))],
        labels=fixed.BEACH_PROXIMITY_LABELS, medians=[("median_price", "price")],
        counts=["listings"])


def count_by_proximity(df: DataFrame) -> DataFrame:
    out = grouped_summary(df, "beach_proximity", [("listings", F.count(F.lit(1)))],
                          labels=fixed.BEACH_PROXIMITY_LABELS, counts=["listings"])
    return sorted_small(out, F.desc("listings"))


# --- E10-E14 geography -------------------------------------------------------------------

def map_centre(df: DataFrame) -> DataFrame:
    return df.agg(rnd(exact_avg("latitude")).alias("centre_lat"),
                  rnd(exact_avg("longitude")).alias("centre_lon"))


MAP_COLOURS = ("price_category", "room_type", "occupancy_rate")
MAP_SIZES = ("price", "number_of_reviews", "estimated_revenue")


def map_points(df: DataFrame, colour: str = "price_category", size: str = "price",
               key: str = "id") -> DataFrame:
    """Point layer: position, name, colour and size columns, and hover columns
    (occupancy when coloured by occupancy, else the review count)."""
    if colour not in MAP_COLOURS or size not in MAP_SIZES:
        raise ValueError(f"colour in {MAP_COLOURS}, size in {MAP_SIZES}")
    hover = ["name", "price", "room_type",
             "occupancy_rate" if colour == "occupancy_rate" else "number_of_reviews"]
    cols = [key, "latitude", "longitude"]
    for c in [colour, size, *hover]:
        if c not in cols:
            cols.append(c)
    return df.select(*cols)


def map_density(df: DataFrame, cell_deg: float = 0.01) -> DataFrame:
    """Listings and mean price per grid cell of ``cell_deg`` degrees: the density
    view of the map at any scale (one row per occupied cell)."""
    d = df.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    cell_lat = F.floor(F.col("latitude") / F.lit(float(cell_deg))).cast("long")
    cell_lon = F.floor(F.col("longitude") / F.lit(float(cell_deg))).cast("long")
    return (d.groupBy(cell_lat.alias("cell_lat"), cell_lon.alias("cell_lon"))
            .agg(F.count(F.lit(1)).alias("listings"), rnd(exact_avg("price")).alias("avg_price")))


def top_neighbourhoods(df: DataFrame, k: int = 10) -> DataFrame:
    return (df.where(F.col("neighbourhood").isNotNull()).groupBy("neighbourhood")
            .agg(F.count(F.lit(1)).alias("listings"))
            .orderBy(F.desc("listings"), F.asc("neighbourhood")).limit(k))


def priciest_neighbourhoods(df: DataFrame, k: int = 10) -> DataFrame:
    return (df.where(F.col("neighbourhood").isNotNull()).groupBy("neighbourhood")
            .agg(exact_avg("price").alias("avg_price"))
            .orderBy(F.desc_nulls_last("avg_price"), F.asc("neighbourhood")).limit(k)
            .select("neighbourhood", rnd("avg_price").alias("avg_price")))


def review_activity(df: DataFrame, k: int = 15) -> DataFrame:
    agg = (df.where(F.col("neighbourhood").isNotNull()).groupBy("neighbourhood")
           .agg(exact_avg("number_of_reviews").alias("avg_reviews"),
                F.sum("number_of_reviews").alias("total_reviews"),
                F.count("number_of_reviews").alias("listings"),
                exact_avg("reviews_per_month").alias("reviews_per_month")))
    return (agg.orderBy(F.desc("total_reviews"), F.asc("neighbourhood")).limit(k)
            .select("neighbourhood", rnd("avg_reviews", 2).alias("avg_reviews"),
                    "total_reviews", "listings",
                    rnd("reviews_per_month", 2).alias("reviews_per_month")))


def room_mix(df: DataFrame, k: int = 10) -> DataFrame:
    """Room-type shares inside the ``k`` most listed neighbourhoods, zeros kept, in long
    form ``(neighbourhood, room_type, listings, pct)``.  Listings without a room type
    count for the choice of neighbourhoods, not for the shares."""
    sub = keep_top_k(df, "neighbourhood", k).where(F.col("room_type").isNotNull())
    counts = sub.groupBy("neighbourhood", "room_type").agg(F.count(F.lit(1)).alias("n"))
    # the grid is the result's own size: at most k rows against the room types
    grid = counts.select("room_type").distinct().crossJoin(
        F.broadcast(counts.select("neighbourhood").distinct()))
    long = grid.join(counts, ["neighbourhood", "room_type"], "left").withColumn(
        "listings", F.coalesce("n", F.lit(0)).cast("long"))
    total = F.sum("listings").over(Window.partitionBy("neighbourhood"))
    return long.select("neighbourhood", "room_type", "listings",
                       rnd(F.col("listings") * F.lit(100.0) / total, 2).alias("pct"))


# --- E15-E16 market ------------------------------------------------------------------------

def revenue_by_room(df: DataFrame) -> DataFrame:
    return grouped_summary(
        df, "room_type",
        [("avg_revenue", _avg("estimated_revenue")), ("avg_occupancy", _avg("occupancy_rate")),
         ("avg_price", _avg("price"))], digits=DIGITS)


def host_portfolio(df: DataFrame) -> DataFrame:
    """By host category: mean price, revenue, occupancy and the *listing* count."""
    return grouped_summary(
        df, "host_category",
        [("avg_price", _avg("price")), ("avg_revenue", _avg("estimated_revenue")),
         ("avg_occupancy", _avg("occupancy_rate")), ("listings", F.count("host_id"))],
        labels=fixed.HOST_CATEGORY_LABELS, counts=["listings"], digits=DIGITS)


# --- E17, E20 correlation ------------------------------------------------------------------

def correlations(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson r of every pair i <= j of columns over pairwise-complete rows, unrounded:
    ``(x, y, r)``; null for constants or fewer than two rows.

    One scan without copies of rows: rows are grouped by which of their columns are
    null (a bit mask: the patterns that occur, mostly one), and each pattern's
    sums of values and of products of two values are taken once for all pairs.  A pair's
    sums are those of the patterns that have both.  Values are taken from a typical
    row's, so that large offsets do not cancel.
    """
    spark = df.sparkSession
    cols = [c for c in cols if c in df.columns]
    if not cols:
        return spark.createDataFrame([], "x string, y string, r double")
    values = df.select(*[nan_to_null(F.col(c).cast("double")).alias(f"v{i}")
                         for i, c in enumerate(cols)])
    first = values.first()
    n = len(cols)
    shifted = [F.coalesce(F.col(f"v{i}") - F.lit(float((first and first[i]) or 0.0)), F.lit(0.0))
               for i in range(n)]
    missing = sum((F.when(F.col(f"v{i}").isNull(), 1 << i).otherwise(0) for i in range(n)), F.lit(0))
    pairs = [(i, j) for i in range(n) for j in range(i, n)]
    rows = (values.select(missing.alias("missing"), *[c.alias(f"d{i}") for i, c in enumerate(shifted)])
            .groupBy("missing").agg(
                F.count(F.lit(1)).alias("n"), *[F.sum(f"d{i}").alias(f"s{i}") for i in range(n)],
                *[F.sum(F.col(f"d{i}") * F.col(f"d{j}")).alias(f"p{i}_{j}") for i, j in pairs])
            .collect())                                     # at most 2**columns rows
    out = []
    for i, j in pairs:
        both = [r for r in rows if not r["missing"] >> i & 1 and not r["missing"] >> j & 1]
        count, sx, sy, sxx, syy, sxy = (math.fsum(r[c] for r in both) for c in (
            "n", f"s{i}", f"s{j}", f"p{i}_{i}", f"p{j}_{j}", f"p{i}_{j}"))
        r = None
        if count >= 2:
            vx, vy = sxx - sx * sx / count, syy - sy * sy / count
            # what is left of a constant column is rounding
            if vx > 1e-14 * sxx and vy > 1e-14 * syy:
                r = (sxy - sx * sy / count) / math.sqrt(vx * vy)
        out.append((cols[i], cols[j], r))
    return spark.createDataFrame(out, "x string, y string, r double")


def corr_matrix(df: DataFrame, cols: Sequence[str] = tuple(fixed.CORRELATION_FEATURES)) -> DataFrame:
    """Pearson matrix in long form ``(feature_x, feature_y, r)`` (:func:`correlations`)."""
    both = F.explode(F.array(
        F.struct(F.col("x").alias("feature_x"), F.col("y").alias("feature_y"), F.col("r")),
        F.when(F.col("x") != F.col("y"),   # mirrored cell, off the diagonal only
               F.struct(F.col("y").alias("feature_x"), F.col("x").alias("feature_y"), F.col("r")))))
    return (correlations(df, cols).select(both.alias("m")).where(F.col("m").isNotNull())
            .select("m.feature_x", "m.feature_y", rnd("m.r").alias("r")))


# --- E18-E22 insights on the IQR-cleaned table ----------------------------------------------

def price_by_occupancy(clean_iqr: DataFrame) -> DataFrame:
    d = clean_iqr.withColumn("occupancy_band", cut("occupancy_rate", fixed.OCCUPANCY_BAND_EDGES,
                                                   fixed.OCCUPANCY_BAND_LABELS))
    return grouped_summary(
        d, "occupancy_band", [("mean_price", _avg("price")), ("listings", F.count("price"))],
        labels=fixed.OCCUPANCY_BAND_LABELS, medians=[("median_price", "price")],
        counts=["listings"])


def reviews_by_price_range(review_df: DataFrame) -> DataFrame:
    d = review_df.withColumn("price_range", cut("price", fixed.PRICE_RANGE_EDGES,
                                                fixed.PRICE_RANGE_LABELS))
    return grouped_summary(
        d, "price_range",
        [("avg_reviews", _avg("number_of_reviews")),
         ("avg_reviews_per_month", _avg("reviews_per_month")),
         ("avg_occupancy", _avg("occupancy_rate"))],
        labels=fixed.PRICE_RANGE_LABELS)


def price_review_corr(review_df: DataFrame) -> DataFrame:
    return review_df.agg(rnd(safe_corr("price", "number_of_reviews")).alias("r_price_reviews"),
                         rnd(safe_corr("price", "reviews_per_month")).alias("r_price_reviews_per_month"))


def argmax_label(summary: DataFrame, key: str, value: str, labels: Sequence[str]) -> Column:
    """The label with the largest ``value``; ties go to the lower category rank."""
    rank = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col(key))
    return F.max_by(F.col(key), F.when(F.col(value).isNotNull(),
                                        F.struct(F.col(value), -rank)))


def sweet_spot(review_metrics: DataFrame) -> DataFrame:
    return review_metrics.agg(
        argmax_label(review_metrics, "price_range", "avg_reviews", fixed.PRICE_RANGE_LABELS)
        .alias("sweet_spot"))


def experience_performance(df: DataFrame) -> DataFrame:
    out = grouped_summary(
        df, "host_experience",
        [("avg_occupancy", _avg("occupancy_rate")), ("avg_price", _avg("price")),
         ("avg_revenue", _avg("estimated_revenue")), ("listings", F.count("number_of_reviews"))],
        labels=fixed.HOST_EXPERIENCE_LABELS, counts=["listings"])
    # the chart scales the already rounded mean
    return out.withColumn("occupancy_pct", rnd(F.col("avg_occupancy") * 100, 2))


# --- E23-E28 stays and guest segments ---------------------------------------------------------

def min_nights_hist(df: DataFrame) -> DataFrame:
    return (df.where(F.col("minimum_nights").isNotNull()).groupBy("minimum_nights")
            .agg(F.count(F.lit(1)).alias("listings")).orderBy("minimum_nights"))


def _with_nights(df: DataFrame) -> DataFrame:
    return df.withColumn("nights_category", cut("minimum_nights", fixed.MIN_NIGHTS_EDGES,
                                                fixed.MIN_NIGHTS_LABELS))


def min_nights_dist(df: DataFrame) -> DataFrame:
    return grouped_summary(_with_nights(df), "nights_category",
                           [("listings", F.count(F.lit(1)))],
                           labels=fixed.MIN_NIGHTS_LABELS, counts=["listings"])


def price_by_min_nights(df: DataFrame) -> DataFrame:
    return grouped_summary(
        _with_nights(df), "nights_category",
        [("mean_price", _avg("price")), ("listings", F.count("price")),
         ("avg_occupancy", _avg("occupancy_rate")), ("avg_revenue", _avg("estimated_revenue"))],
        labels=fixed.MIN_NIGHTS_LABELS, medians=[("median_price", "price")], counts=["listings"])


def guest_segments(df: DataFrame) -> DataFrame:
    d = df.withColumn("guest_type", cut("minimum_nights", fixed.GUEST_TYPE_EDGES,
                                        fixed.GUEST_TYPE_LABELS))
    return grouped_summary(
        d, "guest_type",
        [("avg_price", _avg("price")), ("avg_revenue", _avg("estimated_revenue")),
         ("avg_occupancy", _avg("occupancy_rate")), ("avg_reviews", _avg("number_of_reviews")),
         ("listings", F.count("id"))],
        labels=fixed.GUEST_TYPE_LABELS, counts=["listings"])


def segment_display(segments: DataFrame) -> DataFrame:
    """Display strings: ``$x.xx`` (no separator), ``$x,xxx`` and ``x.x%``."""
    return segments.select(
        "guest_type",
        F.when(F.col("avg_price").isNotNull(),
               F.concat(F.lit("$"), F.format_string("%.2f", F.col("avg_price")))).alias("avg_price"),
        F.when(F.col("avg_revenue").isNotNull(),
               F.concat(F.lit("$"), F.format_number(round2("avg_revenue", 0), 0))).alias("avg_revenue"),
        F.when(F.col("avg_occupancy").isNotNull(),
               F.concat(F.format_string("%.1f", round2(F.col("avg_occupancy") * 100, 1)),
                        F.lit("%"))).alias("avg_occupancy"),
        "listings")


def segment_winners(segments: DataFrame) -> DataFrame:
    labels = fixed.GUEST_TYPE_LABELS
    return segments.agg(
        argmax_label(segments, "guest_type", "avg_revenue", labels).alias("highest_revenue"),
        argmax_label(segments, "guest_type", "avg_occupancy", labels).alias("best_occupancy"),
        argmax_label(segments, "guest_type", "listings", labels).alias("largest_market"))


def market_share(segments: DataFrame) -> DataFrame:
    total = F.sum("listings").over(Window.partitionBy())  # over <= 5 segment rows
    return segments.select("guest_type",
                           rnd(F.try_divide(F.col("listings") * F.lit(100.0), total), 1)
                           .alias("share_pct"))


# --- E29-E31 explorer -------------------------------------------------------------------------

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
                 T.DoubleType, T.DecimalType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC_TYPES)]


def describe_numeric(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """count, mean, std, min, 25/50/75% (linear), max per numeric column, long form.

    Two passes: one aggregate over the columns side by side gives the moments (whole
    numbers are summed exactly, whatever their size) and the quantile summaries; the
    quantiles' counting pass unpivots the columns to ``(column, v)``.
    """
    spark = df.sparkSession
    cols = list(cols) if cols is not None else numeric_columns(df)
    ddl = ("column string, count long, mean double, std double, min double, max double, "
           "_g array<double>")
    aggs = []
    for i, c in enumerate(cols):
        v = nan_to_null(F.col(c).cast("double"))
        whole = isinstance(df.schema[c].dataType, T.IntegralType)
        mean = (F.try_divide(F.sum(F.col(c).cast("decimal(20,0)")).cast("double"), F.count(v))
                if whole else F.avg(v))
        aggs += [F.count(v).alias(f"n{i}"), mean.alias(f"mean{i}"),
                 F.stddev_samp(v).alias(f"std{i}"), F.min(v).alias(f"mn{i}"),
                 F.max(v).alias(f"mx{i}"), summary(v).alias(f"g{i}")]
    one = df.agg(*aggs).collect()[0] if cols else {}
    found = spark.createDataFrame([
        (c, *[one[f"{s}{i}"] for s in ("n", "mean", "std", "mn", "mx", "g")])
        for i, c in enumerate(cols)], ddl)
    stacked = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in cols
    ])).alias("s")).select("s.column", "s.v") if cols else spark.createDataFrame(
        [], "column string, v double")
    q = quantile_frame(stacked, "v", [0.25, 0.5, 0.75], ["p25", "p50", "p75"], ["column"],
                       taken=found.select("column", F.col("count").alias("_n"), "_g"))
    return found.join(q, "column", "left").select(
        "column", "count", *[rnd(c, 2).alias(c) for c in
                             ("mean", "std", "min", "p25", "p50", "p75", "max")])


def categorical_top5(df: DataFrame, cols: Sequence[str] = tuple(fixed.CATEGORICAL_SUMMARY_COLUMNS),
                     k: int = 5) -> DataFrame:
    """Top ``k`` values per column with count and % of *all* rows (nulls in the
    denominator).  Ordered categories list their empty labels too.

    One scan: all columns' values, and the rows, are counted as grouping sets (combined in
    the tasks); every task then keeps a column's first ``k`` before they meet, so a column
    of very many values never sits in one task.  ``k`` rows a column reach the driver.
    """
    spark = df.sparkSession
    ddl = "column string, value string, listings long, total long, position int"
    ordered = {"host_category": fixed.HOST_CATEGORY_LABELS,
               "price_category": fixed.PRICE_CATEGORY_LABELS}
    cols = [c for c in cols if c in df.columns]
    found: dict[str, list[tuple[int, str]]] = {c: [] for c in cols}
    total = 0
    if cols:
        every = (1 << len(cols)) - 1                 # grouping_id of the set without columns
        one_set = {every & ~(1 << (len(cols) - 1 - i)): c for i, c in enumerate(cols)}
        value, place = F.lit(None).cast("string"), F.lit(None).cast("int")
        for number, c in one_set.items():
            value = F.when(F.col("set") == number, F.col(c)).otherwise(value)
            for i, label in enumerate(ordered.get(c, ())):
                place = F.when((F.col("set") == number) & (F.col(c) == label), i).otherwise(place)
            if c in ordered:      # other values than the labels stand last
                place = F.when((F.col("set") == number) & place.isNull(), len(ordered[c])).otherwise(place)
        counts = (df.select(*[F.col(c).cast("string").alias(c) for c in cols])
                  .groupingSets([[F.col(c)] for c in cols] + [[]], *[F.col(c) for c in cols])
                  .agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("set"))
                  .select("set", "n", value.alias("value"), place.alias("place"))
                  .where(F.col("value").isNotNull() | (F.col("set") == every)))
        first = Window.partitionBy("set").orderBy(F.desc("n"), F.asc_nulls_last("place"), F.asc("value"))
        rows = (counts.withColumn("position", F.row_number().over(first))
                .where(F.col("position") <= k).collect())
        total = sum(r["n"] for r in rows if r["set"] == every)
        for r in sorted((r for r in rows if r["set"] != every), key=lambda r: r["position"]):
            found[one_set[r["set"]]].append((r["n"], r["value"]))
    out = []
    for c, mine in found.items():
        labels = ordered.get(c)
        if labels:
            mine = [m for m in mine if m[1] in labels]
            mine += [(0, label) for label in labels if label not in {v for _, v in mine}]
        out += [(c, v, n, total, i) for i, (n, v) in enumerate(mine[:k], 1)]
    return spark.createDataFrame(out, ddl).select(
        "column", "value", "listings",
        rnd(F.try_divide(F.col("listings") * F.lit(100.0), F.col("total")), 2).alias("pct"), "position")


def explorer_kpis(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("listings"), rnd(exact_avg("price"), 2).alias("avg_price"),
                  rnd(exact_sum("estimated_revenue"), 2).alias("total_revenue"))


# --- E32-E35 advanced ---------------------------------------------------------------------------

def monthly_metrics(df: DataFrame) -> DataFrame:
    """Per month end: mean price, listing count, mean availability; every month
    between the first and the last present, gaps with count 0 and null means."""
    ts = df.where(F.col("last_review").isNotNull())
    agg = ts.groupBy(F.last_day("last_review").alias("month")).agg(
        exact_avg("price").alias("avg_price"), F.count("number_of_reviews").alias("listings"),
        exact_avg("availability_365").alias("avg_availability"))
    span = agg.agg(F.min("month").alias("lo"), F.max("month").alias("hi"))
    months = span.select(F.explode(F.sequence(F.trunc("lo", "month"), F.trunc("hi", "month"),
                                              F.expr("INTERVAL 1 MONTH"))).alias("m")) \
        .select(F.last_day("m").alias("month"))
    # one row per calendar month on each side; no hint - the planner (and AQE at
    # run time) broadcasts only after checking the measured size
    out = months.join(agg, "month", "left")
    return out.select("month", rnd("avg_price").alias("avg_price"),
                      F.coalesce("listings", F.lit(0)).cast("long").alias("listings"),
                      rnd("avg_availability").alias("avg_availability")).transform(
        lambda d: sorted_small(d, "month"))


def price_ranges_by_room(df: DataFrame) -> DataFrame:
    data = df.where(F.col("room_type").isNotNull())
    q = quantile_frame(data, "price", [0.25, 0.5, 0.75], ["p25", "p50", "p75"], by=["room_type"])
    return q.select("room_type", rnd("p25").alias("p25"), rnd("p50").alias("p50"),
                    rnd("p75").alias("p75"), rnd(F.col("p25") * 0.9).alias("lower_fence"),
                    rnd(F.col("p75") * 1.1).alias("upper_fence"))


def competition_top10(df: DataFrame, k: int = 10) -> DataFrame:
    """Competition score from the *rounded* neighbourhood aggregates; groups with
    one listing have no std and a null score, sorted last."""
    w_list, w_std, w_occ = fixed.COMPETITION_WEIGHTS
    agg = (df.where(F.col("neighbourhood").isNotNull()).groupBy("neighbourhood")
           .agg(rnd(exact_avg("price"), 2).alias("avg_price"),
                rnd(F.stddev_samp("price"), 2).alias("price_std"),
                F.count("price").alias("listings"),
                rnd(exact_avg("occupancy_rate"), 2).alias("avg_occupancy"),
                rnd(exact_avg("number_of_reviews"), 2).alias("avg_reviews")))
    score = (F.col("listings") * F.lit(w_list)
             + F.lit(1.0) / (F.col("price_std") + F.lit(1.0)) * F.lit(100.0) * F.lit(w_std)
             + F.col("avg_occupancy") * F.lit(100.0) * F.lit(w_occ))
    return (agg.withColumn("competition_score", rnd(score, 2))
            .orderBy(F.desc_nulls_last("competition_score"), F.asc("neighbourhood")).limit(k))


def with_efficiency(df: DataFrame) -> DataFrame:
    return df.withColumn("revenue_efficiency",
                         F.try_divide(F.col("estimated_revenue"), F.col("price")))


def top_efficiency(df: DataFrame, k: int = 20) -> DataFrame:
    return (with_efficiency(df).orderBy(F.desc_nulls_last("revenue_efficiency"), F.asc("id"))
            .limit(k).select("id", "name", rnd("price", 2).alias("price"),
                             rnd("occupancy_rate", 2).alias("occupancy_rate"),
                             rnd("revenue_efficiency", 2).alias("revenue_efficiency")))


# --- E36-E39 export page --------------------------------------------------------------------------

def filter_summary(baseline: DataFrame, kept: Column, spec, band) -> DataFrame:
    """Label/value rows describing the active filters and the kept share (one scan)."""
    counts = baseline.agg(F.count(F.when(kept, 1)).alias("f"), F.count(F.lit(1)).alias("b"))
    lo, hi = band if band is not None else (None, None)
    price_txt = (f"${lo:.0f} - ${hi:.0f}" if lo is not None else "")
    rows = [
        _row(1, "Total Listings", F.concat(F.format_number(F.col("f"), 0), F.lit(" / "),
                                           F.format_number(F.col("b"), 0))),
        _row(2, "Neighborhood Group", F.lit(spec.neighbourhood_group)),
        _row(3, "Room Type", F.lit(spec.room_type)),
        _row(4, "Price Range", F.lit(price_txt)),
        _row(5, "Min Reviews", F.lit(str(spec.min_reviews))),
        _row(6, "Availability Range", F.lit(f"({spec.availability[0]}, {spec.availability[1]})")),
    ]
    return counts.select(F.inline(F.array(*rows)))


def _row(pos: int, label: str, value: Column, name: str = "label") -> Column:
    return F.struct(F.lit(pos).alias("position"), F.lit(label).alias(name),
                    value.cast("string").alias("value"))


def export_summary(df: DataFrame, generated_at: str) -> DataFrame:
    """Metric/value rows of the summary sheet; the time stamp is passed in."""
    a = df.agg(F.count(F.lit(1)).alias("n"), exact_avg("price").alias("p"),
               exact_sum("estimated_revenue").alias("rev"), exact_avg("occupancy_rate").alias("occ"))
    money = F.concat(F.lit("$"), F.format_string("%.2f", round2("p", 2)))
    rows = [
        _row(1, "Total Listings", F.col("n"), "metric"),
        _row(2, "Average Price", money, "metric"),
        _row(3, "Total Revenue", F.concat(F.lit("$"), F.format_number(round2("rev", 0), 0)), "metric"),
        _row(4, "Average Occupancy",
             F.concat(F.format_string("%.1f", round2(F.col("occ") * 100, 1)), F.lit("%")), "metric"),
        _row(5, "Date Generated", F.lit(generated_at), "metric"),
    ]
    return a.select(F.inline(F.array(*rows)))


def export_stats(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows"), F.lit(len(df.columns)).alias("columns"),
                  F.min("last_review").alias("first_review"),
                  F.max("last_review").alias("last_review"))


def column_profile(df: DataFrame) -> DataFrame:
    """Per column: type, non-null count and null % (2 decimals); one aggregate."""
    fields = df.schema.fields
    row = df.agg(F.count(F.lit(1)).alias("_n"),
                 *[F.count(F.col(f.name)).alias(f"c{i}") for i, f in enumerate(fields)])
    items = [F.struct(F.lit(i + 1).alias("position"), F.lit(f.name).alias("column"),
                      F.lit(f.dataType.simpleString()).alias("type"),
                      F.col(f"c{i}").alias("non_null")) for i, f in enumerate(fields)]
    return row.select("_n", F.inline(F.array(*items))).select(
        "position", "column", "type", "non_null",
        rnd(F.try_divide((F.col("_n") - F.col("non_null")) * F.lit(100.0), F.col("_n")), 2)
        .alias("null_pct"))


def preview(df: DataFrame, n: int = 10, order_by: str = "id") -> DataFrame:
    """First ``n`` rows in a deterministic order."""
    return df.orderBy(order_by).limit(n)
