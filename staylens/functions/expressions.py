"""Column expressions (JVM-side, codegen friendly; no Python UDFs)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from staylens.functions import fixed


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _lit(v) -> Column:
    # Python floats become DOUBLE literals (a SQL text ``1.5`` would be DECIMAL).
    return F.lit(float(v)) if isinstance(v, float) else F.lit(v)


def cut(c: str | Column, edges: Sequence, labels: Sequence[str],
        include_lowest: bool = False) -> Column:
    """Right-closed binning ``(e[i], e[i+1]] -> labels[i]``; ``None`` edge = +inf.

    Values at or below the first edge (unless ``include_lowest``), above the last
    finite edge, NaN and null all map to null - the ``pd.cut`` rules.
    """
    x = _col(c)
    expr = None
    for i, label in enumerate(labels):
        lo, hi = edges[i], edges[i + 1]
        cond = (x >= _lit(lo)) if (include_lowest and i == 0) else (x > _lit(lo))
        if hi is not None:
            cond = cond & (x <= _lit(hi))
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr


def label_dimension(spark: SparkSession, labels: Sequence[str],
                    name: str = "label") -> DataFrame:
    """A tiny (rank, label) table carrying the order and the empty categories."""
    schema = T.StructType([T.StructField("rank", T.IntegerType(), False),
                           T.StructField(name, T.StringType(), False)])
    return spark.createDataFrame([(i + 1, lab) for i, lab in enumerate(labels)], schema)


def sorted_small(df: DataFrame, *cols) -> DataFrame:
    """Order an output whose size has a fixed bound (category labels, histogram
    bins, grid points, k clusters, calendar months) in one partition.  The rows move
    there after the aggregate has run in all its partitions; no sampling job."""
    return df.repartition(1).sortWithinPartitions(*cols)


def haversine_km(lat1: str | Column, lon1: str | Column, lat2, lon2) -> Column:
    """Great-circle distance in km (atan2 form), R = 6371."""
    la1, lo1 = _col(lat1), _col(lon1)
    la2 = _col(lat2) if isinstance(lat2, (str, Column)) else F.lit(float(lat2))
    lo2 = _col(lon2) if isinstance(lon2, (str, Column)) else F.lit(float(lon2))
    dlat = F.radians(la2 - la1)
    dlon = F.radians(lo2 - lo1)
    a = (F.pow(F.sin(dlat / 2), 2)
         + F.cos(F.radians(la1)) * F.cos(F.radians(la2)) * F.pow(F.sin(dlon / 2), 2))
    c = F.lit(2.0) * F.atan2(F.sqrt(a), F.sqrt(F.lit(1.0) - a))
    return F.lit(fixed.EARTH_RADIUS_KM) * c


def min_distance_km(lat: str | Column, lon: str | Column,
                    points: Sequence[tuple[float, float]] = tuple(fixed.BEACH_POINTS)) -> Column:
    """Distance to the nearest of a short, fixed list of points.

    Null coordinates give null for every point, so ``least`` is null too.
    """
    dists = [haversine_km(lat, lon, p_lat, p_lon) for p_lat, p_lon in points]
    return dists[0] if len(dists) == 1 else F.least(*dists)


def season(month: str | Column) -> Column:
    """Southern-hemisphere season of a month number; null month -> null."""
    m = _col(month)
    expr = None
    for name, months in fixed.SEASON_BY_MONTHS:
        cond = m.isin(*months)
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return expr


def round2(c: str | Column, digits: int = 2) -> Column:
    """``Series.round``: scale by ``10**digits``, round half-even, scale back.

    Rounding happens on the binary product, as pandas/NumPy do; ``bround(x, d)``
    alone rounds the shortest decimal text instead and differs on near-ties
    (535.6203625 -> .362 vs .363).
    """
    x = _col(c)
    if digits == 0:
        return half_even(x)
    scale = F.lit(float(10 ** digits))
    return half_even(x * scale) / scale


def half_even(x: Column) -> Column:
    """A double to its nearest whole number, ties to the even one: ``bround(x, 0)`` without
    the decimal that Spark makes of every value for it."""
    return F.rint(x) + F.lit(0.0)      # -0.0 becomes 0.0, as there


EXACT_TYPE = T.DecimalType(28, 10)


def exact_avg(c: str | Column) -> Column:
    """Mean from an exact DECIMAL(28,10) sum: the same value whatever the
    partitioning or summation order (a double sum is order dependent in its last
    bits, which decides rounding on exact ties).  Inputs are held to 1e-10."""
    return F.avg(_col(c).cast(EXACT_TYPE)).cast("double")


def exact_sum(c: str | Column) -> Column:
    """Order-independent sum (see :func:`exact_avg`)."""
    return F.sum(_col(c).cast(EXACT_TYPE)).cast("double")


def nan_to_null(c: str | Column) -> Column:
    """Spark keeps NaN apart from null; pandas treats NaN as missing."""
    x = _col(c)
    return F.when(F.isnan(x), F.lit(None).cast("double")).otherwise(x)


def pairwise(a: str | Column, b: str | Column) -> tuple[Column, Column]:
    """Both sides null when either is null (pairwise-complete observations)."""
    x, y = _col(a), _col(b)
    both = x.isNotNull() & y.isNotNull()
    return F.when(both, x), F.when(both, y)


def safe_corr(a: str | Column, b: str | Column) -> Column:
    """Pearson r over pairwise-complete rows; null for constants or < 2 rows.

    ``F.corr`` raises DIVIDE_BY_ZERO under ANSI mode on a constant column, so the
    ratio is built from sample covariance and deviations with ``try_divide``.
    """
    x, y = pairwise(a, b)
    return F.try_divide(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y))
