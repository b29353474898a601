"""Statistics: histogram, Gaussian KDE, linear and local trends, stable samples.

All work is aggregations over the whole table; only scalars (min, max, n, std), sums by
cell of a fixed grid and values at grid points reach the driver.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staylens.functions import fixed
from staylens.functions.expressions import round2, safe_corr, sorted_small
from staylens.operators.moments import Cells, gaussian_sums, matrix, power_sums, tricube_sums
from staylens.operators.quantiles import bracketed_values, exact_quantiles

DIGITS = 6
#: Cells of the x axis of a local trend.
CELLS = 1024


def _scalars(df: DataFrame, col: str) -> dict:
    r = df.agg(F.count(col).alias("n"), F.min(col).alias("mn"), F.max(col).alias("mx"),
               F.stddev_samp(col).alias("sd")).collect()[0]
    return r.asDict()


def price_histogram(df: DataFrame, col: str = "price", bins: int = fixed.HISTOGRAM_BINS) -> DataFrame:
    """Equal-width bins over [min, max]; the maximum falls in the last bin; empty
    bins are listed with count 0.  Output ``(bin, lo, hi, listings)``."""
    spark = df.sparkSession
    s = _scalars(df, col)
    if not s["n"]:
        return spark.createDataFrame([], "bin int, lo double, hi double, listings long")
    mn, mx = float(s["mn"]), float(s["mx"])
    width = (mx - mn) / bins
    x = F.col(col)
    if mx > mn:
        b = F.least(F.floor((x - F.lit(mn)) / F.lit(mx - mn) * F.lit(float(bins))) + 1,
                    F.lit(bins)).cast("int")
    else:
        b = F.lit(1)
    counts = df.where(x.isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("listings"))
    dim = spark.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    out = dim.join(F.broadcast(counts), "bin", "left")  # at most `bins` rows
    return sorted_small(out.select(
        "bin",
        round2(F.lit(mn) + (F.col("bin") - 1) * F.lit(width), DIGITS).alias("lo"),
        round2(F.lit(mn) + F.col("bin") * F.lit(width), DIGITS).alias("hi"),
        F.coalesce("listings", F.lit(0)).cast("long").alias("listings")), "bin")


def price_kde(df: DataFrame, col: str = "price", points: int = fixed.KDE_GRID_POINTS,
              bins: int = fixed.HISTOGRAM_BINS) -> DataFrame:
    """Gaussian KDE (Scott bandwidth ``std * n**-0.2``) on ``points`` evenly
    spaced values from min to max, scaled to histogram counts by
    ``n * (max - min) / bins``.  One pass adds up the powers of each value's place in its
    cell of the line, whatever the number of points (:func:`gaussian_sums`); zero
    variance or fewer than two values give an empty result."""
    spark = df.sparkSession
    ddl = "point int, x double, density double"
    s = _scalars(df, col)
    n, sd = s["n"], s["sd"]
    if not n or n < 2 or sd is None or sd == 0 or math.isnan(sd):
        return spark.createDataFrame([], ddl)
    mn, mx = float(s["mn"]), float(s["mx"])
    h = float(sd) * n ** (-0.2)
    step = (mx - mn) / (points - 1)
    grid = [mn + i * step for i in range(points - 1)] + [mx]
    scale = 1.0 / (n * h * math.sqrt(2 * math.pi)) * n * (mx - mn) / bins
    sums = gaussian_sums(df, F.col(col), grid, mn, mx, h)
    rows = [(i, g, float(k) * scale) for i, (g, k) in enumerate(zip(grid, sums))]
    return spark.createDataFrame(rows, ddl).select(
        "point", round2("x", DIGITS).alias("x"), round2("density", DIGITS).alias("density"))


def availability_trend(df: DataFrame, x: str = "availability_365", y: str = "price",
                       min_rows: int = 30) -> DataFrame:
    """Least-squares line ``y ~ x`` over all rows (needs more than ``min_rows``):
    slope, intercept, r and the line at x = 0 and x = 365."""
    xs, ys = F.col(x).cast("double"), F.col(y).cast("double")
    agg = df.agg(F.count(F.when(xs.isNotNull() & ys.isNotNull(), 1)).alias("n"),
                 F.regr_slope(ys, xs).alias("slope"), F.regr_intercept(ys, xs).alias("intercept"),
                 safe_corr(xs, ys).alias("r"))
    return agg.where(F.col("n") > min_rows).select(
        "n", round2("slope", DIGITS).alias("slope"), round2("intercept", DIGITS).alias("intercept"),
        round2("r", DIGITS).alias("r"), round2("intercept", DIGITS).alias("y_at_0"),
        round2(F.col("slope") * 365 + F.col("intercept"), DIGITS).alias("y_at_365"))


def local_trend(df: DataFrame, x: str = "price", y: str = "number_of_reviews",
                frac: float = 0.3, points: int = 50, min_rows: int = 30,
                iterations: int = 3) -> DataFrame:
    """Locally weighted linear regression (LOWESS) evaluated on ``points`` evenly
    spaced x values, with ``iterations`` robustifying rounds.

    * span radius per grid point: distance to its ``int(frac * n)``-th nearest x
      (:func:`knn_radius`);
    * fit: the tricube weight is a polynomial on either side of a grid point, so cells of
      the x axis that a span covers wholly enter by their power sums, whatever their
      number of rows; only rows of the three cells that hold a grid point or an end of
      its span meet that point itself.  One pass a round, one sum per cell and power;
    * robust rounds: residuals at every row against the current fit (linear
      interpolation between grid points), their exact median absolute value, bisquare
      weights ``(1 - (r / 6 mad)^2)^2`` multiplied into the sums, then refit.

    Only sums by cell (``CELLS`` rows) and by point reach the driver.
    """
    spark = df.sparkSession
    ddl = "point int, x double, fitted double"
    data = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")) \
        .where(F.col("x").isNotNull() & F.col("y").isNotNull())
    s = _scalars(data, "x")
    n = s["n"]
    if not n or n <= min_rows:
        return spark.createDataFrame([], ddl)
    mn, mx = float(s["mn"]), float(s["mx"])
    step = (mx - mn) / (points - 1) if points > 1 else 0.0
    grid = [mn + i * step for i in range(points - 1)] + [mx]
    k = max(1, int(frac * n + 1e-10))
    cells = Cells.over(mn, mx, CELLS)
    rad = knn_radius(data, "x", grid, k, cells)
    spans = [(g, float(rad.get(i, 0.0))) for i, g in enumerate(grid)]
    fitted = _local_fit(data.withColumn("resid", F.lit(0.0)), cells, spans, 1.0)
    for _ in range(iterations):
        if any(v is None for v in fitted) or step <= 0:
            break
        rest = _residuals(data, mn, step, fitted)
        mad = exact_quantiles(rest.select(F.abs("resid").alias("r")), "r", [0.5],
                              rows=n).get((), [None])[0]
        if not mad:
            break
        fitted = _local_fit(rest, cells, spans, 6.0 * mad)
    rows = [(i, g, v) for i, (g, v) in enumerate(zip(grid, fitted))]
    return spark.createDataFrame(rows, ddl).select(
        "point", round2("x", DIGITS).alias("x"), round2("fitted", DIGITS).alias("fitted"))


def _beside(data: DataFrame, by_cell: dict[int, list[tuple]], fields: str) -> DataFrame:
    """``data`` (with a ``cell`` column) beside the array ``at`` of the structs that
    ``by_cell`` has for its cell, null where it has none.  The table holds a few structs
    for each grid point."""
    table = data.sparkSession.createDataFrame(sorted(by_cell.items()),
                                              f"cell int, at array<struct<{fields}>>")
    return data.join(F.broadcast(table), "cell", "left")


def _local_fit(data: DataFrame, cells: Cells, spans: list[tuple[float, float]],
               scale: float) -> list[float | None]:
    """Fitted values at the points, rows weighted by the bisquare of ``resid / scale`` and
    their span's tricube."""
    edges = [{cells.number_of(v) for v in (g - r, g, g + r)} for g, r in spans]
    near: dict[int, list[tuple]] = {}
    for i, ((g, r), own) in enumerate(zip(spans, edges)):
        for cell in own:
            near.setdefault(cell, []).append((i, g, r))
    v = F.col("resid") / F.lit(float(scale))
    robust = F.when(F.abs(v) < 1, (F.lit(1.0) - v * v) * (F.lit(1.0) - v * v)).otherwise(F.lit(0.0))
    rows = data.select("x", "y", robust.alias("w"), cells.number(F.col("x")).alias("cell"))
    # every row once for its cell's sums, and once for each point whose edge its cell is
    once = F.array(F.struct(F.lit(-1).alias("point"), F.lit(0.0).alias("g"), F.lit(0.0).alias("r")))
    rows = _beside(rows, near, "point: int, g: double, r: double").select(
        "x", "y", "w", "cell", F.explode(F.concat(once, F.coalesce("at", F.array().cast(
            "array<struct<point:int,g:double,r:double>>")))).alias("p"))
    d = F.col("x") - F.col("p.g")
    u = F.when(F.col("p.r") > 0, F.abs(d) / F.col("p.r")).otherwise(F.when(d == 0, 0.0))
    rest = F.lit(1.0) - u * u * u
    tricube = F.when(u < 1, rest * rest * rest).otherwise(F.lit(0.0))
    direct = F.col("p.point") >= 0
    weight = F.when(direct, F.col("w") * tricube).otherwise(F.col("w"))
    place = F.when(direct, d).otherwise(cells.place(F.col("x"), F.col("cell")))
    key = F.when(direct, -1 - F.col("p.point")).otherwise(F.col("cell"))
    sums = (rows.select(key.alias("key"), weight.alias("w"), place.alias("t"),
                        (weight * F.col("y")).alias("wy"))
            .groupBy("key").agg(power_sums(F.col("t"), F.col("w"), 11).alias("m"),
                                power_sums(F.col("t"), F.col("wy"), 10).alias("v")).collect())
    # the key of a point's own sums is below 0; a point's first five sums are those of
    # the weighted line, a cell's are its power sums
    mine = {-1 - r["key"]: np.array(r["m"][:3] + r["v"][:2])
            for r in sums if r["key"] < 0}
    held = sorted((r for r in sums if r["key"] >= 0), key=lambda r: r["key"])
    number = np.array([r["key"] for r in held])
    ones, values = matrix(held, "m", 11), matrix(held, "v", 10)
    out: list[float | None] = []
    for i, ((g, r), own) in enumerate(zip(spans, edges)):
        inside = (number > cells.number_of(g - r)) & (number < cells.number_of(g + r)) \
            & (number != cells.number_of(g))
        total = mine.get(i, np.zeros(5))
        if r > 0 and inside.any():
            total = total + tricube_sums(cells, number[inside], ones[inside], values[inside], g, r)
        sw, sd, sdd, sy, syd = total
        if not sw > 0:
            out.append(None)
            continue
        db, yb = sd / sw, sy / sw
        spread = sdd - sw * db * db
        flat = abs(spread) <= 1e-12 * (sdd + 2 * g * sd + g * g * sw)
        out.append(float(yb - (0.0 if flat else (syd - sd * yb) / spread) * db))
    return out


def knn_radius(data: DataFrame, x: str, grid: list[float], k: int,
               cells: Cells) -> dict[int, float]:
    """Exact distance from each grid value to its ``k``-th nearest ``x``.

    1. counts, least and greatest values of the cells (``cells.n`` rows reach the driver):
       running sums over them, ordered by distance, bracket each radius in ``[lo, hi]`` and
       count the rows of cells that are nearer for certain;
    2. only rows of the cells that reach into a bracket meet that grid point, and one
       counting pass picks the remaining rank among their distances.
    """
    hist = (data.groupBy(cells.number(F.col(x)).alias("cell"))
            .agg(F.count(F.lit(1)).alias("c"), F.min(x).alias("lo"), F.max(x).alias("hi")).collect())
    number = np.array([r["cell"] for r in hist])
    count = np.array([r["c"] for r in hist], dtype=np.int64)
    low, high = (np.array([float(r[c]) for r in hist]) for c in ("lo", "hi"))
    near: dict[int, list[tuple]] = {}
    ranks = []
    for i, g in enumerate(grid):
        least = np.where((low <= g) & (g <= high), 0.0, np.minimum(np.abs(low - g), np.abs(high - g)))
        most = np.maximum(np.abs(low - g), np.abs(high - g))
        order = np.argsort(most, kind="stable")
        r_hi = most[order][np.searchsorted(np.cumsum(count[order]), k)]
        order = np.argsort(least, kind="stable")
        r_lo = least[order][np.searchsorted(np.cumsum(count[order]), k)]
        ranks.append(k - 1 - int(count[most < r_lo].sum()))
        for cell in number[(most >= r_lo) & (least <= r_hi)].tolist():
            near.setdefault(cell, []).append((i, float(g), float(r_lo), float(r_hi)))
    rows = data.select(F.col(x).alias("x"), cells.number(F.col(x)).alias("cell"))
    dist = (_beside(rows, near, "point: int, g: double, lo: double, hi: double")
            .select("x", F.explode("at").alias("p"))
            .select("p.point", "p.lo", "p.hi", F.abs(F.col("x") - F.col("p.g")).alias("_x")))
    rank = F.get(F.array(*[F.lit(r).cast("long") for r in ranks]), F.col("point"))
    found = bracketed_values(dist, ["point"], ("lo", "hi"), rank)
    return {point: v for (point,), v in found.items()}


def _residuals(data: DataFrame, start: float, step: float, values: list[float]) -> DataFrame:
    """``data`` with ``resid``, y less the curve given on an even grid (linear between its
    points).  The curve is a small table, so that every round runs the same compiled code."""
    last = len(values) - 2
    piece = F.least(F.greatest(F.floor((F.col("x") - F.lit(start)) / F.lit(step)), F.lit(0)),
                    F.lit(last)).cast("int")
    curve = data.sparkSession.createDataFrame(
        [(j, start + j * step, values[j], values[j + 1] - values[j]) for j in range(last + 1)],
        "piece int, g0 double, f0 double, rise double")
    return data.withColumn("piece", piece).join(F.broadcast(curve), "piece").select(
        "x", "y", (F.col("y") - (F.col("f0") + F.col("rise") * (F.col("x") - F.col("g0"))
                                 / F.lit(step))).alias("resid"))


def stable_sample(df: DataFrame, n: int = fixed.SAMPLE_SIZE, seed: int = fixed.SAMPLE_SEED,
                  key: str = "id") -> DataFrame:
    """``n`` rows chosen by a seeded hash of the key: the same rows however the
    table is partitioned (top-k per partition, then a final merge)."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), F.col(key)).limit(n)
