"""Segmentation: standardisation, PCA, k-means and their summaries.

* Standardisation: means and *population* deviations from one aggregate; a zero
  deviation divides by 1; nulls are filled with 0 first.
* PCA: the k x k covariance of the standardised features comes from one
  aggregate (``covar_pop`` per pair); its eigen-decomposition is a k x k problem
  on the driver.  Scores are linear column expressions (codegen, no UDF).  Signs
  are fixed so that the largest absolute loading of each component is positive.
* K-means: Lloyd steps, one small aggregate each, over features on a grid of whole
  numbers, so that neither partitions nor the order of rows change the result; cluster
  ids are renumbered by ascending mean of the first feature (the price).
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import add

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staylens.functions import fixed
from staylens.functions.expressions import exact_avg, half_even, round2, sorted_small
from staylens.operators.quantiles import order_statistics
from staylens.operators.summaries import corr_matrix, correlations, rnd

FEATURES = tuple(fixed.CLUSTER_FEATURES)
GRID_BITS = 20
KMEANS_MAX_ITER = 300
KMEANS_TOL = 1e-4


def feature_vector(df: DataFrame, features: Sequence[str] = FEATURES, key: str = "id") -> DataFrame:
    """The clustering features as doubles with nulls filled by 0 (the ML input)."""
    return df.select(key, *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f)
                            for f in features])


@dataclass(frozen=True)
class Scaler:
    features: tuple[str, ...]
    means: tuple[float, ...]
    scales: tuple[float, ...]

    def columns(self, prefix: str = "z_"):
        return [((F.coalesce(F.col(f).cast("double"), F.lit(0.0)) - F.lit(m)) / F.lit(s))
                .alias(prefix + f) for f, m, s in zip(self.features, self.means, self.scales)]


def fit_scaler(df: DataFrame, features: Sequence[str] = FEATURES) -> Scaler:
    filled = [F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features]
    aggs = []
    for i, c in enumerate(filled):
        aggs += [F.avg(c).alias(f"m{i}"), F.stddev_pop(c).alias(f"s{i}")]
    r = df.agg(*aggs).collect()[0]
    means = tuple(float(r[f"m{i}"]) if r[f"m{i}"] is not None else 0.0 for i in range(len(features)))
    scales = tuple(float(r[f"s{i}"]) if r[f"s{i}"] else 1.0 for i in range(len(features)))
    return Scaler(tuple(features), means, scales)


def standardised_features(df: DataFrame, features: Sequence[str] = FEATURES,
                          key: str = "id") -> DataFrame:
    sc = fit_scaler(df, features)
    return df.select(key, *[round2(c, DIGITS).alias(f"z_{f}")
                            for c, f in zip(sc.columns(""), features)])


DIGITS = 6


@dataclass(frozen=True)
class PCAResult:
    scaler: Scaler
    components: np.ndarray        # (k, n_features), rows are components
    explained_ratio: np.ndarray   # (k,)

    def scores(self) -> list[Column]:
        z = self.scaler.columns("")
        return [round2(reduce(add, [c * F.lit(float(w)) for w, c in zip(comp, z)]), DIGITS)
                for comp in self.components]


def fit_pca(df: DataFrame, features: Sequence[str] = FEATURES, k: int = 2) -> PCAResult:
    sc = fit_scaler(df, features)
    z = df.select(*sc.columns())
    names = [f"z_{f}" for f in features]
    m = len(names)
    aggs = [F.covar_pop(names[i], names[j]).alias(f"c{i}_{j}") for i in range(m) for j in range(i, m)]
    r = z.agg(*aggs).collect()[0]
    cov = np.zeros((m, m))
    for i in range(m):
        for j in range(i, m):
            v = r[f"c{i}_{j}"]
            cov[i, j] = cov[j, i] = 0.0 if v is None else float(v)
    vals, vecs = np.linalg.eigh(cov)
    order = np.argsort(vals)[::-1]
    vals, vecs = vals[order], vecs[:, order].T
    for row in vecs:
        if row[np.argmax(np.abs(row))] < 0:
            row *= -1
    total = vals.sum()
    ratio = vals / total if total > 0 else np.zeros_like(vals)
    return PCAResult(sc, vecs[:k], ratio[:k])


def pca_scores(df: DataFrame, features: Sequence[str] = FEATURES, key: str = "id",
               model: PCAResult | None = None) -> DataFrame:
    model = model or fit_pca(df, features)
    return df.select(key, *[c.alias(f"pca_{i + 1}") for i, c in enumerate(model.scores())])


def pca_loadings(df: DataFrame, features: Sequence[str] = FEATURES,
                 model: PCAResult | None = None) -> DataFrame:
    model = model or fit_pca(df, features)
    rows = [(f, *[float(round(model.components[c][i], DIGITS)) for c in range(len(model.components))])
            for i, f in enumerate(features)]
    names = ", ".join(f"pc{c + 1} double" for c in range(len(model.components)))
    return df.sparkSession.createDataFrame(rows, f"feature string, {names}")


def pca_variance(df: DataFrame, features: Sequence[str] = FEATURES,
                 model: PCAResult | None = None) -> DataFrame:
    model = model or fit_pca(df, features)
    rows = [(f"PC{i + 1}", float(round(v, DIGITS))) for i, v in enumerate(model.explained_ratio)]
    rows.append(("total", float(round(model.explained_ratio.sum(), DIGITS))))
    return df.sparkSession.createDataFrame(rows, "component string, explained_ratio double")


@dataclass(frozen=True)
class KMeansModel:
    """``steps`` and ``weights`` per feature; ``centres`` in steps; ``ids`` maps the
    place of a centre to its cluster id (none for a centre without rows)."""
    features: tuple[str, ...]
    steps: tuple[float, ...]
    weights: tuple[float, ...]
    centres: tuple[tuple[float, ...], ...]
    ids: tuple[int | None, ...]

    def cluster(self) -> Column:
        place = _nearest(_on_grid(self.features, self.steps), self.centres, self.weights)
        return F.get(F.array(*[F.lit(i).cast("int") for i in self.ids]), place.cast("int"))


def _on_grid(features: Sequence[str], steps: Sequence[float]) -> list[Column]:
    return [half_even(F.coalesce(F.col(f).cast("double"), F.lit(0.0)) / F.lit(s)).cast("long")
            for f, s in zip(features, steps)]


def _nearest(point: Sequence[Column], centres, weights) -> Column:
    """The place of the nearest centre, the first of equally near ones."""
    dists = []
    for centre in centres:
        terms = [(p - F.lit(c)) * (p - F.lit(c)) * F.lit(w)
                 for p, c, w in zip(point, centre, weights)]
        dists.append(reduce(add, terms))
    near = F.array(*dists)
    return F.array_position(near, F.array_min(near)) - 1


def fit_kmeans(df: DataFrame, k: int = fixed.KMEANS_DEFAULT_K,
               features: Sequence[str] = FEATURES, key: str = "id", min_rows: int = 10,
               max_iter: int = KMEANS_MAX_ITER, tol: float = KMEANS_TOL) -> KMeansModel | None:
    """Lloyd's algorithm; ``None`` when there are ``min_rows`` rows or fewer.

    The same for every partitioning: features lie on a grid whose step is a power of
    two near ``2**-GRID_BITS`` deviations, so that the sums of a pass are sums of whole
    numbers.  The first centres are the rows at ``k`` evenly spaced ranks of the first
    feature, the smallest key among equals.  It stops when the squared shifts of the
    centres, in deviations, add up to ``tol`` or less.  A centre that no row is nearest
    to stays where it is.  ``df`` is read twice; the rows' places on the grid, a few whole
    numbers each, are kept by the executors (in memory, else on their disks) for the passes,
    which return at most ``k`` rows each.
    """
    if k < 2:
        raise ValueError("k-means needs at least two clusters")
    filled = [F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features]
    r = df.agg(F.count(F.lit(1)).alias("n"),
               *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(filled)],
               *[F.avg(c).alias(f"m{i}") for i, c in enumerate(filled)]).collect()[0]
    if r["n"] <= min_rows:
        return None
    steps, weights = [], []
    for i in range(len(features)):
        s = r[f"s{i}"]
        power = 2.0 ** math.floor(math.log2(s)) if s else 1.0
        steps.append(power / 2 ** GRID_BITS if s else 1.0)
        weights.append(round(power * power / (s * s), DIGITS) if s else 0.0)
    names = [f"z{i}" for i in range(len(features))]
    z = df.select(key, *[c.alias(n) for c, n in zip(_on_grid(features, steps), names)]).persist()
    try:
        middle = [round(r[f"m{i}"] / s) for i, s in enumerate(steps)]
        centres, ids = _lloyd(z, key, r["n"], middle, weights, k, max_iter, tol)
    finally:
        z.unpersist()
    return KMeansModel(tuple(features), tuple(steps), tuple(weights), tuple(centres), ids)


def _lloyd(z: DataFrame, key: str, n_rows: int, middle: Sequence[int], weights: Sequence[float],
           k: int, max_iter: int, tol: float):
    """The centres, and the cluster id of each, of rows ``z`` on the grid (``z0``, ``z1``, ...).

    Sums are of distances from ``middle``, the columns' means: over n rows these add up to
    2**(GRID_BITS + 1) * n at most, so that the sums are exact as 64-bit numbers.
    """
    names = [f"z{i}" for i in range(len(weights))]
    ranks = [(2 * j + 1) * n_rows // (2 * k) for j in range(k)]
    at = order_statistics(z, names[0], ranks)[()]
    wanted = [int(at[rank]) for rank in ranks]
    starts = {row["z0"]: row["who"] for row in z.where(F.col("z0").isin(sorted(set(wanted))))
              .groupBy("z0").agg(F.min(F.struct(key, *names)).alias("who")).collect()}
    centres = [tuple(float(starts[v][n]) for n in names) for v in wanted]

    cells = [[f"c{j}_{i}" for i in range(len(names))] for j in range(k)]
    place = _nearest([F.col(n) for n in names], [[F.col(c) for c in row] for row in cells], weights)
    sums = [F.sum(F.col(n) - F.lit(m)).alias(n) for n, m in zip(names, middle)]

    def assigned(centres):
        # one row of centres: as literals they would make Spark compile every pass anew
        at = z.sparkSession.createDataFrame(
            [sum(centres, ())], ", ".join(f"{c} double" for row in cells for c in row))
        found = (z.crossJoin(F.broadcast(at)).groupBy(place.cast("int").alias("place"))
                 .agg(F.count(F.lit(1)).alias("n"), *sums).collect())
        return {row["place"]: tuple(float(row[n] + row["n"] * m) / row["n"]
                                    for n, m in zip(names, middle)) for row in found}

    for _ in range(max_iter):
        moved = list(centres)
        for i, mean in assigned(centres).items():
            moved[i] = mean
        shift = sum((a - b) * (a - b) * w for old, new in zip(centres, moved)
                    for a, b, w in zip(old, new, weights))
        centres = moved
        if shift <= tol * 4.0 ** GRID_BITS:
            break
    means = sorted((mean[0], i) for i, mean in assigned(centres).items())
    ids = {place: i for i, (_, place) in enumerate(means)}
    return centres, tuple(ids.get(i) for i in range(k))


def with_clusters(df: DataFrame, model: KMeansModel | None) -> DataFrame:
    """``df`` with its ``cluster``; no rows without a model."""
    if model is None:
        return df.withColumn("cluster", F.lit(None).cast("int")).where(F.lit(False))
    return df.withColumn("cluster", model.cluster())


def segments(df: DataFrame, model: KMeansModel | None, pca: PCAResult) -> DataFrame:
    """``df`` with ``cluster`` and the PCA scores, in one pass and without a join."""
    return with_clusters(df, model).withColumns(
        {f"pca_{i + 1}": c for i, c in enumerate(pca.scores())})


def kmeans_clusters(df: DataFrame, k: int = fixed.KMEANS_DEFAULT_K,
                    features: Sequence[str] = FEATURES, key: str = "id",
                    min_rows: int = 10) -> DataFrame:
    """``(key, cluster)`` for every row; empty when there are ``min_rows`` or fewer."""
    return with_clusters(df, fit_kmeans(df, k, features, key, min_rows)).select(key, "cluster")


def cluster_summary(labelled: DataFrame) -> DataFrame:
    """Summary by ``cluster`` of listings that carry it (:func:`with_clusters`)."""
    return sorted_small(labelled.groupBy("cluster").agg(
        rnd(exact_avg("price"), 2).alias("avg_price"), F.count("price").alias("listings"),
        rnd(exact_avg("number_of_reviews"), 2).alias("avg_reviews"),
        rnd(exact_avg("availability_365"), 2).alias("avg_availability"),
        rnd(exact_avg("occupancy_rate"), 2).alias("avg_occupancy"),
        rnd(exact_avg("estimated_revenue"), 2).alias("avg_revenue")), "cluster")


def cluster_winners(summary: DataFrame) -> DataFrame:
    def best(c):
        return F.max_by(F.col("cluster"), F.struct(F.col(c), -F.col("cluster")))
    return summary.agg(best("avg_revenue").alias("highest_revenue"),
                       best("listings").alias("largest_segment"),
                       best("avg_occupancy").alias("best_occupancy"),
                       best("avg_price").alias("most_expensive"))


def feature_corr(df: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """3 x 3 correlation of the clustering features on the *unfilled* data."""
    return corr_matrix(df, features)


def strong_correlations(df: DataFrame, features: Sequence[str] = tuple(fixed.CORRELATION_FEATURES),
                        threshold: float = fixed.STRONG_CORRELATION) -> DataFrame:
    """Pairs i < j with |r| > threshold (before rounding): direction and value."""
    m = correlations(df, features).where((F.col("x") != F.col("y")) & (F.abs("r") > F.lit(threshold)))
    return m.select(F.col("x").alias("feature_x"), F.col("y").alias("feature_y"),
                    F.when(F.col("r") > 0, "positive").otherwise("negative").alias("direction"),
                    rnd("r").alias("r"))
