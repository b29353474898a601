import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rows import listings
from staylens.operators import ml
from staylens.operators import stats as st
from staylens.operators.features import enrich, price_bounds


def _enriched(spark, rows):
    df = listings(spark, rows)
    return enrich(df, price_bounds(df))


@pytest.fixture(scope="module")
def sample(spark):
    rng = np.random.default_rng(7)
    n = 400
    price = np.round(rng.lognormal(5, 0.6, n), 2)
    reviews = rng.integers(0, 200, n)
    avail = rng.integers(0, 366, n)
    rows = [dict(price=float(p), number_of_reviews=int(r), availability_365=int(a),
                 reviews_per_month=float(r) / 10) for p, r, a in zip(price, reviews, avail)]
    return _enriched(spark, rows), price, reviews.astype(float), avail.astype(float)


def test_histogram_covers_all_rows(sample):
    df, price, _, _ = sample
    h = st.price_histogram(df).collect()
    assert len(h) == 50 and sum(r.listings for r in h) == len(price)
    counts, _ = np.histogram(price, bins=50, range=(price.min(), price.max()))
    assert [r.listings for r in h] == list(counts)


def test_kde_matches_direct_formula(sample):
    df, price, _, _ = sample
    out = st.price_kde(df).collect()
    n, h = len(price), price.std(ddof=1) * len(price) ** -0.2
    grid = np.linspace(price.min(), price.max(), 100)
    dens = np.exp(-0.5 * ((grid[:, None] - price[None, :]) / h) ** 2).sum(1) / (n * h * math.sqrt(2 * math.pi))
    expect = dens * n * (price.max() - price.min()) / 50
    assert [r.density for r in out] == pytest.approx(list(expect), rel=1e-6, abs=1e-6)


def test_linear_trend(sample):
    df, price, _, avail = sample
    r = st.availability_trend(df).collect()[0]
    slope, intercept = np.polyfit(avail, price, 1)
    assert r.slope == pytest.approx(slope, abs=1e-5)
    assert r.intercept == pytest.approx(intercept, abs=1e-4)
    assert r.r == pytest.approx(np.corrcoef(avail, price)[0, 1], abs=1e-6)


def _lowess_at(x, y, g, k, robust=None):
    d = np.abs(x - g)
    h = np.sort(d)[k - 1]
    u = d / h if h > 0 else np.where(d == 0, 0.0, np.inf)
    w = np.where(u < 1, (1 - u ** 3) ** 3, 0.0)
    if robust is not None:
        w = w * robust
    sw = w.sum()
    xb, yb = (w * x).sum() / sw, (w * y).sum() / sw
    den = (w * x * x).sum() - sw * xb * xb
    b = ((w * x * y).sum() - sw * xb * yb) / den if abs(den) > 1e-12 * (w * x * x).sum() else 0.0
    return yb + b * (g - xb)


@pytest.mark.parametrize("cells", [4096, 37, 1])
def test_local_trend_against_brute_force(sample, monkeypatch, cells):
    df, price, reviews, _ = sample
    monkeypatch.setattr(st, "CELLS", cells)
    k = int(0.3 * len(price) + 1e-10)
    grid = np.linspace(price.min(), price.max(), 20)
    plain = [_lowess_at(price, reviews, g, k) for g in grid]
    out = st.local_trend(df, points=20, iterations=0).collect()
    assert [r.fitted for r in out] == pytest.approx(plain, rel=1e-6, abs=1e-6)
    fit = np.array(plain)
    for _ in range(2):   # robustifying rounds against interpolated residuals
        resid = reviews - np.interp(price, grid, fit)
        v = resid / (6 * np.median(np.abs(resid)))
        fit = np.array([_lowess_at(price, reviews, g, k, np.where(np.abs(v) < 1, (1 - v * v) ** 2, 0.0))
                        for g in grid])
    out = st.local_trend(df, points=20, iterations=2).collect()
    assert [r.fitted for r in out] == pytest.approx(list(fit), rel=1e-5, abs=1e-5)


def test_stable_sample_ignores_partitioning(sample):
    df = sample[0]
    a = sorted(r.id for r in st.stable_sample(df, 50).collect())
    b = sorted(r.id for r in st.stable_sample(df.repartition(7), 50).collect())
    assert a == b and len(a) == 50


def test_pca_invariants(sample):
    df = sample[0]
    m = ml.fit_pca(df)
    comps = m.components
    assert np.allclose(comps @ comps.T, np.eye(2), atol=1e-9)
    pdf = df.select("price", "number_of_reviews", "availability_365").toPandas().astype(float)
    z = (pdf - pdf.mean()) / pdf.std(ddof=0)
    ev = np.sort(np.linalg.eigvalsh(np.cov(z.values.T)))[::-1]
    assert list(m.explained_ratio) == pytest.approx(list(ev[:2] / ev.sum()), rel=1e-6)
    for row in comps:
        assert row[np.argmax(np.abs(row))] > 0
    scores = ml.pca_scores(df, model=m).toPandas()
    assert np.allclose(scores["pca_1"].values, z.values @ comps[0], atol=1e-5)


def test_standardise_constant_column(spark):
    df = _enriched(spark, [dict(price=float(p), availability_365=100) for p in range(1, 6)])
    z = ml.standardised_features(df).collect()
    assert all(r.z_availability_365 == 0.0 for r in z)
    assert sum(r.z_price for r in z) == pytest.approx(0.0, abs=1e-9)


def test_kmeans_labels_cover_rows(sample):
    df = sample[0]
    cl = ml.with_clusters(df, ml.fit_kmeans(df, k=3))
    assert cl.count() == df.count() and cl.where("cluster IS NULL").count() == 0
    summary = ml.cluster_summary(cl).collect()
    assert sum(r.listings for r in summary) == df.count()
    prices = [r.avg_price for r in summary]
    assert prices == sorted(prices)        # ids renumbered by mean price
    w = ml.cluster_winners(ml.cluster_summary(cl)).collect()[0]
    assert w.most_expensive == len(summary) - 1


def test_kmeans_rows_are_nearest_to_their_own_centre(sample):
    df, price, reviews, avail = sample
    x = np.column_stack([price, reviews, avail])
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    model = ml.fit_kmeans(df, k=4, tol=0.0)
    got = np.array([r.cluster for r in df.select(model.cluster().alias("cluster")).collect()])
    centres = np.array([z[got == c].mean(axis=0) for c in range(4)])
    d = ((z[:, None, :] - centres[None]) ** 2).sum(axis=2)
    assert (d[np.arange(len(z)), got] <= d.min(axis=1) + 1e-5).all()


def test_kmeans_does_not_depend_on_partitioning(sample):
    df = sample[0]
    models = {ml.fit_kmeans(d, k=4) for d in (df, df.repartition(11), df.repartition(3, "price"))}
    assert len(models) == 1


def test_kmeans_of_few_values(spark):
    df = _enriched(spark, [dict(price=float(50 + p % 2), availability_365=p % 2,
                                number_of_reviews=3) for p in range(20)])
    got = ml.with_clusters(df, ml.fit_kmeans(df, k=4)).groupBy("cluster").count().collect()
    assert sorted((r.cluster, r["count"]) for r in got) == [(0, 10), (1, 10)]


def test_kmeans_reads_its_rows_twice_whatever_the_passes(sample):
    spark, df = sample[0].sparkSession, sample[0].select("id", *ml.FEATURES)
    read = spark.sparkContext.accumulator(0)

    def counted(x):
        read.add(1)
        return x

    price = F.udf(counted, "double").asNondeterministic()("price")
    model = ml.fit_kmeans(df.select("id", price.alias("price"), *ml.FEATURES[1:]), k=4)
    assert read.value <= 2 * df.count()
    assert model == ml.fit_kmeans(df, k=4)


def test_kmeans_of_values_far_from_zero(spark):
    rows = [(i, float(p), i % 7, i % 5) for i, p in enumerate([1, 2, 3, 40, 41, 43, 90, 91, 95] * 3)]
    df = spark.createDataFrame(rows, "id long, price double, number_of_reviews int, availability_365 int")
    far = df.withColumn("price", F.col("price") + F.lit(float(2 ** 40)))
    near = {r.id: r.cluster for r in ml.kmeans_clusters(df, k=3).collect()}
    assert near == {r.id: r.cluster for r in ml.kmeans_clusters(far, k=3).collect()}
    assert len(near) == 27 and set(near.values()) == {0, 1, 2}


def test_segments_have_all_columns(sample):
    df = sample[0]
    out = ml.segments(df, ml.fit_kmeans(df), ml.fit_pca(df))
    assert out.columns == df.columns + ["cluster", "pca_1", "pca_2"]
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_describe_of_large_ids_and_tiny_values(spark):
    from staylens.operators.summaries import describe_numeric
    big = 1_060_000_000_000_000_000
    df = spark.createDataFrame([(big, 1e-11), (big + 2, 3e-11), (None, None)], "id long, x double")
    rows = {r["column"]: r for r in describe_numeric(df).collect()}
    assert rows["id"]["mean"] == float(big + 1) and rows["id"]["count"] == 2
    assert rows["x"]["count"] == 2


def test_kmeans_too_few_rows(spark):
    df = _enriched(spark, [dict(price=float(p)) for p in range(1, 6)])
    assert ml.kmeans_clusters(df).count() == 0


def test_strong_pairs(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=300)
    y = 0.9 * x + math.sqrt(1 - 0.81) * rng.normal(size=300)
    rows = [dict(price=float(100 + 10 * a), number_of_reviews=int(round(50 + 20 * b)),
                 availability_365=int(rng.integers(0, 366))) for a, b in zip(x, y)]
    out = ml.strong_correlations(_enriched(spark, rows), ml.FEATURES).collect()
    assert [(r.feature_x, r.feature_y, r.direction) for r in out] == [
        ("price", "number_of_reviews", "positive")]


def test_correlation_of_exactly_half_is_not_strong(spark):
    # x = (1, 2, 3), y = (1, 3, 2): covariance 0.5, both deviations 1 -> r = 0.5
    rows = [dict(price=float(p), number_of_reviews=r, availability_365=a)
            for p, r, a in ((1, 1, 10), (2, 3, 30), (3, 2, 20))]
    df = _enriched(spark, rows)
    m = {(r.feature_x, r.feature_y): r.r for r in ml.feature_corr(df).collect()}
    assert m[("price", "number_of_reviews")] == 0.5
    pairs = {(r.feature_x, r.feature_y) for r in ml.strong_correlations(df, ml.FEATURES).collect()}
    assert ("price", "number_of_reviews") not in pairs
    # availability (10, 30, 20) has r = 0.5 with price as well, and r = 1 with reviews
    assert pairs == {("number_of_reviews", "availability_365")}
