import numpy as np
import pytest

from staylens.operators.quantiles import exact_quantiles


def _ref(vals, p):
    vals = np.sort(np.asarray(vals, dtype=float))
    n = len(vals)
    h = p * (n - 1)
    lo = int(np.floor(h))
    hi = min(lo + 1, n - 1)
    a, b = vals[lo], vals[hi]
    return a if a == b else a + (b - a) * (h - lo)


@pytest.mark.parametrize("grid,direct,few", [(2, 1e9, 1000), (9, 0, 1000), (60, 0, 1),
                                             (60, 1e9, 1), (500, 1e9, 1000)])
def test_quantiles_match_linear_rule(spark, monkeypatch, grid, direct, few):
    from staylens.operators import quantiles
    monkeypatch.setattr(quantiles, "DIRECT_ROWS", direct)
    monkeypatch.setattr(quantiles, "FEW_GROUPS", few)
    rng = np.random.default_rng(1)
    g = rng.integers(0, 3, 3000)
    x = np.round(rng.lognormal(4, 1, 3000), 2)
    x[:200] = 5.0                      # heavy duplicate
    rows = [(int(a), float(b)) for a, b in zip(g, x)] + [(1, None), (None, 3.0)]
    df = spark.createDataFrame(rows, "g int, x double")
    probs = [0.0, 0.2, 0.25, 0.5, 0.85, 1.0]
    res = exact_quantiles(df, "x", probs, ["g"], grid=grid)
    for grp in range(3):
        vals = x[g == grp]
        for p, got in zip(probs, res[(grp,)]):
            assert got == pytest.approx(_ref(vals, p), rel=0, abs=1e-9)
    glob = exact_quantiles(df, "x", probs, grid=grid)
    allv = np.concatenate([x, [3.0]])
    for p, got in zip(probs, glob[()]):
        assert got == pytest.approx(_ref(allv, p), rel=0, abs=1e-9)


def test_quantiles_of_a_known_number_of_rows(spark, monkeypatch):
    from staylens.operators import quantiles as q
    vals = [3.0, 1.0, 1.0, 9.0, 2.5, float("nan")]
    df = spark.createDataFrame([(v,) for v in vals] + [(None,)], "x double")
    for direct in (100, 0):          # in order by themselves, and by brackets
        monkeypatch.setattr(q, "DIRECT_ROWS", direct)
        got = exact_quantiles(df, "x", [0.0, 0.3, 0.5, 1.0], rows=5)[()]
        assert got == pytest.approx([_ref(vals[:5], p) for p in (0.0, 0.3, 0.5, 1.0)])
    assert exact_quantiles(df.limit(0), "x", [0.5], rows=0) == {}


def test_quantiles_small_and_empty(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,), (5.0,),
                                (6.0,), (7.0,), (8.0,), (9.0,), (10.0,)], "x double")
    got = exact_quantiles(df, "x", [0.2, 0.4, 0.6, 0.8])[()]
    assert got == pytest.approx([2.8, 4.6, 6.4, 8.2])
    empty = df.where("x > 100")
    assert exact_quantiles(empty, "x", [0.5]) == {}
    one = df.where("x = 3")
    assert exact_quantiles(one, "x", [0.25, 0.75])[()] == [3.0, 3.0]


from hypothesis import HealthCheck, given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=st.lists(st.one_of(st.integers(-5, 5).map(float),
                                 st.floats(-1e6, 1e6, allow_nan=False)), min_size=1, max_size=300),
       groups=st.integers(1, 3), grid=st.integers(1, 64),
       probs=st.lists(st.floats(0, 1), min_size=1, max_size=4))
def test_quantiles_property(spark, values, groups, grid, probs):
    rows = [(i % groups, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "g int, x double")
    got = exact_quantiles(df, "x", probs, ["g"], grid=grid)
    for g in range(groups):
        vals = [v for k, v in rows if k == g]
        if not vals:
            assert (g,) not in got
            continue
        for p, q in zip(probs, got[(g,)]):
            assert q == pytest.approx(_ref(vals, p), rel=1e-12, abs=1e-9)


def test_brackets_hold_few_rows_and_many_groups_pass(spark):
    from pyspark.sql import functions as F

    from staylens.operators import quantiles as q
    df = spark.range(200_000).select((F.col("id") % 4).alias("g"),
                                     (F.xxhash64("id") / 1e12).alias("x"))
    found = q._summaries(q._prepare(df, "x", ["g"]), ["g"], F.array(F.lit(25_000).cast("long")), 500)
    wide = df.join(found, "g").where((F.col("x") >= F.col("_zones")[0]["lo"])
                                     & (F.col("x") <= F.col("_zones")[0]["hi"])).count()
    assert 0 < wide < 200_000 * 7 / 500
    many = df.withColumn("g", F.col("id") % 20_000) if "id" in df.columns else \
        spark.range(60_000).select((F.col("id") % 20_000).alias("g"), F.col("id").cast("double").alias("x"))
    got = q.quantile_frame(many, "x", [0.5], ["m"], ["g"])
    assert got.where("m = g + 20000").count() == 20_000
    at = q.order_statistics(df, "x", [0, 49_999, 50_000, -1], ["g"])
    for g, r in at.items():
        ends = df.where(F.col("g") == g[0]).agg(F.min("x"), F.max("x")).first()
        assert sorted(r) == [0, 49_999] and (r[0], r[49_999]) == tuple(ends)


def test_two_passes_over_the_data(spark, tmp_path):
    from pyspark.sql import functions as F

    from staylens.operators import quantiles as q
    path = str(tmp_path / "t")
    spark.range(1000).select((F.col("id") % 3).alias("g"), F.col("id").cast("double").alias("x")) \
        .write.parquet(path)
    df = spark.read.parquet(path)
    grouped = q.quantile_frame(df, "x", [0.25, 0.5], ["a", "b"], ["g"])
    grouped.collect()
    plan = grouped._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("FileScan parquet") - 2 <= plan.count("ReusedExchange")


def test_quantiles_of_extreme_values(spark):
    rng = np.random.default_rng(2)
    wide = [float(v) for v in 10.0 ** rng.uniform(-300, 300, 3000)]
    plain = [float(v) for v in rng.normal(size=3000)]
    for vals in (wide, [-v for v in wide] + wide, plain + [-1.7e308, 1.7e308, 5e-324, 0.0]):
        df = spark.createDataFrame([(v,) for v in vals], "x double")
        n = len(vals)
        got = exact_quantiles(df, "x", [0.0, 100 / (n - 1), 0.5, 1.0], grid=60)[()]
        for p, q in zip([0.0, 100 / (n - 1), 0.5, 1.0], got):
            assert q == pytest.approx(_ref(vals, p), rel=1e-9)
