from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from rows import listings
from staylens.functions import fixed
from staylens.functions.expressions import cut
from staylens.operators import filters as flt
from staylens.operators import summaries as sm
from staylens.operators.features import enrich, price_bounds

SETTINGS = settings(max_examples=8, deadline=None,
                    suppress_health_check=[HealthCheck.function_scoped_fixture])

prices = st.lists(st.floats(min_value=0.01, max_value=9999.0, allow_nan=False), min_size=1,
                  max_size=40)


@SETTINGS
@given(nights=st.lists(st.integers(min_value=0, max_value=60), min_size=1, max_size=40))
def test_bins_partition_in_range_rows(spark, nights):
    df = spark.createDataFrame([(n,) for n in nights], "n int")
    labels = [r[0] for r in df.select(cut("n", fixed.MIN_NIGHTS_EDGES,
                                          fixed.MIN_NIGHTS_LABELS)).collect()]
    assert sum(lab is not None for lab in labels) == sum(n > 0 for n in nights)


@SETTINGS
@given(ps=prices, lo=st.floats(min_value=0, max_value=5000))
def test_filter_idempotent_and_monotone(spark, ps, lo):
    df = listings(spark, [dict(price=p) for p in ps])
    b = price_bounds(df)
    spec = flt.FilterSpec(price_range=(lo, 9999.0))
    once = flt.apply_filters(df, spec, b)
    assert once.count() == flt.apply_filters(once, spec, b).count()
    wider = flt.FilterSpec(price_range=(0.0, 9999.0))
    assert once.count() <= flt.apply_filters(df, wider, b).count()


@SETTINGS
@given(names=st.lists(st.sampled_from("ABCDEFGH"), min_size=1, max_size=40),
       k=st.integers(min_value=1, max_value=6))
def test_topk_is_full_sort_cut(spark, names, k):
    df = listings(spark, [dict(neighbourhood=n) for n in names])
    df = enrich(df, price_bounds(df))
    top = [(r.neighbourhood, r.listings) for r in sm.top_neighbourhoods(df, k).collect()]
    counts = {}
    for n in names:
        counts[n] = counts.get(n, 0) + 1
    full = sorted(counts.items(), key=lambda kv: (-kv[1], kv[0]))
    assert top == full[:k]


def test_results_do_not_depend_on_partitioning(spark):
    import numpy as np

    from staylens.operators import stats as st_ops
    rng = np.random.default_rng(11)
    rows = [dict(price=float(np.round(rng.lognormal(5, 0.7), 2)),
                 neighbourhood=str(rng.choice(list("ABCDE"))),
                 availability_365=int(rng.integers(0, 366)),
                 number_of_reviews=int(rng.integers(0, 300))) for _ in range(600)]
    df = listings(spark, rows)
    df = enrich(df, price_bounds(df))
    other = df.repartition(7, "price")
    for fn in (sm.price_by_proximity, sm.review_activity, sm.competition_top10,
               sm.describe_numeric, sm.corr_matrix, lambda d: st_ops.stable_sample(d, 40)):
        a = sorted(map(tuple, fn(df).collect()), key=repr)
        b = sorted(map(tuple, fn(other).collect()), key=repr)
        assert a == b
