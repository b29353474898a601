import datetime as dt

from staylens.operators.skew import attach_key_count
from staylens.sources.listings import listings_from_tpch


def test_hot_keys_salted_and_counts_exact(spark):
    rows = [(i, 0 if i % 3 == 0 else i % 50) for i in range(3000)]   # key 0 holds a third
    df = spark.createDataFrame(rows + [(3000, None)], "id long, k long")
    expect = {r.k: r["count"] for r in df.groupBy("k").count().collect()}
    for shares in (1, 10, 1000):
        out = attach_key_count(df, "k", "n", salt_col="id", shares=shares)
        got = {r.id: r.n for r in out.collect()}
        assert len(got) == 3000 and all(got[i] == expect[k] for i, k in rows)


def test_star_view_counts_equal_a_plain_join(spark):
    got = listings_from_tpch(spark, "/root/testdata/sf0.001")
    plain = got.groupBy("host_id").count().withColumnRenamed("count", "n")
    assert got.count() == 1500
    assert got.join(plain, "host_id").where("n <> calculated_host_listings_count").count() == 0


def _tables(spark, at):
    spark.createDataFrame([(0, "R", ), (0, "S"), (None, "T")], "r_regionkey int, r_name string") \
        .write.parquet(f"{at}/region.parquet")
    spark.createDataFrame([(0, "N", 0), (1, "M", 5), (None, "O", 0)],
                          "n_nationkey int, n_name string, n_regionkey int") \
        .write.parquet(f"{at}/nation.parquet")
    spark.createDataFrame([(1, "a", 0), (1, "b", 0), (2, "c", 0), (3, "d", 1), (4, "e", None)],
                          "c_custkey long, c_name string, c_nationkey int") \
        .write.parquet(f"{at}/customer.parquet")
    orders = [(k, c, 100.0, dt.datetime(1995, 1, 1), "P")
              for k, c in ((3, 1), (3, 1), (4, 2), (7, 3), (8, 4), (9, None), (None, 2))]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_totalprice double, "
                          "o_orderdate timestamp, o_orderpriority string") \
        .write.parquet(f"{at}/orders.parquet")
    spark.createDataFrame([(3, 2.0), (3, 3.0), (7, 1.0), (None, 9.0)],
                          "l_orderkey long, l_quantity double").write.parquet(f"{at}/lineitem.parquet")


def test_star_view_of_repeated_and_missing_keys(spark, tmp_path):
    _tables(spark, str(tmp_path))
    got = listings_from_tpch(spark, str(tmp_path)).collect()
    # order 3 twice, by customer 1 twice, in region 0 twice; order 4 by customer 2
    assert sorted((r.id, r.host_name, r.neighbourhood_group, r.number_of_reviews,
                   r.calculated_host_listings_count) for r in got if r.id is not None) == sorted(
        [(3, n, g, 5, 8) for n in "ab" for g in "RS"] * 2 + [(4, "c", g, 0, 4) for g in "RS"])


def test_host_join_does_not_carry_computed_columns(spark):
    plan = listings_from_tpch(spark, "/root/testdata/sf0.001")._jdf.queryExecution() \
        .optimizedPlan().toString().splitlines()
    named = [i for i, line in enumerate(plan) if "concat(Listing" in line]
    assert named and max(named) < min(i for i, line in enumerate(plan) if "Join" in line)
