import glob
import json
import os
import tempfile

import pytest

from rows import listings
from staylens.operators import summaries as sm
from staylens.operators.features import enrich, price_bounds
from staylens.plans.context import tpch_context
from staylens.session import scratch_path
from staylens.sources.listings import read_listings_csv
from staylens.sources.sinks import export_bundle, export_csv, export_json
from staylens.streaming import enriched_stream, kpi_stream, run_to_memory

CSV = '''id,name,host_id,host_name,neighbourhood_group,neighbourhood,latitude,longitude,room_type,price,minimum_nights,number_of_reviews,last_review,reviews_per_month,calculated_host_listings_count,availability_365
1,"Flat, sea view",7,Ana,North,Alpha,-22.9711,-43.1823,Entire home/apt,"$1,234.00",1,10,2024-02-03,0.25,1,0
2,"Say ""hi""
twice",7,Ana,,Alpha,,,Private room,80,3,0,2024-13-01,,2,73
3,,8,Bo,North,Beta,-22.98,-43.20,Shared room,abc,31,101,,,21,365
4,x,9,Cy,North,Beta,-22.98,-43.20,Shared room,NaN,4,11,2023-12-01,1.5,6,365
'''

SF = "/root/testdata/sf0.001"


def _tmp():
    return tempfile.mkdtemp(prefix="staylens-test-")


def test_csv_ingestion(spark):
    d = _tmp()
    p = os.path.join(d, "listings.csv")
    with open(p, "w") as f:
        f.write(CSV)
    rows = {r.id: r for r in read_listings_csv(spark, p, multi_line=True).collect()}
    assert rows[1].price == 1234.0 and rows[1].name == "Flat, sea view"
    assert rows[2].name == 'Say "hi"\ntwice' and rows[2].price == 80.0
    assert rows[2].last_review is None and rows[2].neighbourhood_group is None
    assert rows[2].latitude is None and rows[2].reviews_per_month is None
    assert rows[3].price is None and rows[4].price is None     # bad text, NaN -> null
    assert rows[1].number_of_reviews == 10 and rows[3].availability_365 == 365


def test_csv_headers_and_missing_columns(spark):
    d = _tmp()
    header = CSV.splitlines()[0]
    line = "1,x,7,Ana,North,Alpha,-22.9,-43.1,Private room,80,1,10,03/15/2020,0.25,1,0"
    with open(os.path.join(d, "a.csv"), "w") as f:
        f.write(f"{header}\n{line}\n")
    assert str(read_listings_csv(spark, d).collect()[0].last_review) == "2020-03-15"

    def swapped(text):
        first, second, *rest = text.split(",")
        return ",".join([second, first, *rest])

    with open(os.path.join(d, "b.csv"), "w") as f:
        f.write(f"{swapped(header)}\n{swapped(line)}\n")
    for multi_line in (False, True):      # each file by its own header
        both = read_listings_csv(spark, d, multi_line).collect()
        assert len(both) == 2 and both[0] == both[1]
    row = read_listings_csv(spark, os.path.join(d, "b.csv")).collect()[0]
    assert (row.id, row.name) == (1, "x")
    with open(os.path.join(d, "c.csv"), "w") as f:
        f.write("id,name\n1,x\n")
    for source in ("c.csv", ""):
        for multi_line in (False, True):
            with pytest.raises(ValueError, match="price"):
                read_listings_csv(spark, os.path.join(d, source), multi_line)


def test_date_formats(spark):
    from staylens.sources.listings import parse_date
    texts = ["2020-03-15", "03/15/2020", "15/03/2020", "2020/3/15", "Mar 15, 2020",
             "15 Mar 2020", "20200315", "2020-03-15 10:11:12", " 2020-03-15 "]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {str(r.d) for r in df.select(parse_date("t").alias("d")).collect()} == {"2020-03-15"}
    bad = spark.createDataFrame([(t,) for t in ("soon", "2024-13-01", "", None)], "t string")
    assert all(r.d is None for r in bad.select(parse_date("t").alias("d")).collect())


def test_exports_round_trip(spark):
    df = listings(spark, [dict(price=10.0), dict(price=20.0, last_review=None)])
    df = enrich(df, price_bounds(df))
    d = _tmp()
    back = spark.read.option("header", True).csv(export_csv(df, os.path.join(d, "csv")))
    assert back.count() == 2 and back.columns == df.columns
    jpath = export_json(df, os.path.join(d, "json"))
    recs = [json.loads(line) for f in glob.glob(os.path.join(jpath, "part-*"))
            for line in open(f) if line.strip()]
    assert len(recs) == 2 and any(r["last_review"] is None for r in recs)
    paths = export_bundle(df, sm.export_summary(df, "2024-01-01 00:00:00"), os.path.join(d, "xl"))
    assert spark.read.option("header", True).csv(paths["summary"]).count() == 5


def test_stream_matches_batch(spark):
    d = _tmp()
    df = listings(spark, [dict(price=float(p), room_type=rt)
                          for p in range(1, 31) for rt in ("A", "B")])
    bounds = price_bounds(df)
    df.limit(30).write.parquet(os.path.join(d, "f1"))
    src = os.path.join(d, "in")
    os.makedirs(src)
    for f in glob.glob(os.path.join(d, "f1", "*.parquet")):
        os.link(f, os.path.join(src, os.path.basename(f)))
    out = run_to_memory(kpi_stream(enriched_stream(spark, src, bounds)), "kpi_test",
                        os.path.join(d, "ckpt"))
    got = {r.room_type: r.listings for r in out.collect()}
    batch = {r.room_type: r["count"] for r in df.limit(30).groupBy("room_type").count().collect()}
    assert got == batch


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_have_no_python_udfs_and_use_topk(spark):
    import __spark_entry__ as E
    sf = "/root/testdata/sf0.001"
    for key in ("price_by_room", "top_neighbourhoods", "corr_matrix", "describe_numeric",
                "monthly_metrics", "kpi_summary", "room_mix"):
        plan = _plan(E.queries()[key](spark, sf))
        assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan, key
    top = E.queries()["top_neighbourhoods"](spark, sf)
    top.explain("formatted")
    assert "TakeOrderedAndProject" in top._jdf.queryExecution().sparkPlan().toString()


def test_scan_prunes_columns(spark):
    from staylens.sources.listings import listings_from_tpch
    df = listings_from_tpch(spark, "/root/testdata/sf0.001").select("id", "price")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "l_extendedprice" not in plan and "o_orderstatus" not in plan


def test_materialized_table_context_matches_cache(spark):
    from staylens.plans.context import build_context
    from staylens.sources.listings import listings_from_tpch
    raw = listings_from_tpch(spark, "/root/testdata/sf0.001")
    a = build_context(spark, raw, materialize="cache")
    b = build_context(spark, raw, materialize="table")
    assert a.bounds == b.bounds
    assert "InMemoryRelation" not in b.baseline._jdf.queryExecution().optimizedPlan().toString()
    x = sm.price_by_room(a.filtered).collect()
    y = sm.price_by_room(b.filtered).collect()
    assert sorted(map(tuple, x)) == sorted(map(tuple, y))


def test_aggregations_stay_in_whole_stage_codegen(spark):
    import re

    import __spark_entry__ as E
    sf = "/root/testdata/sf0.001"
    for key in ("price_by_proximity", "corr_matrix", "describe_numeric", "price_kde",
                "kpi_summary", "monthly_metrics", "map_density"):
        df = E.queries()[key](spark, sf)
        df.collect()   # executes this DataFrame's own (adaptive) plan
        plan = df._jdf.queryExecution().executedPlan().toString()
        plan = plan.split("== Initial Plan ==")[0].split("InMemoryRelation")[0]
        interpreted = [ln for ln in plan.split("\n")
                       if re.match(r"^[\s:+-]*HashAggregate\(", ln)]
        assert not interpreted, (key, interpreted[:2])


def test_partitioned_table_prunes_room_type(spark):
    from staylens.operators.filters import FilterSpec
    from staylens.plans.context import build_context
    from staylens.sources.listings import listings_from_tpch
    raw = listings_from_tpch(spark, "/root/testdata/sf0.001")
    spec = FilterSpec(room_type="1-URGENT")
    a = build_context(spark, raw, spec, materialize="cache")
    b = build_context(spark, raw, spec, materialize="table", partition_by=("room_type",))
    assert b.baseline.columns == a.baseline.columns
    plan = b.filtered._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(room_type" in plan and "1-URGENT" in plan
    assert sorted(map(tuple, sm.price_by_room(a.filtered).collect())) == \
        sorted(map(tuple, sm.price_by_room(b.filtered).collect()))


def test_batch_run_writes_results(spark):
    from staylens.plans.run import run
    out = _tmp()
    times = run(spark, "/root/testdata/sf0.001", out, ["price_by_room", "kpi_summary"],
                partition_by=("room_type",))
    assert set(times) == {"build_context", "price_by_room", "kpi_summary"}
    assert spark.read.parquet(os.path.join(out, "price_by_room")).count() == 5
    assert spark.read.parquet(os.path.join(out, "kpi_summary")).count() == 1


def test_csv_stream_parses_text_prices(spark):
    from staylens.operators.features import price_bounds
    d = _tmp()
    src = os.path.join(d, "in")
    os.makedirs(src)
    with open(os.path.join(src, "part1.csv"), "w") as f:
        f.write(CSV)
    raw = read_listings_csv(spark, os.path.join(src, "part1.csv"), multi_line=True)
    bounds = price_bounds(raw.where("price < 10000"))
    out = run_to_memory(kpi_stream(enriched_stream(spark, src, bounds, fmt="csv")), "kpi_csv",
                        os.path.join(d, "ckpt"))
    got = {r.room_type: (r.listings, r.avg_price) for r in out.collect()}
    assert got == {"Entire home/apt": (1, 1234.0), "Private room": (1, 80.0)}


def test_stream_snapshot_sink(spark):
    from staylens.operators.features import price_bounds
    from staylens.streaming import write_kpis
    d = _tmp()
    df = listings(spark, [dict(price=float(p), room_type=rt) for p in range(1, 11) for rt in ("A", "B")])
    src = os.path.join(d, "in")
    df.write.parquet(src)
    q = write_kpis(kpi_stream(enriched_stream(spark, src, price_bounds(df))),
                   os.path.join(d, "snap"), os.path.join(d, "ckpt"))
    q.processAllAvailable()
    q.stop()
    got = {r.room_type: r.listings for r in spark.read.parquet(os.path.join(d, "snap")).collect()}
    assert got == {"A": 10, "B": 10}


def test_one_scan_for_kpis_and_top_values(spark):
    from staylens.operators import filters as flt
    from staylens.operators import summaries as sm
    c = tpch_context(spark, SF)
    kept = flt.filter_predicate(c.spec, c.bounds)
    path = scratch_path(spark, "one-scan-test")
    c.baseline.write.mode("overwrite").parquet(path)
    base = spark.read.parquet(path)
    for df in (sm.kpi_summary(base, kept), sm.filter_summary(base, kept, c.spec, (1.0, 2.0))):
        plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert plan.count("FileScan") == 1 and "NestedLoop" not in plan


def test_input_bytes_through_spark(spark, tmp_path):
    from staylens.session import input_bytes
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x").write_bytes(b"1" * 700)
    (tmp_path / "y").write_bytes(b"2" * 30)
    for prefix in ("", "file://"):
        assert input_bytes(spark, [f"{prefix}{tmp_path}/a", f"{prefix}{tmp_path}/y",
                                   f"{prefix}{tmp_path}/none"]) == 730
