"""Nearest point by grid search against all pairs, on made places and the listing view."""

import math

import numpy as np
import pytest

from staylens.operators import spatial


def all_pairs(rows, points):
    out = []
    for rid, lat, lon in rows:
        if lat is None or lon is None or math.isnan(lat) or math.isnan(lon):
            out.append((rid, None, None))
            continue
        best = None
        for pid, plat, plon in points:
            if pid is None or plat is None or plon is None or math.isnan(plat) or math.isnan(plon):
                continue
            la, lo = math.radians(plat - lat), math.radians(plon - lon)
            a = math.sin(la / 2) ** 2 + (math.cos(math.radians(lat)) * math.cos(math.radians(plat))
                                         * math.sin(lo / 2) ** 2)
            km = 6371.0 * 2 * math.atan2(math.sqrt(a), math.sqrt(1 - a))
            best = min(best, (round(km, 6), pid)) if best else (round(km, 6), pid)
        out.append((rid, *(best[::-1] if best else (None, None))))
    return out


def nearest(spark, rows, points, **kw):
    df = spark.createDataFrame(rows, "id long, latitude double, longitude double")
    pts = spark.createDataFrame(points, "poi_id long, latitude double, longitude double")
    return spatial.nearest_point(df, pts, **kw)


@pytest.mark.parametrize("level", [2, 6, 12, 20, None])
def test_against_all_pairs(spark, level):
    rng = np.random.default_rng(3)
    city = [(float(-22.9 + d), float(-43.2 + e)) for d, e in rng.normal(0, 0.02, (120, 2))]
    globe = [(float(a), float(b)) for a, b in zip(rng.uniform(-90, 90, 40), rng.uniform(-180, 180, 40))]
    edge = [(90.0, 0.0), (-90.0, 17.0), (10.0, 180.0), (10.0, -179.9999), (89.99, 90.0)]
    points = [(i, *p) for i, p in enumerate([*city[:80], *globe[:10], *edge[:3]])]
    points += [(500, *city[0]), (-5, *city[1]), (None, 0.0, 0.0), (600, None, 3.0), (601, float("nan"), 1.0)]
    rows = [(i, *p) for i, p in enumerate([*city[60:], *globe[5:], *edge, *city[:3]])]
    rows += [(900, None, 1.0), (901, 1.0, None), (902, float("nan"), 1.0), (903, *city[0])]
    got = {r["id"]: r for r in nearest(spark, rows, points, level=level).collect()}
    for rid, pid, km in all_pairs(rows, points):
        if pid is None:
            assert got[rid]["nearest_poi"] is None and got[rid]["distance_km"] is None
        else:
            assert got[rid]["nearest_poi"] == pid
            assert abs(got[rid]["distance_km"] - km) < 2e-6
    assert len(got) == len(rows)


def test_no_points_and_no_rows(spark):
    assert nearest(spark, [(1, 2.0, 3.0)], []).collect()[0][3:] == (None, None)
    assert nearest(spark, [], [(1, 2.0, 3.0)]).count() == 0


def test_dense_points_are_cut_into_small_cubes(spark):
    rng = np.random.default_rng(4)
    points = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in
                                    enumerate(rng.normal(10, 0.01, (3000, 2)))],
                                   "id long, lat double, lon double")
    from pyspark.sql import functions as F
    placed = points.select("id", *(c.alias(a) for a, c in
                                   spatial._on_sphere(F.col("lat"), F.col("lon")).items()))
    level = spatial.leaf_level(placed)
    assert 10 < level < 20
    cubes = placed.select(spatial._cube_of({a: F.col(a) for a in "xyz"}, level).alias("cube")).distinct()
    per_cube = [r["count"] for r in spatial.candidate_cubes(cubes, placed, level)
                .groupBy("cube").count().collect()]
    n = cubes.count()          # cubes at the sparse rim see a few more than their neighbours
    assert len(per_cube) == n and max(per_cube) <= 64 < n / 4


def test_plan_has_no_pairs_of_rows(spark):
    plan = nearest(spark, [(1, 2.0, 3.0)], [(1, 2.0, 3.0)], level=8)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
