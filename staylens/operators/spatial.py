"""Nearest point of a table of points, by a search over grid cells (no row pairs).

Places are points of the unit sphere in space, where nearness by chord and nearness on
the sphere are the same and neither poles nor the date line are special.  Space is cut
into cubes: ``2**level`` a side, each level's cubes being 64 of the next even level's.

1. The leaf level is the coarsest one whose fullest cube holds ``LEAF_POINTS`` points.
2. For each *cube* that holds rows (never for each row) the cubes of points that can
   hold a row's nearest one are searched from the coarsest level down.  A cube stays if
   its least distance is within the least of the greatest distances to one point of
   each cube; the children of those that stay are the next candidates (an equi-join).
   The search ends when no nearer cube can exist, however far the points are.
3. The points of a cube's few candidates become one array, rows join it by their cube
   and take the nearest point of the array in place: no fan-out and no second shuffle of
   rows.

Distances are great-circle kilometres compared at ``DIGITS`` decimals (a millimetre);
of equally near points the smallest id wins, and of points at one place too.

Defined cases: a row with a null or NaN coordinate, and every row if there are no points, has
null results; points without coordinates or id are left out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from staylens.functions.expressions import haversine_km, round2

DIGITS = 6
LEAF_POINTS = 8
TOP_LEVEL, DEEPEST = 2, 20      # 64 cubes in all; cubes 12 m a side
SLACK = 1e-9                    # of chords: 6 mm, above rounding at DIGITS
_AXES = ("x", "y", "z")


def _on_sphere(lat: Column, lon: Column) -> dict[str, Column]:
    la, lo = F.radians(lat), F.radians(lon)
    return {"x": F.cos(la) * F.cos(lo), "y": F.cos(la) * F.sin(lo), "z": F.sin(la)}


def _step(coordinate: Column, level: int) -> Column:
    """Number of the cube along one axis."""
    n = 1 << level
    return F.least(F.floor((coordinate + 1.0) * float(n // 2)), F.lit(n - 1)).cast("long")


def _cube(steps: list[Column]) -> Column:
    return reduce(lambda a, b: F.shiftleft(a, DEEPEST).bitwiseOR(b), steps)


def _cube_of(places: dict[str, Column], level: int) -> Column:
    return _cube([_step(places[a], level) for a in _AXES])


def _corner(cube: Column, axis: int, level: int) -> Column:
    """The lower bound of a cube along one axis."""
    step = F.shiftright(cube, DEEPEST * (2 - axis)).bitwiseAND(F.lit((1 << DEEPEST) - 1))
    return step / float(1 << (level - 1)) - 1.0


def _parent(cube: Column, levels: int = 2) -> Column:
    """The cube ``levels`` levels up that holds this one."""
    steps = [F.shiftright(F.shiftright(cube, DEEPEST * (2 - i))
                          .bitwiseAND(F.lit((1 << DEEPEST) - 1)), levels) for i in range(3)]
    return _cube(steps)


def _known(*columns: Column) -> Column:
    return reduce(lambda a, b: a & b, [c.isNotNull() & ~F.isnan(c.cast("double")) for c in columns])


def leaf_level(points: DataFrame) -> int:
    """The coarsest even level at which no cube holds more than LEAF_POINTS of the points
    (columns x, y, z), else DEEPEST; one pass, and one row a level reaches the driver."""
    levels = list(range(TOP_LEVEL, DEEPEST + 1, 2))
    at = {a: F.col(a) for a in _AXES}
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("level"), _cube_of(at, n).alias("cube"))
                               for n in levels))).alias("c")
    fullest = (points.select(each).groupBy("c.level", "c.cube").agg(F.count("*").alias("n"))
               .groupBy("level").agg(F.max("n").alias("n")).collect())
    fine = [r["level"] for r in fullest if r["n"] <= LEAF_POINTS]
    return min(fine, default=DEEPEST)


def candidate_cubes(cubes: DataFrame, points: DataFrame, level: int) -> DataFrame:
    """(cube, near): for each cube of ``cubes`` the cubes of ``points`` (x, y, z, id) that
    can hold the nearest point of some place in it, all at ``level``."""
    place = {a: F.col(a) for a in _AXES}
    one = F.min(F.struct("id", *_AXES)).alias("one")        # a point of each cube
    # the coarsest cubes: at most 64 rows, whatever the number of points
    top = points.groupBy(_cube_of(place, TOP_LEVEL).alias("near")).agg(one).collect()
    if not top:
        return cubes.select("cube", F.lit(None).cast("long").alias("near")).limit(0)
    listed = F.array(*(F.struct(F.lit(r["near"]).alias("near"), F.struct(
        *(F.lit(r["one"][a]).alias(a) for a in _AXES)).alias("one")) for r in top))
    found = cubes.select("cube", F.explode(listed).alias("c")).select("cube", "c.near", "c.one")
    side = 2.0 / (1 << level)
    now = TOP_LEVEL
    while True:
        wide = 2.0 / (1 << now)
        least, most = F.lit(0.0), F.lit(0.0)
        for i, axis in enumerate(_AXES):
            low = _corner(F.col("cube"), i, level)
            near = _corner(F.col("near"), i, now)
            gap = F.greatest(near - (low + side), low - (near + wide), F.lit(0.0))
            reach = F.greatest(F.abs(F.col(f"one.{axis}") - low),
                               F.abs(F.col(f"one.{axis}") - (low + side)))
            least, most = least + gap * gap, most + reach * reach
        within = F.min(F.sqrt(most)).over(Window.partitionBy("cube"))
        found = (found.withColumn("least", F.sqrt(least)).withColumn("within", within)
                 .where(F.col("least") <= F.col("within") + SLACK).select("cube", "near"))
        if now == level:
            return found
        now += 2
        children = (points.groupBy(_cube_of(place, now).alias("near")).agg(one)
                    .withColumn("above", _parent(F.col("near"))))
        found = found.withColumnRenamed("near", "above").join(children, "above").select(
            "cube", "near", "one")


def nearest_point(df: DataFrame, points: DataFrame, lat: str = "latitude",
                  lon: str = "longitude", point_id: str = "poi_id",
                  point_lat: str = "latitude", point_lon: str = "longitude",
                  out_id: str = "nearest_poi", out_km: str = "distance_km",
                  level: int | None = None) -> DataFrame:
    """``df`` with the id of the nearest of ``points`` and its distance in km."""
    known = points.where(F.col(point_id).isNotNull() & _known(F.col(point_lat), F.col(point_lon)))
    placed = (known.groupBy(F.col(point_lat).cast("double").alias("lat"),
                            F.col(point_lon).cast("double").alias("lon"))
              .agg(F.min(point_id).alias("id")))
    placed = placed.select("id", "lat", "lon", *(
        c.alias(a) for a, c in _on_sphere(F.col("lat"), F.col("lon")).items()))
    level = leaf_level(placed) if level is None else level
    cube = F.when(_known(F.col(lat), F.col(lon)),
                  _cube_of(_on_sphere(F.col(lat), F.col(lon)), level))
    rows = df.withColumn("_cube", cube)
    cubes = rows.where(F.col("_cube").isNotNull()).select(F.col("_cube").alias("cube")).distinct()
    found = candidate_cubes(cubes, placed, level)
    at_leaf = placed.select("id", "lat", "lon", _cube_of(
        {a: F.col(a) for a in _AXES}, level).alias("near"))
    arrays = (found.join(at_leaf, "near").groupBy(F.col("cube").alias("_cube"))
              .agg(F.collect_list(F.struct("id", "lat", "lon")).alias("_points")))

    def distance(p: Column) -> Column:
        km = haversine_km(lat, lon, p["lat"], p["lon"])
        return F.struct(round2(km, DIGITS).alias("km"), p["id"].alias("id"))

    best = F.array_min(F.transform("_points", distance))
    # the struct is taken apart by one generator row, so that it is made once
    return (rows.join(arrays, "_cube", "left")
            .select(*df.columns, F.inline_outer(F.array(best)).alias(out_km, out_id))
            .select(*df.columns, out_id, out_km))
