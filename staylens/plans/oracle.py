"""Independent SQL (DuckDB dialect) for the registered queries.

Written as plain SQL over the pre-registered TPC-H views: the listing star view,
cleaning, price bounds (``quantile_cont``), enrichment and the default filter are
a shared CTE prefix; each key adds its own tail.  Double constants are written
as ``1E3``-style literals so both engines use DOUBLE arithmetic.  The SQL takes
its own routes where the library uses custom operators: ``quantile_cont`` for
the selection-based quantiles, a closed-form 3 x 3 eigen-solution for PCA, a
``row_number`` radius and unrolled robust rounds for LOWESS, and xxHash64 in
128-bit integer arithmetic for the seeded sample.
"""

from __future__ import annotations


class fixed:  # noqa: N801 - read as fixed.NAME
    """FIXED VALUES - what the dashboard uses, written out again for the SQL side: a
    wrong value in the library must not be right here."""

    PRICE_CATEGORY_LABELS = ["Budget", "Economy", "Standard", "Premium", "Luxury"]
    HOST_CATEGORY_EDGES = [0, 1, 5, 20, None]
    HOST_CATEGORY_LABELS = ["Single Property", "Small Portfolio", "Medium Portfolio",
                            "Large Portfolio"]
    BEACH_PROXIMITY_EDGES = [0, 1, 3, 5, None]
    BEACH_PROXIMITY_LABELS = ["Beachfront (<1km)", "Near Beach (1-3km)", "Mid Distance (3-5km)",
                              "Inland (>5km)"]
    HOST_EXPERIENCE_EDGES = [0, 10, 50, 100, None]
    HOST_EXPERIENCE_LABELS = ["New (0-10 reviews)", "Growing (11-50)", "Experienced (51-100)",
                              "Veteran (>100)"]
    OCCUPANCY_BAND_EDGES = [0, 0.2, 0.4, 0.6, 0.8, 1.0]
    OCCUPANCY_BAND_LABELS = ["0-20%", "20-40%", "40-60%", "60-80%", "80-100%"]
    PRICE_RANGE_EDGES = [0, 50, 100, 200, 500, None]
    PRICE_RANGE_LABELS = ["$0-50", "$51-100", "$101-200", "$201-500", "$500+"]
    MIN_NIGHTS_EDGES = [0, 1, 3, 7, 30, None]
    MIN_NIGHTS_LABELS = ["1 night", "2-3 nights", "4-7 nights", "1-4 weeks", "1+ months"]
    GUEST_TYPE_EDGES = [0, 1, 4, 15, 30, None]
    GUEST_TYPE_LABELS = ["Tourist (1 night)", "Short Stay (2-4 nights)",
                         "Extended Stay (5-15 nights)", "Monthly (16-30 nights)",
                         "Long-term (30+ nights)"]
    SEASON_BY_MONTHS = [("Summer", [12, 1, 2]), ("Fall", [3, 4, 5]), ("Winter", [6, 7, 8]),
                        ("Spring", [9, 10, 11])]
    BEACH_POINTS = [(-22.9711, -43.1823), (-22.9838, -43.2096), (-22.9874, -43.2232),
                    (-23.0107, -43.3015), (-23.0241, -43.4757)]
    COMPETITION_WEIGHTS = (0.4, 0.3, 0.3)
    CORRELATION_FEATURES = ["price", "number_of_reviews", "reviews_per_month", "availability_365",
                            "calculated_host_listings_count", "occupancy_rate", "estimated_revenue"]
    CLUSTER_FEATURES = ["price", "number_of_reviews", "availability_365"]
    CATEGORICAL_SUMMARY_COLUMNS = ["room_type", "neighbourhood_group", "host_category",
                                   "price_category"]
    HISTOGRAM_BINS = 50
    KDE_GRID_POINTS = 100
    SAMPLE_SIZE = 2000
    SAMPLE_SEED = 42


# Parameters of registered queries, written out again.
ADHOC_GROUPS, ADHOC_PATTERN, ADHOC_PRICES = ["AMERICA", "EUROPE"], "nation_1", (50.0, 600.0)
MAP_CELL_DEG, GENERATED_AT = 0.01, "2024-01-01 00:00:00"


def _num(v) -> str:
    return f"{float(v)!r}".replace("e", "E") if "e" in f"{float(v)!r}" else f"{float(v)!r}E0"


def _case_num(col: str, edges, labels, include_lowest=False) -> str:
    parts = []
    for i, lab in enumerate(labels):
        lo, hi = edges[i], edges[i + 1]
        op = ">=" if (include_lowest and i == 0) else ">"
        cond = f"{col} {op} {_num(lo)}"
        if hi is not None:
            cond += f" AND {col} <= {_num(hi)}"
        parts.append(f"WHEN {cond} THEN '{lab}'")
    return "CASE " + " ".join(parts) + " END"


def _dim(name: str, labels) -> str:
    rows = ", ".join(f"({i + 1}, '{lab}')" for i, lab in enumerate(labels))
    return f"(VALUES {rows}) AS d(rank, {name})"


def _hav_expr(lat: float, lon: float) -> str:
    a = (f"(pow(sin(radians({_num(lat)} - latitude) / 2E0), 2) + cos(radians(latitude)) * "
         f"cos(radians({_num(lat)})) * pow(sin(radians({_num(lon)} - longitude) / 2E0), 2))")
    return f"(6371E0 * (2E0 * atan2(sqrt({a}), sqrt(1E0 - {a}))))"


_SEASON = "CASE " + " ".join(
    f"WHEN month(last_review) IN ({', '.join(map(str, ms))}) THEN '{name}'"
    for name, ms in fixed.SEASON_BY_MONTHS) + " END"

_VIEW = """
li AS (
  SELECT l_orderkey, COUNT(*) AS n, SUM(l_quantity) AS q FROM lineitem GROUP BY l_orderkey
),
base AS (
  SELECT o.o_orderkey AS k, o.o_custkey, o.o_orderpriority, o.o_totalprice, o.o_orderdate,
         c.c_name, n.n_name, n.n_nationkey, r.r_name, li.n AS li_n, li.q AS li_q
  FROM orders o
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
  LEFT JOIN li ON o.o_orderkey = li.l_orderkey
),
h AS (
  SELECT *, CASE WHEN k % 5 = 0 THEN 10000000 + k
                 WHEN k % 5 = 1 THEN 20000000 + CAST(FLOOR(k / 15E0) AS BIGINT)
                 WHEN k % 5 = 2 THEN 30000000 + n_nationkey
                 ELSE CAST(o_custkey AS BIGINT) END AS host_id
  FROM base
),
raw AS (
SELECT k AS id,
       CONCAT('Listing ', CAST(k AS VARCHAR(20))) AS name,
       CAST(host_id AS BIGINT) AS host_id,
       c_name AS host_name,
       r_name AS neighbourhood_group,
       n_name AS neighbourhood,
       CAST(-22.95E0 - (k % 100) / 1E3 AS DOUBLE) AS latitude,
       CAST(-43.17E0 - ((k * 7) % 400) / 1E3 AS DOUBLE) AS longitude,
       o_orderpriority AS room_type,
       CAST(o_totalprice / CASE WHEN k % 50 = 0 THEN 32 ELSE 400 END AS DOUBLE) AS price,
       CAST((k * 13) % 45 AS INT) AS minimum_nights,
       CAST(COALESCE(li_q, 0) AS BIGINT) AS number_of_reviews,
       CASE WHEN k % 10 = 0 THEN NULL
            WHEN EXTRACT(YEAR FROM o_orderdate) = 1998 AND EXTRACT(MONTH FROM o_orderdate) IN (6, 7) THEN NULL
            ELSE CAST(o_orderdate AS DATE) END AS last_review,
       CAST(li_n / 4E0 AS DOUBLE) AS reviews_per_month,
       COUNT(*) OVER (PARTITION BY host_id) AS calculated_host_listings_count,
       CAST((k * 37) % 366 AS INT) AS availability_365
FROM h
)"""


def _prefix() -> str:
    dist = "LEAST(" + ", ".join(_hav_expr(a, b) for a, b in fixed.BEACH_POINTS) + ")"
    price_cat = ("CASE WHEN price >= pmin AND price <= q20 THEN 'Budget' "
                 "WHEN price > q20 AND price <= q40 THEN 'Economy' "
                 "WHEN price > q40 AND price <= q60 THEN 'Standard' "
                 "WHEN price > q60 AND price <= q80 THEN 'Premium' "
                 "WHEN price > q80 AND price <= pmax THEN 'Luxury' END")
    return f"""WITH {_VIEW},
clean AS (
  SELECT * FROM raw WHERE price IS NOT NULL AND NOT isnan(price) AND price > 0E0 AND price < 1E4
),
qb AS (
  SELECT min(price) AS pmin, max(price) AS pmax,
         quantile_cont(price, 0.2) AS q20, quantile_cont(price, 0.4) AS q40,
         quantile_cont(price, 0.6) AS q60, quantile_cont(price, 0.8) AS q80,
         quantile_cont(price, 0.85) AS q85, quantile_cont(price, 0.95) AS q95
  FROM clean
),
enr1 AS (
  SELECT id, name, host_id, host_name, neighbourhood_group, neighbourhood, latitude, longitude,
         room_type, price, minimum_nights, number_of_reviews, last_review, reviews_per_month,
         calculated_host_listings_count, availability_365,
         price / (number_of_reviews + 1) AS price_per_review,
         (365 - availability_365) / 365E0 AS occupancy_rate,
         price * (365 - availability_365) AS estimated_revenue,
         {price_cat} AS price_category,
         CAST(month(last_review) AS INTEGER) AS review_month,
         {_SEASON} AS review_season,
         {_case_num('calculated_host_listings_count', fixed.HOST_CATEGORY_EDGES, fixed.HOST_CATEGORY_LABELS)} AS host_category,
         {dist} AS distance_to_beach
  FROM clean, qb
),
enr AS (
  SELECT *,
         {_case_num('distance_to_beach', fixed.BEACH_PROXIMITY_EDGES, fixed.BEACH_PROXIMITY_LABELS)} AS beach_proximity,
         {_case_num('number_of_reviews', fixed.HOST_EXPERIENCE_EDGES, fixed.HOST_EXPERIENCE_LABELS)} AS host_experience
  FROM enr1
),
filt AS (
  SELECT enr.* FROM enr, qb
  WHERE price >= pmin AND price <= q85 AND number_of_reviews >= 0
    AND availability_365 >= 0 AND availability_365 <= 365
),
iqr_q AS (
  SELECT quantile_cont(price, 0.25) AS pq1, quantile_cont(price, 0.75) AS pq3,
         quantile_cont(occupancy_rate, 0.25) AS oq1, quantile_cont(occupancy_rate, 0.75) AS oq3
  FROM filt WHERE price IS NOT NULL AND occupancy_rate IS NOT NULL
),
iqr AS (
  SELECT filt.* FROM filt, iqr_q
  WHERE price IS NOT NULL AND occupancy_rate IS NOT NULL
    AND price >= pq1 - 1.5E0 * (pq3 - pq1) AND price <= pq3 + 1.5E0 * (pq3 - pq1)
    AND occupancy_rate >= GREATEST(0E0, oq1 - 1.5E0 * (oq3 - oq1))
    AND occupancy_rate <= LEAST(1E0, oq3 + 1.5E0 * (oq3 - oq1))
),
reviewed AS (SELECT * FROM iqr WHERE number_of_reviews > 0)"""


_ROUNDED = ("price_per_review", "occupancy_rate", "estimated_revenue", "distance_to_beach")
_LISTING_COLUMNS = (
    "id", "name", "host_id", "host_name", "neighbourhood_group", "neighbourhood", "latitude",
    "longitude", "room_type", "price", "minimum_nights", "number_of_reviews", "last_review",
    "reviews_per_month", "calculated_host_listings_count", "availability_365", "price_per_review",
    "occupancy_rate", "estimated_revenue", "price_category", "review_month", "review_season",
    "host_category", "distance_to_beach", "beach_proximity", "host_experience")


def _kmeans_ctes(features, k: int = 4) -> str:
    """CTEs for k-means as a recursive query, one row of centres per Lloyd step: the
    features on a grid of 2^-20 times the power of two below their deviation, first
    centres at k even ranks of the first feature, at most 300 steps, an end when the
    squared shifts in deviations add up to 1E-4 or less; ``kfin`` has the labels."""
    m = range(len(features))
    x = [f"COALESCE(CAST({f} AS DOUBLE), 0E0)" for f in features]
    scale = ", ".join(f"stddev_pop({x[i]}) AS s{i}" for i in m)
    power = [f"pow(2E0, floor(log2(CASE WHEN s{i} > 0 THEN s{i} ELSE 1E0 END)))" for i in m]
    step = ", ".join(f"CASE WHEN s{i} > 0 THEN {power[i]} / 1048576E0 ELSE 1E0 END AS g{i}, "
                     f"CASE WHEN s{i} > 0 THEN round_even({power[i]} * {power[i]} / (s{i} * s{i}), 6) "
                     f"ELSE 0E0 END AS w{i}" for i in m)
    grid = ", ".join(f"CAST(round_even({x[i]} / g{i}, 0) AS BIGINT) AS z{i}" for i in m)
    cells = [f"c{j}_{i}" for j in range(k) for i in m]
    first = ", ".join(f"max(CASE WHEN j = {j} THEN CAST(z{i} AS DOUBLE) END) AS c{j}_{i}"
                      for j in range(k) for i in m)
    dist = [" + ".join(f"(z{i} - c{j}_{i}) * (z{i} - c{j}_{i}) * w{i}" for i in m) for j in range(k)]
    place = f"list_position([{', '.join(dist)}], list_min([{', '.join(dist)}])) - 1"
    means = ", ".join(f"COALESCE(CAST(sum(z{i}) FILTER (WHERE l = {j}) AS DOUBLE) "
                      f"/ CAST(count(*) FILTER (WHERE l = {j}) AS DOUBLE), c{j}_{i}) AS n{j}_{i}"
                      for j in range(k) for i in m)
    shift = " + ".join(f"(c{j}_{i} - n{j}_{i}) * (c{j}_{i} - n{j}_{i}) * w{i}"
                       for j in range(k) for i in m)
    moved = ", ".join(f"n{j}_{i}" for j in range(k) for i in m)
    held = ", ".join(cells + [f"w{i}" for i in m])
    starts = ", ".join(f"({j})" for j in range(k))
    return (f"ks0 AS (SELECT count(*) AS n, {scale} FROM filt),\n"
            f"ks AS (SELECT n, {step} FROM ks0),\n"
            f"kz AS (SELECT filt.*, {grid}, {', '.join(f'w{i}' for i in m)} FROM filt, ks WHERE ks.n > 10),\n"
            f"kr AS (SELECT z0, row_number() OVER (ORDER BY z0, id) - 1 AS rn FROM kz),\n"
            f"kstart AS (SELECT t.j, min(kz.id) AS id FROM (VALUES {starts}) AS t(j), ks, kr, kz\n"
            f"  WHERE kr.rn = ((2 * t.j + 1) * ks.n) // {2 * k} AND kz.z0 = kr.z0 GROUP BY t.j),\n"
            f"km AS (WITH RECURSIVE it AS (\n"
            f"  SELECT 0 AS step, CAST('Infinity' AS DOUBLE) AS shift, {first}\n"
            f"  FROM kstart JOIN kz ON kz.id = kstart.id\n"
            f"  UNION ALL\n"
            f"  SELECT step + 1, {shift}, {moved} FROM (\n"
            f"    SELECT step, {held}, {means}\n"
            f"    FROM (SELECT it.*, z0, z1, z2, w0, w1, w2, {place} AS l FROM it, kz\n"
            f"          WHERE it.shift > 1E-4 * 1099511627776E0 AND it.step < 300)\n"
            f"    GROUP BY step, {held}))\n"
            f"  SELECT * FROM it ORDER BY step DESC LIMIT 1),\n"
            f"kl AS (SELECT kz.*, {place} AS l FROM kz, km),\n"
            f"kord AS (SELECT l, CAST(row_number() OVER (ORDER BY CAST(sum(z0) AS DOUBLE) / count(*), l) - 1 "
            f"AS INTEGER) AS cluster FROM kl GROUP BY l),\n"
            f"kfin AS (SELECT kl.*, cluster FROM kl JOIN kord ON kl.l = kord.l)")


def _sql(tail: str, ctes: str = "") -> str:
    extra = f",\n{ctes}" if ctes else ""
    return f"{_prefix()}{extra}\n{tail}"


def R(expr: str, d: int = 6) -> str:
    return f"round_even({expr}, {d})"


def _grouped(key: str, labels, aggs: list[tuple[str, str]], medians=(), counts=(),
             source: str = "filt", key_expr: str | None = None, digits: int | None = 2) -> str:
    """R2 grouped summary: label dim LEFT JOIN aggregate."""
    key_expr = key_expr or key
    agg_sel = ", ".join(f"{a} AS {n}" for n, a in aggs)
    med_sel = "".join(f", quantile_cont({c}, 0.5) AS {n}" for n, c in medians)
    src = f"(SELECT *, {key_expr} AS {key}__k FROM {source})" if key_expr != key else source
    kcol = f"{key}__k" if key_expr != key else key
    inner = (f"SELECT {kcol} AS {key}, {agg_sel}{med_sel} FROM {src} "
             f"WHERE {kcol} IS NOT NULL GROUP BY {kcol}")
    names = [n for n, _ in aggs] + [n for n, _ in medians]
    outs = []
    for n in names:
        if n in counts:
            outs.append(f"CAST(COALESCE(g.{n}, 0) AS BIGINT) AS {n}")
        elif digits is not None:
            outs.append(f"round_even(g.{n}, {digits}) AS {n}")
        else:
            outs.append(f"g.{n} AS {n}")
    if labels is None:
        return f"SELECT g.{key} AS {key}, {', '.join(outs)} FROM ({inner}) g"
    return (f"SELECT d.{key} AS {key}, {', '.join(outs)} FROM {_dim(key, labels)} "
            f"LEFT JOIN ({inner}) g ON d.{key} = g.{key} ORDER BY d.rank")


_OCC_BAND = _case_num("occupancy_rate", fixed.OCCUPANCY_BAND_EDGES, fixed.OCCUPANCY_BAND_LABELS)
_PRICE_RANGE = _case_num("price", fixed.PRICE_RANGE_EDGES, fixed.PRICE_RANGE_LABELS)
_NIGHTS = _case_num("minimum_nights", fixed.MIN_NIGHTS_EDGES, fixed.MIN_NIGHTS_LABELS)
_GUEST = _case_num("minimum_nights", fixed.GUEST_TYPE_EDGES, fixed.GUEST_TYPE_LABELS)


def _corr(a: str, b: str) -> str:
    pa = f"CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN {a} END"
    pb = f"CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN {b} END"
    den = f"(stddev_samp({pa}) * stddev_samp({pb}))"
    return f"CASE WHEN {den} = 0 THEN NULL ELSE covar_samp({pa}, {pb}) / {den} END"


def _guest_segments_sql() -> str:
    return _grouped("guest_type", fixed.GUEST_TYPE_LABELS,
                    [("avg_price", "avg(CAST(price AS DECIMAL(28,10)))"), ("avg_revenue", "avg(CAST(estimated_revenue AS DECIMAL(28,10)))"),
                     ("avg_occupancy", "avg(CAST(occupancy_rate AS DECIMAL(28,10)))"),
                     ("avg_reviews", "avg(CAST(number_of_reviews AS DECIMAL(28,10)))"), ("listings", "count(id)")],
                    counts=["listings"], key_expr=_GUEST)


def _argmax(key: str, value: str, labels) -> str:
    rank = "CASE " + " ".join(f"WHEN {key} = '{lab}' THEN {i + 1}"
                              for i, lab in enumerate(labels)) + " END"
    return f"arg_max({key}, struct_pack(v := {value}, r := -({rank}))) FILTER (WHERE {value} IS NOT NULL)"


def _adhoc_where() -> str:
    groups = ", ".join(f"'{g}'" for g in ADHOC_GROUPS)
    return (f"neighbourhood_group IN ({groups}) AND "
            f"regexp_matches(neighbourhood, '(?i){ADHOC_PATTERN}') AND "
            f"price BETWEEN {_num(ADHOC_PRICES[0])} AND {_num(ADHOC_PRICES[1])}")


def _pca_ctes(features) -> str:
    """CTEs for PCA of the standardised features in closed form (symmetric 3 x 3):
    eigenvalues from the trigonometric solution of the characteristic cubic,
    eigenvectors from the largest cross product of two rows of ``A - l I``, signed
    so that the largest absolute component is positive."""
    assert len(features) == 3
    filled = [f"COALESCE(CAST({f} AS DOUBLE), 0E0)" for f in features]
    st = ", ".join(f"avg({c}) AS m{i}, stddev_pop({c}) AS s{i}" for i, c in enumerate(filled))
    zc = ", ".join(f"({c} - m{i}) / CASE WHEN s{i} IS NULL OR s{i} = 0 THEN 1E0 ELSE s{i} END AS z{i}"
                   for i, c in enumerate(filled))
    cov = ", ".join(f"covar_pop(z{i}, z{j}) AS a{i}{j}" for i in range(3) for j in range(i, 3))
    eig = """
      SELECT *, q + 2E0 * p * cos(phi) AS e1, q + 2E0 * p * cos(phi + 2E0 * pi() / 3E0) AS e3,
             3E0 * q - (q + 2E0 * p * cos(phi)) - (q + 2E0 * p * cos(phi + 2E0 * pi() / 3E0)) AS e2
      FROM (SELECT *, CASE WHEN r <= -1E0 THEN pi() / 3E0 WHEN r >= 1E0 THEN 0E0 ELSE acos(r) / 3E0 END AS phi
            FROM (SELECT *, (b00 * (b11 * b22 - b12 * b12) - b01 * (b01 * b22 - b12 * b02)
                             + b02 * (b01 * b12 - b11 * b02)) / 2E0 AS r
                  FROM (SELECT *, (a00 - q) / p AS b00, (a11 - q) / p AS b11, (a22 - q) / p AS b22,
                               a01 / p AS b01, a02 / p AS b02, a12 / p AS b12
                        FROM (SELECT *, sqrt(((a00 - q) * (a00 - q) + (a11 - q) * (a11 - q) + (a22 - q) * (a22 - q)
                                              + 2E0 * (a01 * a01 + a02 * a02 + a12 * a12)) / 6E0) AS p
                              FROM (SELECT *, (a00 + a11 + a22) / 3E0 AS q FROM cov)))))"""

    def vec(lam: str, name: str) -> str:
        r1 = (f"(a00 - {lam})", "a01", "a02")
        r2 = ("a01", f"(a11 - {lam})", "a12")
        r3 = ("a02", "a12", f"(a22 - {lam})")

        def cross(u, v):
            return (f"({u[1]} * {v[2]} - {u[2]} * {v[1]})", f"({u[2]} * {v[0]} - {u[0]} * {v[2]})",
                    f"({u[0]} * {v[1]} - {u[1]} * {v[0]})")
        cands = [cross(r1, r2), cross(r1, r3), cross(r2, r3)]
        norms = [f"({c[0]} * {c[0]} + {c[1]} * {c[1]} + {c[2]} * {c[2]})" for c in cands]
        pick = []
        for k in range(3):
            pick.append(f"CASE WHEN {norms[0]} >= {norms[1]} AND {norms[0]} >= {norms[2]} THEN {cands[0][k]} "
                        f"WHEN {norms[1]} >= {norms[2]} THEN {cands[1][k]} ELSE {cands[2][k]} END")
        return ", ".join(f"{pick[k]} AS {name}_r{k}" for k in range(3))

    unit = []
    for v in ("v1", "v2"):
        n = f"sqrt({v}_r0 * {v}_r0 + {v}_r1 * {v}_r1 + {v}_r2 * {v}_r2)"
        unit.append(", ".join(f"{v}_r{k} / {n} AS {v}_u{k}" for k in range(3)))
    signed = []
    for v in ("v1", "v2"):
        big = (f"CASE WHEN abs({v}_u0) >= abs({v}_u1) AND abs({v}_u0) >= abs({v}_u2) THEN {v}_u0 "
               f"WHEN abs({v}_u1) >= abs({v}_u2) THEN {v}_u1 ELSE {v}_u2 END")
        signed.append(", ".join(f"CASE WHEN {big} < 0 THEN -{v}_u{k} ELSE {v}_u{k} END AS {v}_{k}"
                                for k in range(3)))
    return (f"pst AS (SELECT {st} FROM filt),\n"
            f"pz AS (SELECT id, {zc} FROM filt, pst),\n"
            f"cov AS (SELECT {cov} FROM pz),\n"
            f"eig AS ({eig}),\n"
            f"vr AS (SELECT *, {vec('e1', 'v1')}, {vec('e2', 'v2')} FROM eig),\n"
            f"vu AS (SELECT *, {unit[0]}, {unit[1]} FROM vr),\n"
            f"pca AS (SELECT *, {signed[0]}, {signed[1]} FROM vu)")


def _lowess_sql(points: int = 50, frac: float = 0.3, iterations: int = 3) -> tuple[str, str]:
    """LOWESS on an even grid in SQL: radius = k-th smallest distance per grid
    point (``row_number``), tricube-weighted local line, then robust rounds with
    residuals interpolated between grid points and bisquare weights from
    ``6 * median(|residual|)``.  Returns ``(ctes, final_select)``."""
    last = points - 1
    ctes = [f"""lw AS (SELECT CAST(price AS DOUBLE) AS x, CAST(number_of_reviews AS DOUBLE) AS y
                      FROM reviewed WHERE price IS NOT NULL AND number_of_reviews IS NOT NULL)""",
            f"""lp AS (SELECT count(*) AS n, min(x) AS mn, max(x) AS mx,
                              (max(x) - min(x)) / {last}E0 AS step,
                              CAST(floor({frac!r}E0 * count(*) + 1E-10) AS BIGINT) AS k FROM lw)""",
            f"""lg AS (SELECT t.i AS point, CASE WHEN t.i = {last} THEN mx ELSE mn + t.i * step END AS g
                      FROM lp, generate_series(0, {last}) t(i) WHERE lp.n > 30)""",
            """ld AS (SELECT lg.point, lg.g, lw.x, lw.y, abs(lw.x - lg.g) AS d FROM lg, lw)""",
            """lr AS (SELECT point, d AS r FROM (
                      SELECT point, d, row_number() OVER (PARTITION BY point ORDER BY d) AS rn FROM ld) s, lp
                    WHERE rn = GREATEST(lp.k, 1))""",
            """lt AS (SELECT ld.*, CASE WHEN lr.r > 0 THEN ld.d / lr.r WHEN ld.d = 0 THEN 0E0 END AS u
                    FROM ld JOIN lr USING (point))"""]

    def fit(name: str, robust: str) -> str:
        w = f"(CASE WHEN u < 1 THEN pow(1E0 - pow(u, 3), 3) ELSE 0E0 END * {robust})"
        return f"""{name} AS (
          SELECT point, g, CASE WHEN sw > 0 THEN yb + slope * (g - xb) END AS fitted FROM (
            SELECT *, CASE WHEN abs(swxx - sw * xb * xb) > 1E-12 * swxx
                           THEN (swxy - sw * xb * yb) / (swxx - sw * xb * xb) ELSE 0E0 END AS slope
            FROM (SELECT *, swx / sw AS xb, swy / sw AS yb FROM (
              SELECT point, g, sum(w) AS sw, sum(w * x) AS swx, sum(w * y) AS swy,
                     sum(w * x * x) AS swxx, sum(w * x * y) AS swxy
              FROM (SELECT point, g, x, y, {w} AS w FROM lt{'' if robust == '1E0' else ' JOIN ' + robust.split('.')[0] + '_rw ' + robust.split('.')[0] + ' USING (x, y)'})
              GROUP BY point, g))))"""

    ctes.append(fit("lf0", "1E0"))
    prev = "lf0"
    for it in range(1, iterations + 1):
        res = f"lres{it}"
        ctes.append(f"""{res} AS (
          SELECT lw.x, lw.y, lw.y - (f0.fitted + (f1.fitted - f0.fitted) * (lw.x - (lp.mn + j.j * lp.step)) / lp.step) AS res
          FROM lw, lp,
               LATERAL (SELECT CAST(LEAST(GREATEST(floor((lw.x - lp.mn) / lp.step), 0), {last - 1}) AS BIGINT) AS j) j
          JOIN {prev} f0 ON f0.point = j.j JOIN {prev} f1 ON f1.point = j.j + 1)""")
        ctes.append(f"""lm{it} AS (SELECT quantile_cont(abs(res), 0.5) AS mad FROM {res})""")
        ctes.append(f"""lq{it}_rw AS (SELECT DISTINCT x, y, CASE WHEN abs(res / (6E0 * mad)) < 1
                                   THEN pow(1E0 - (res / (6E0 * mad)) * (res / (6E0 * mad)), 2) ELSE 0E0 END AS rw
                                   FROM {res}, lm{it})""")
        ctes.append(fit(f"lf{it}", f"lq{it}.rw"))
        prev = f"lf{it}"
    final = (f"SELECT CAST(point AS INTEGER) AS point, round_even(g, 6) AS x, "
             f"round_even(fitted, 6) AS fitted FROM {prev}")
    return ",\n".join(ctes), final


# xxHash64 (public algorithm) as Spark evaluates ``xxhash64(long_col, int_literal)``
# with its fixed seed 42: hash the long, then the int with the first result as seed.
_XX_PRIMES = (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9,
              0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)
_TWO64 = "18446744073709551616::UHUGEINT"


def _xx_mul(a: str, b) -> str:
    return f"CAST((CAST({a} AS UHUGEINT) * CAST({b} AS UHUGEINT)) % {_TWO64} AS UBIGINT)"


def _xx_add(a: str, b) -> str:
    return f"CAST((CAST({a} AS UHUGEINT) + CAST({b} AS UHUGEINT)) % {_TWO64} AS UBIGINT)"


def _xx_rotl(a: str, r: int) -> str:
    return f"({_xx_mul(a, 1 << r)} | ({a} >> {64 - r}))"


def _xxhash64_sql(col: str, int_seed: int, seed: int = 42) -> list[str]:
    """Select-list items (lateral aliases) ending in ``_xx``, Spark's signed hash."""
    p1, p2, p3, p4, p5 = _XX_PRIMES
    m = (1 << 64) - 1
    items = [
        f"CAST(((CAST({col} AS HUGEINT) % {_TWO64}::HUGEINT) + {_TWO64}::HUGEINT) % {_TWO64}::HUGEINT AS UBIGINT) AS _v",
        f"xor({(seed + p5 + 8) & m}::UBIGINT, {_xx_mul(_xx_rotl(_xx_mul('_v', p2), 31), p1)}) AS _h1",
        f"{_xx_add(_xx_mul(_xx_rotl('_h1', 27), p1), p4)} AS _h2",
    ]

    def fmix(src: str, tag: str) -> list[str]:
        return [f"xor({src}, {src} >> 33) AS {tag}a", f"{_xx_mul(tag + 'a', p2)} AS {tag}b",
                f"xor({tag}b, {tag}b >> 29) AS {tag}c", f"{_xx_mul(tag + 'c', p3)} AS {tag}d",
                f"xor({tag}d, {tag}d >> 32) AS {tag}e"]
    items += fmix("_h2", "_f")
    items += [
        f"{_xx_add('_fe', p5 + 4)} AS _g0",
        f"xor(_g0, {((int_seed & 0xFFFFFFFF) * p1) & m}::UBIGINT) AS _g1",
        f"{_xx_add(_xx_mul(_xx_rotl('_g1', 23), p2), p3)} AS _g2",
    ]
    items += fmix("_g2", "_k")
    items.append(f"CAST(CASE WHEN _ke >= 9223372036854775808::UBIGINT "
                 f"THEN CAST(_ke AS HUGEINT) - {_TWO64}::HUGEINT ELSE CAST(_ke AS HUGEINT) END AS BIGINT) AS _xx")
    return items


def oracle_queries() -> dict[str, str]:
    q: dict[str, str] = {}
    q["listings_view"] = f"WITH {_VIEW} SELECT * FROM raw"
    q["scan_listings"] = (
        f"WITH {_VIEW} SELECT * REPLACE (CAST(replace(format('{{:,.2f}}', price), ',', '') "
        f"AS DOUBLE) AS price) FROM raw")
    q["scan_listings_split"] = (
        f"WITH {_VIEW} SELECT * REPLACE (CASE WHEN id % 3 = 0 THEN "
        "name || chr(10) || '\"sea, view\"' || chr(10) || id ELSE name END AS name) FROM raw")
    q["parse_price"] = _sql(
        "SELECT id, price_text, CAST(replace(replace(price_text, '$', ''), ',', '') AS DOUBLE) "
        "AS parsed_price FROM (SELECT id, '$' || format('{:,.2f}', price) AS price_text FROM enr)")
    q["clean_listings"] = _sql(
        "SELECT id, host_id, price, last_review, calculated_host_listings_count FROM enr")
    q["enrich_basic"] = _sql(
        f"SELECT id, {R('price_per_review')} AS price_per_review, {R('occupancy_rate')} AS "
        f"occupancy_rate, {R('estimated_revenue')} AS estimated_revenue FROM enr")
    q["enrich_season"] = _sql("SELECT id, last_review, review_month, review_season FROM enr")
    q["distance_to_poi"] = _sql(f"SELECT id, {R('distance_to_beach')} AS distance_to_beach FROM enr")
    q["nearest_poi"] = _sql(
        f"SELECT id, nearest_poi, {R('km')} AS distance_km FROM ("
        "SELECT id, arg_min(poi_id, (km, poi_id)) AS nearest_poi, min(km) AS km FROM ("
        f"SELECT id, poi_id, {R('6371E0 * (2E0 * atan2(sqrt(a), sqrt(1E0 - a)))')} AS km FROM ("
        "SELECT e.id, p.poi_id, pow(sin(radians(p.plat - latitude) / 2E0), 2) "
        "+ cos(radians(latitude)) * cos(radians(p.plat)) "
        "* pow(sin(radians(p.plon - longitude) / 2E0), 2) AS a "
        "FROM enr e, (SELECT c_custkey AS poi_id, -22.91E0 - ((c_custkey * 37) % 1901) / 1E4 AS plat, "
        "-43.11E0 - ((c_custkey * 101) % 5407) / 1E4 AS plon FROM customer) p)) GROUP BY id)")
    q["price_quintile"] = _sql("SELECT id, price, price_category FROM enr")
    q["host_category"] = _sql("SELECT id, calculated_host_listings_count, host_category FROM enr")
    q["poi_proximity"] = _sql("SELECT id, beach_proximity FROM enr")
    q["host_experience"] = _sql("SELECT id, number_of_reviews, host_experience FROM enr")
    q["map_points"] = _sql(
        "SELECT id, latitude, longitude, name, price, room_type, price_category, "
        "number_of_reviews FROM filt")
    cell = _num(MAP_CELL_DEG)
    q["map_density"] = _sql(
        f"SELECT CAST(floor(latitude / {cell}) AS BIGINT) AS cell_lat, "
        f"CAST(floor(longitude / {cell}) AS BIGINT) AS cell_lon, count(*) AS listings, "
        f"{R('avg(CAST(price AS DECIMAL(28,10)))')} AS avg_price FROM filt "
        f"WHERE latitude IS NOT NULL AND longitude IS NOT NULL GROUP BY 1, 2")

    q["filter_listings"] = _sql("SELECT id, price, host_category FROM filt")
    q["default_price_band"] = _sql(
        f"SELECT {R('pmin')} AS price_min, {R('q85')} AS price_default_max, "
        f"{R('q95')} AS price_slider_max FROM qb")
    q["iqr_clean"] = _sql(f"SELECT id, price, {R('occupancy_rate')} AS occupancy_rate FROM iqr")
    q["value_domain"] = _sql(
        "SELECT DISTINCT 'neighbourhood_group' AS \"column\", neighbourhood_group AS value FROM enr "
        "UNION ALL SELECT DISTINCT 'room_type', room_type FROM enr "
        "UNION ALL SELECT DISTINCT 'host_category', host_category FROM enr")
    q["adhoc_filter"] = _sql(
        f"SELECT id, neighbourhood_group, neighbourhood, price FROM filt WHERE {_adhoc_where()}")
    q["adhoc_dates"] = _sql(
        "SELECT id, room_type, last_review FROM filt WHERE last_review BETWEEN DATE '1994-03-01' "
        "AND DATE '1995-02-28' AND room_type IN ('1-URGENT', '3-MEDIUM')")
    q["explorer_kpis"] = _sql(
        f"SELECT count(*) AS listings, round_even(avg(CAST(price AS DECIMAL(28,10))), 2) AS avg_price, "
        f"round_even(CAST(sum(CAST(estimated_revenue AS DECIMAL(28,10))) AS DOUBLE), 2) AS total_revenue FROM filt WHERE {_adhoc_where()}")

    q["kpi_summary"] = _sql(
        """SELECT f.n AS total_listings,
                  round_even(f.n * 100E0 / b.n, 2) AS share_of_total_pct,
                  round_even(f.p, 2) AS avg_price,
                  round_even((f.p / b.p - 1) * 100, 2) AS price_diff_pct,
                  round_even(f.o * 100, 2) AS avg_occupancy_pct,
                  round_even(f.o * 100 - b.o * 100, 2) AS occupancy_diff_pp,
                  f.h AS active_hosts,
                  round_even(f.h * 100E0 / b.h, 2) AS hosts_share_pct
           FROM (SELECT count(*) n, avg(CAST(price AS DECIMAL(28,10))) p, avg(CAST(occupancy_rate AS DECIMAL(28,10))) o, count(DISTINCT host_id) h FROM filt) f,
                (SELECT count(*) n, avg(CAST(price AS DECIMAL(28,10))) p, avg(CAST(occupancy_rate AS DECIMAL(28,10))) o, count(DISTINCT host_id) h FROM enr) b""")
    q["price_by_room"] = _sql(_grouped(
        "room_type", None, [("mean_price", "avg(CAST(price AS DECIMAL(28,10)))"), ("std_price", "stddev_samp(price)"),
                            ("listings", "count(price)")],
        medians=[("median_price", "price")], counts=["listings"]))
    q["box_by_room"] = _sql(
        f"""SELECT room_type, {R('q1')} AS q1, {R('median')} AS median, {R('q3')} AS q3,
                   {R('lower_whisker')} AS lower_whisker, {R('upper_whisker')} AS upper_whisker,
                   outliers, listings FROM (
             SELECT f.room_type, any_value(q1) q1, any_value(median) median, any_value(q3) q3,
                    min(CASE WHEN price >= q1 - 1.5E0 * (q3 - q1) AND price <= q3 + 1.5E0 * (q3 - q1) THEN price END) AS lower_whisker,
                    max(CASE WHEN price >= q1 - 1.5E0 * (q3 - q1) AND price <= q3 + 1.5E0 * (q3 - q1) THEN price END) AS upper_whisker,
                    count(CASE WHEN NOT (price >= q1 - 1.5E0 * (q3 - q1) AND price <= q3 + 1.5E0 * (q3 - q1)) THEN 1 END) AS outliers,
                    count(*) AS listings
             FROM filt f JOIN qr ON f.room_type = qr.room_type
             WHERE f.price IS NOT NULL GROUP BY f.room_type)""",
        ctes="""qr AS (SELECT room_type, quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.5) AS median,
                        quantile_cont(price, 0.75) AS q3 FROM filt
                 WHERE room_type IS NOT NULL AND price IS NOT NULL GROUP BY room_type)""")
    q["box_outliers"] = _sql(
        """SELECT f.room_type, f.id, f.price FROM enr f JOIN qr ON f.room_type = qr.room_type
           WHERE f.price < q1 - 1.5E0 * (q3 - q1) OR f.price > q3 + 1.5E0 * (q3 - q1)""",
        ctes="""qr AS (SELECT room_type, quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.75) AS q3
                 FROM enr WHERE room_type IS NOT NULL AND price IS NOT NULL GROUP BY room_type)""")
    q["monthly_price_by_room"] = _sql(
        f"SELECT last_day(last_review) AS month, room_type, {R('avg(CAST(price AS DECIMAL(28,10)))')} AS avg_price FROM filt "
        "WHERE last_review IS NOT NULL AND room_type IS NOT NULL GROUP BY 1, 2")
    q["price_by_proximity"] = _sql(_grouped(
        "beach_proximity", fixed.BEACH_PROXIMITY_LABELS,
        [("mean_price", "avg(CAST(price AS DECIMAL(28,10)))"), ("listings", "count(price)")],
        medians=[("median_price", "price")], counts=["listings"]))
    q["count_by_proximity"] = _sql(_grouped(
        "beach_proximity", fixed.BEACH_PROXIMITY_LABELS, [("listings", "count(*)")],
        counts=["listings"]))
    q["map_centre"] = _sql(f"SELECT {R('avg(CAST(latitude AS DECIMAL(28,10)))')} AS centre_lat, "
                           f"{R('avg(CAST(longitude AS DECIMAL(28,10)))')} AS centre_lon FROM filt")
    q["top_neighbourhoods"] = _sql(
        "SELECT neighbourhood, count(*) AS listings FROM filt WHERE neighbourhood IS NOT NULL "
        "GROUP BY 1 ORDER BY listings DESC, neighbourhood LIMIT 10")
    q["priciest_neighbourhoods"] = _sql(
        f"SELECT neighbourhood, {R('p')} AS avg_price FROM (SELECT neighbourhood, avg(CAST(price AS DECIMAL(28,10))) p "
        "FROM filt WHERE neighbourhood IS NOT NULL GROUP BY 1 ORDER BY p DESC NULLS LAST, "
        "neighbourhood LIMIT 10)")
    q["review_activity"] = _sql(
        """SELECT neighbourhood, round_even(a, 2) AS avg_reviews, CAST(s AS BIGINT) AS total_reviews,
                  c AS listings, round_even(r, 2) AS reviews_per_month FROM (
             SELECT neighbourhood, avg(CAST(number_of_reviews AS DECIMAL(28,10))) a, sum(number_of_reviews) s,
                    count(number_of_reviews) c, avg(CAST(reviews_per_month AS DECIMAL(28,10))) r
             FROM filt WHERE neighbourhood IS NOT NULL GROUP BY 1
             ORDER BY s DESC, neighbourhood LIMIT 15)""")
    q["room_mix"] = _sql(
        """SELECT t.neighbourhood, rt.room_type, CAST(COALESCE(c.n, 0) AS BIGINT) AS listings,
                  round_even(COALESCE(c.n, 0) * 100E0 / tot.n, 2) AS pct
           FROM top10 t CROSS JOIN rt
           LEFT JOIN cnt c ON c.neighbourhood = t.neighbourhood AND c.room_type = rt.room_type
           JOIN (SELECT neighbourhood, sum(n) AS n FROM cnt GROUP BY 1) tot ON tot.neighbourhood = t.neighbourhood""",
        ctes="""top10 AS (SELECT neighbourhood FROM filt WHERE neighbourhood IS NOT NULL
                  GROUP BY 1 ORDER BY count(*) DESC, neighbourhood LIMIT 10),
           sub AS (SELECT * FROM filt WHERE room_type IS NOT NULL AND neighbourhood IN (SELECT neighbourhood FROM top10)),
           rt AS (SELECT DISTINCT room_type FROM sub),
           cnt AS (SELECT neighbourhood, room_type, count(*) AS n FROM sub GROUP BY 1, 2)""")
    q["revenue_by_room"] = _sql(_grouped(
        "room_type", None, [("avg_revenue", "avg(CAST(estimated_revenue AS DECIMAL(28,10)))"),
                            ("avg_occupancy", "avg(CAST(occupancy_rate AS DECIMAL(28,10)))"), ("avg_price", "avg(CAST(price AS DECIMAL(28,10)))")],
        digits=6))
    q["host_portfolio"] = _sql(_grouped(
        "host_category", fixed.HOST_CATEGORY_LABELS,
        [("avg_price", "avg(CAST(price AS DECIMAL(28,10)))"), ("avg_revenue", "avg(CAST(estimated_revenue AS DECIMAL(28,10)))"),
         ("avg_occupancy", "avg(CAST(occupancy_rate AS DECIMAL(28,10)))"), ("listings", "count(host_id)")],
        counts=["listings"], digits=6))
    feats = fixed.CORRELATION_FEATURES
    unions = []
    for a in feats:
        for b in feats:
            unions.append(f"SELECT '{a}' AS feature_x, '{b}' AS feature_y, {R(_corr(a, b))} AS r FROM filt")
    q["corr_matrix"] = _sql(" UNION ALL ".join(unions))

    q["price_by_occupancy"] = _sql(_grouped(
        "occupancy_band", fixed.OCCUPANCY_BAND_LABELS,
        [("mean_price", "avg(CAST(price AS DECIMAL(28,10)))"), ("listings", "count(price)")],
        medians=[("median_price", "price")], counts=["listings"], source="iqr",
        key_expr=_OCC_BAND))
    rbp = _grouped("price_range", fixed.PRICE_RANGE_LABELS,
                   [("avg_reviews", "avg(CAST(number_of_reviews AS DECIMAL(28,10)))"),
                    ("avg_reviews_per_month", "avg(CAST(reviews_per_month AS DECIMAL(28,10)))"),
                    ("avg_occupancy", "avg(CAST(occupancy_rate AS DECIMAL(28,10)))")],
                   source="reviewed", key_expr=_PRICE_RANGE)
    q["reviews_by_price_range"] = _sql(rbp)
    q["price_review_corr"] = _sql(
        f"SELECT {R(_corr('price', 'number_of_reviews'))} AS r_price_reviews, "
        f"{R(_corr('price', 'reviews_per_month'))} AS r_price_reviews_per_month FROM reviewed")
    q["sweet_spot"] = _sql(
        f"SELECT {_argmax('price_range', 'avg_reviews', fixed.PRICE_RANGE_LABELS)} AS sweet_spot FROM rbp",
        ctes=f"rbp AS ({rbp})")
    exp = _grouped("host_experience", fixed.HOST_EXPERIENCE_LABELS,
                   [("avg_occupancy", "avg(CAST(occupancy_rate AS DECIMAL(28,10)))"), ("avg_price", "avg(CAST(price AS DECIMAL(28,10)))"),
                    ("avg_revenue", "avg(CAST(estimated_revenue AS DECIMAL(28,10)))"),
                    ("listings", "count(number_of_reviews)")], counts=["listings"])
    q["experience_performance"] = _sql(
        "SELECT *, round_even(avg_occupancy * 100, 2) AS occupancy_pct FROM e", ctes=f"e AS ({exp})")

    q["min_nights_hist"] = _sql(
        "SELECT minimum_nights, count(*) AS listings FROM filt WHERE minimum_nights IS NOT NULL "
        "GROUP BY 1 ORDER BY 1")
    q["min_nights_dist"] = _sql(_grouped(
        "nights_category", fixed.MIN_NIGHTS_LABELS, [("listings", "count(*)")],
        counts=["listings"], key_expr=_NIGHTS))
    q["price_by_min_nights"] = _sql(_grouped(
        "nights_category", fixed.MIN_NIGHTS_LABELS,
        [("mean_price", "avg(CAST(price AS DECIMAL(28,10)))"), ("listings", "count(price)"),
         ("avg_occupancy", "avg(CAST(occupancy_rate AS DECIMAL(28,10)))"), ("avg_revenue", "avg(CAST(estimated_revenue AS DECIMAL(28,10)))")],
        medians=[("median_price", "price")], counts=["listings"], key_expr=_NIGHTS))
    seg = _guest_segments_sql()
    q["guest_segments"] = _sql(seg)
    q["segment_display"] = _sql(
        """SELECT guest_type,
                  CASE WHEN avg_price IS NOT NULL THEN '$' || format('{:.2f}', avg_price) END AS avg_price,
                  CASE WHEN avg_revenue IS NOT NULL THEN '$' || format('{:,.0f}', round_even(avg_revenue, 0)) END AS avg_revenue,
                  CASE WHEN avg_occupancy IS NOT NULL THEN format('{:.1f}', round_even(avg_occupancy * 100, 1)) || '%' END AS avg_occupancy,
                  listings FROM seg""", ctes=f"seg AS ({seg})")
    labels = fixed.GUEST_TYPE_LABELS
    q["segment_winners"] = _sql(
        f"SELECT {_argmax('guest_type', 'avg_revenue', labels)} AS highest_revenue, "
        f"{_argmax('guest_type', 'avg_occupancy', labels)} AS best_occupancy, "
        f"{_argmax('guest_type', 'listings', labels)} AS largest_market FROM seg",
        ctes=f"seg AS ({seg})")
    q["market_share"] = _sql(
        "SELECT guest_type, CASE WHEN sum(listings) OVER () = 0 THEN NULL ELSE "
        "round_even(listings * 100E0 / sum(listings) OVER (), 1) END AS share_pct FROM seg",
        ctes=f"seg AS ({seg})")

    num_cols = ["id", "host_id", "latitude", "longitude", "price", "minimum_nights",
                "number_of_reviews", "reviews_per_month", "calculated_host_listings_count",
                "availability_365", "price_per_review", "occupancy_rate", "estimated_revenue",
                "review_month", "distance_to_beach"]
    parts = []
    for c in num_cols:
        v = f"CAST({c} AS DOUBLE)"
        parts.append(
            f"SELECT '{c}' AS \"column\", count({v}) AS count, round_even(avg({v}), 2) AS mean, "
            f"round_even(stddev_samp({v}), 2) AS std, round_even(min({v}), 2) AS min, "
            f"round_even(quantile_cont({v}, 0.25), 2) AS p25, round_even(quantile_cont({v}, 0.5), 2) AS p50, "
            f"round_even(quantile_cont({v}, 0.75), 2) AS p75, round_even(max({v}), 2) AS max FROM filt")
    q["describe_numeric"] = _sql(" UNION ALL ".join(parts))

    cat_parts = []
    for c in fixed.CATEGORICAL_SUMMARY_COLUMNS:
        if c == "host_category":
            dim, rank = _dim("value", fixed.HOST_CATEGORY_LABELS), "d.rank"
        elif c == "price_category":
            dim, rank = _dim("value", fixed.PRICE_CATEGORY_LABELS), "d.rank"
        else:
            dim, rank = None, "NULL"
        cnt = f"(SELECT {c} AS value, count(*) AS n FROM filt WHERE {c} IS NOT NULL GROUP BY 1)"
        if dim:
            src = (f"SELECT COALESCE(g.value, d.value) AS value, COALESCE(g.n, 0) AS n, {rank} AS rank "
                   f"FROM {cnt} g FULL OUTER JOIN {dim} ON g.value = d.value")
        else:
            src = f"SELECT value, n, CAST(NULL AS INTEGER) AS rank FROM {cnt} g"
        cat_parts.append(
            f"SELECT '{c}' AS \"column\", value, CAST(n AS BIGINT) AS listings, "
            f"round_even(n * 100E0 / (SELECT count(*) FROM filt), 2) AS pct, "
            f"CAST(row_number() OVER (ORDER BY n DESC, rank ASC NULLS LAST, value) AS INTEGER) AS position "
            f"FROM ({src}) QUALIFY position <= 5")
    q["categorical_top5"] = _sql(" UNION ALL ".join(f"({p})" for p in cat_parts))

    q["monthly_metrics"] = _sql(
        f"""SELECT m.month, {R('a.p')} AS avg_price, CAST(COALESCE(a.c, 0) AS BIGINT) AS listings,
                   {R('a.v')} AS avg_availability
            FROM (SELECT last_day(CAST(g AS DATE)) AS month FROM span,
                  generate_series(date_trunc('month', lo), date_trunc('month', hi), INTERVAL 1 MONTH) t(g)) m
            LEFT JOIN agg a ON a.month = m.month ORDER BY m.month""",
        ctes="""agg AS (SELECT last_day(last_review) AS month, avg(CAST(price AS DECIMAL(28,10))) p, count(number_of_reviews) c,
                               avg(CAST(availability_365 AS DECIMAL(28,10))) v FROM filt WHERE last_review IS NOT NULL GROUP BY 1),
                span AS (SELECT min(month) lo, max(month) hi FROM agg)""")
    q["price_ranges_by_room"] = _sql(
        f"SELECT room_type, {R('p25')} AS p25, {R('p50')} AS p50, {R('p75')} AS p75, "
        f"{R('p25 * 0.9E0')} AS lower_fence, {R('p75 * 1.1E0')} AS upper_fence FROM ("
        "SELECT room_type, quantile_cont(price, 0.25) p25, quantile_cont(price, 0.5) p50, "
        "quantile_cont(price, 0.75) p75 FROM filt WHERE room_type IS NOT NULL AND price IS NOT NULL "
        "GROUP BY 1)")
    w1, w2, w3 = fixed.COMPETITION_WEIGHTS
    q["competition_top10"] = _sql(
        f"""SELECT *, round_even(listings * {_num(w1)} + 1E0 / (price_std + 1E0) * 100E0 * {_num(w2)}
                                 + avg_occupancy * 100E0 * {_num(w3)}, 2) AS competition_score
            FROM (SELECT neighbourhood, round_even(avg(CAST(price AS DECIMAL(28,10))), 2) AS avg_price,
                         round_even(stddev_samp(price), 2) AS price_std, count(price) AS listings,
                         round_even(avg(CAST(occupancy_rate AS DECIMAL(28,10))), 2) AS avg_occupancy,
                         round_even(avg(CAST(number_of_reviews AS DECIMAL(28,10))), 2) AS avg_reviews
                  FROM filt WHERE neighbourhood IS NOT NULL GROUP BY 1)
            ORDER BY competition_score DESC NULLS LAST, neighbourhood LIMIT 10""")
    q["top_efficiency"] = _sql(
        """SELECT id, name, round_even(price, 2) AS price, round_even(occupancy_rate, 2) AS occupancy_rate,
                  round_even(eff, 2) AS revenue_efficiency FROM (
             SELECT *, CASE WHEN price = 0 THEN NULL ELSE estimated_revenue / price END AS eff FROM filt)
           ORDER BY eff DESC NULLS LAST, id LIMIT 20""")
    q["filter_summary"] = _sql(
        """SELECT * FROM (VALUES
             (1, 'Total Listings', format('{:,}', (SELECT count(*) FROM filt)) || ' / ' || format('{:,}', (SELECT count(*) FROM enr))),
             (2, 'Neighborhood Group', 'All'),
             (3, 'Room Type', 'All'),
             (4, 'Price Range', (SELECT '$' || format('{:.0f}', pmin) || ' - $' || format('{:.0f}', q85) FROM qb)),
             (5, 'Min Reviews', '0'),
             (6, 'Availability Range', '(0, 365)')) AS t(position, label, value)""")
    q["export_summary"] = _sql(
        f"""SELECT * FROM (VALUES
             (1, 'Total Listings', (SELECT CAST(count(*) AS VARCHAR) FROM filt)),
             (2, 'Average Price', (SELECT '$' || format('{{:.2f}}', round_even(avg(CAST(price AS DECIMAL(28,10))), 2)) FROM filt)),
             (3, 'Total Revenue', (SELECT '$' || format('{{:,.0f}}', round_even(CAST(sum(CAST(estimated_revenue AS DECIMAL(28,10))) AS DOUBLE), 0)) FROM filt)),
             (4, 'Average Occupancy', (SELECT format('{{:.1f}}', round_even(avg(CAST(occupancy_rate AS DECIMAL(28,10))) * 100, 1)) || '%' FROM filt)),
             (5, 'Date Generated', '{GENERATED_AT}')) AS t(position, metric, value)""")
    q["export_stats"] = _sql(
        "SELECT count(*) AS rows, 26 AS columns, min(last_review) AS first_review, "
        "max(last_review) AS last_review FROM filt")
    prof_cols = [("id", "bigint"), ("name", "string"), ("host_id", "bigint"),
                 ("host_name", "string"), ("neighbourhood_group", "string"),
                 ("neighbourhood", "string"), ("latitude", "double"), ("longitude", "double"),
                 ("room_type", "string"), ("price", "double"), ("minimum_nights", "int"),
                 ("number_of_reviews", "bigint"), ("last_review", "date"),
                 ("reviews_per_month", "double"), ("calculated_host_listings_count", "bigint"),
                 ("availability_365", "int"), ("price_per_review", "double"),
                 ("occupancy_rate", "double"), ("estimated_revenue", "double"),
                 ("price_category", "string"), ("review_month", "int"),
                 ("review_season", "string"), ("host_category", "string"),
                 ("distance_to_beach", "double"), ("beach_proximity", "string"),
                 ("host_experience", "string")]
    prof = []
    for i, (c, t) in enumerate(prof_cols):
        prof.append(f"SELECT {i + 1} AS position, '{c}' AS \"column\", '{t}' AS type, count({c}) AS non_null, "
                    f"CASE WHEN count(*) = 0 THEN NULL ELSE round_even((count(*) - count({c})) * 100E0 / count(*), 2) END "
                    f"AS null_pct FROM filt")
    q["column_profile"] = _sql(" UNION ALL ".join(prof))
    q["filter_custom"] = _sql(
        "SELECT id, neighbourhood_group, room_type, price, number_of_reviews, availability_365, "
        "host_category FROM enr WHERE neighbourhood_group = 'ASIA' AND room_type = '1-URGENT' "
        "AND price >= 50E0 AND price <= 500E0 AND number_of_reviews >= 10 "
        "AND availability_365 >= 30 AND availability_365 <= 300 "
        "AND host_category IN ('Small Portfolio', 'Medium Portfolio')")
    derived = ("price_per_review", "occupancy_rate", "estimated_revenue", "distance_to_beach")
    export_sel = "SELECT " + ", ".join(f"{R(c)} AS {c}" if c in derived else c
                                       for c, _ in prof_cols) + " FROM filt"
    q["export_csv"] = _sql(export_sel)
    q["export_json"] = _sql(export_sel)
    q["export_listings"] = _sql(export_sel)
    q["export_bundle"] = q["export_summary"]
    q["preview"] = _sql(export_sel + " ORDER BY id LIMIT 10")

    nb = fixed.HISTOGRAM_BINS
    q["price_histogram"] = _sql(
        f"""SELECT CAST(t.g AS INTEGER) AS bin, round_even(mn + (t.g - 1) * ((mx - mn) / {nb}E0), 6) AS lo,
                   round_even(mn + t.g * ((mx - mn) / {nb}E0), 6) AS hi,
                   CAST(COALESCE(c.n, 0) AS BIGINT) AS listings
            FROM s, generate_series(1, {nb}) t(g) LEFT JOIN c ON c.bin = t.g
            WHERE s.n > 0 ORDER BY 1""",
        ctes=f"""s AS (SELECT count(price) n, min(price) mn, max(price) mx FROM filt),
                c AS (SELECT CASE WHEN mx > mn THEN LEAST(CAST(floor((price - mn) / (mx - mn) * {nb}E0) AS BIGINT) + 1, {nb})
                                  ELSE 1 END AS bin, count(*) AS n
                      FROM filt, s WHERE price IS NOT NULL GROUP BY 1)""")
    npts = fixed.KDE_GRID_POINTS
    q["price_kde"] = _sql(
        f"""SELECT CAST(g.i AS INTEGER) AS point, round_even(g.x, 6) AS x,
                   round_even(sum(exp(-0.5E0 * pow((g.x - f.price) / p.h, 2)))
                              * (1E0 / (p.n * p.h * sqrt(2E0 * pi())) * p.n * (p.mx - p.mn) / {nb}E0), 6) AS density
            FROM g, p, filt f WHERE f.price IS NOT NULL GROUP BY g.i, g.x, p.n, p.h, p.mx, p.mn""",
        ctes=f"""s AS (SELECT count(price) n, min(price) mn, max(price) mx, stddev_samp(price) sd FROM filt),
                p AS (SELECT n, mn, mx, sd * pow(n, -0.2E0) AS h FROM s WHERE n >= 2 AND sd > 0),
                g AS (SELECT t.i, CASE WHEN t.i = {npts - 1} THEN mx ELSE mn + t.i * ((mx - mn) / {npts - 1}E0) END AS x
                      FROM p, generate_series(0, {npts - 1}) t(i))""")
    q["availability_trend"] = _sql(
        """SELECT n, round_even(slope, 6) AS slope, round_even(intercept, 6) AS intercept,
                  round_even(r, 6) AS r, round_even(intercept, 6) AS y_at_0,
                  round_even(slope * 365 + intercept, 6) AS y_at_365
           FROM (SELECT count(CASE WHEN availability_365 IS NOT NULL AND price IS NOT NULL THEN 1 END) AS n,
                        regr_slope(price, CAST(availability_365 AS DOUBLE)) AS slope,
                        regr_intercept(price, CAST(availability_365 AS DOUBLE)) AS intercept,
                        """ + _corr("CAST(availability_365 AS DOUBLE)", "price") + """ AS r
                 FROM iqr) WHERE n > 30""")
    feats3 = fixed.CLUSTER_FEATURES
    filled = {f: f"COALESCE(CAST({f} AS DOUBLE), 0E0)" for f in feats3}
    st_aggs = ", ".join(f"avg({filled[f]}) AS m{i}, stddev_pop({filled[f]}) AS s{i}"
                        for i, f in enumerate(feats3))
    z_cols = ", ".join(
        f"round_even(({filled[f]} - m{i}) / CASE WHEN s{i} IS NULL OR s{i} = 0 THEN 1E0 ELSE s{i} END, 6) AS z_{f}"
        for i, f in enumerate(feats3))
    q["feature_vector"] = _sql("SELECT id, " + ", ".join(f"{filled[f]} AS {f}" for f in feats3)
                               + " FROM filt")
    q["standardised_features"] = _sql(f"SELECT id, {z_cols} FROM filt, st",
                                      ctes=f"st AS (SELECT {st_aggs} FROM filt)")
    xx = ", ".join(_xxhash64_sql("id", fixed.SAMPLE_SEED))
    q["stable_sample"] = _sql(
        f"SELECT id, availability_365, price, occupancy_rate FROM (SELECT *, {xx} FROM iqr) "
        f"ORDER BY _xx, id LIMIT {fixed.SAMPLE_SIZE}")
    lctes, lsel = _lowess_sql()
    q["local_trend"] = _sql(lsel, ctes=lctes)
    pca = _pca_ctes(feats3)
    q["pca_variance"] = _sql(
        "SELECT t.component, round_even(CASE t.k WHEN 1 THEN r1 WHEN 2 THEN r2 ELSE r1 + r2 END, 6) "
        "AS explained_ratio FROM (VALUES ('PC1', 1), ('PC2', 2), ('total', 3)) AS t(component, k), "
        "(SELECT e1 / (e1 + e2 + e3) AS r1, e2 / (e1 + e2 + e3) AS r2 FROM pca) AS v", ctes=pca)
    q["pca_loadings"] = _sql(" UNION ALL ".join(
        f"SELECT '{f}' AS feature, round_even(v1_{i}, 6) AS pc1, round_even(v2_{i}, 6) AS pc2 FROM pca"
        for i, f in enumerate(feats3)), ctes=pca)
    q["pca_scores"] = _sql(
        "SELECT pz.id, round_even(z0 * v1_0 + z1 * v1_1 + z2 * v1_2, 6) AS pca_1, "
        "round_even(z0 * v2_0 + z1 * v2_1 + z2 * v2_2, 6) AS pca_2 FROM pz, pca", ctes=pca)
    km = _kmeans_ctes(feats3)
    q["kmeans_clusters"] = _sql("SELECT id, cluster FROM kfin", ctes=km)
    listed = ", ".join(
        f"round_even({c}, 6) AS {c}" if c in _ROUNDED else c for c in _LISTING_COLUMNS)
    q["segmented_listings"] = _sql(
        f"SELECT f.*, pca_1, pca_2 FROM (SELECT {listed}, cluster FROM kfin) AS f JOIN "
        "(SELECT pz.id, round_even(z0 * v1_0 + z1 * v1_1 + z2 * v1_2, 6) AS pca_1, "
        "round_even(z0 * v2_0 + z1 * v2_1 + z2 * v2_2, 6) AS pca_2 FROM pz, pca) AS p "
        "ON f.id = p.id", ctes=f"{km},\n{pca}")
    by_cluster = ("SELECT cluster, round_even(avg(CAST(price AS DECIMAL(28,10))), 2) AS avg_price, "
                  "count(price) AS listings, "
                  + ", ".join(f"round_even(avg(CAST({c} AS DECIMAL(28,10))), 2) AS {n}" for c, n in (
                      ("number_of_reviews", "avg_reviews"), ("availability_365", "avg_availability"),
                      ("occupancy_rate", "avg_occupancy"), ("estimated_revenue", "avg_revenue")))
                  + " FROM kfin GROUP BY cluster")
    q["cluster_summary"] = _sql(by_cluster, ctes=km)
    q["cluster_winners"] = _sql("SELECT " + ", ".join(
        f"(SELECT cluster FROM ks_ ORDER BY {c} DESC, cluster LIMIT 1) AS {n}" for c, n in (
            ("avg_revenue", "highest_revenue"), ("listings", "largest_segment"),
            ("avg_occupancy", "best_occupancy"), ("avg_price", "most_expensive"))),
        ctes=f"{km},\nks_ AS ({by_cluster})")
    pairs3 = [(a, b) for a in feats3 for b in feats3]
    q["feature_corr"] = _sql(" UNION ALL ".join(
        f"SELECT '{a}' AS feature_x, '{b}' AS feature_y, {R(_corr(a, b))} AS r FROM filt"
        for a, b in pairs3))
    strong = []
    feats7 = fixed.CORRELATION_FEATURES
    for i, a in enumerate(feats7):
        for b in feats7[i + 1:]:
            strong.append(f"SELECT '{a}' AS feature_x, '{b}' AS feature_y, {_corr(a, b)} AS r FROM filt")
    q["strong_correlations"] = _sql(
        f"SELECT feature_x, feature_y, CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END AS direction, "
        f"{R('r')} AS r FROM ({' UNION ALL '.join(strong)}) WHERE abs(r) > 0.5E0")
    return q
