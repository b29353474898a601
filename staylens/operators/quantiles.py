"""Exact, linearly interpolated quantiles in two passes over the data.

``percentile`` keeps a map of every distinct value of a group inside one aggregation
buffer, which grows with the data for a continuous column.  Here a mergeable sketch
finds where each wanted rank lies, and one counting pass picks the value:

1. one aggregate: ``count`` and a quantile summary (``percentile_approx``: merged from
   the tasks' summaries, rank error at most ``n / (SKETCH * grid)`` whatever the order of rows)
   read at ``grid + 1`` even shares.  Two grid steps to both sides of a rank's share hold the
   rank for certain; brackets that touch become one;
2. one pass counts, per group, rows by zone: between brackets as one number, within a
   bracket by value.  Partial aggregation leaves a few counts a task and the brackets'
   distinct values: about ``4 / grid`` of the rows for each rank.

The rest runs on those counts: a running sum in order names each rank's value; where
brackets may hold very many rows it goes by zone and slice first, and by value only in
slices that hold a rank.  Summaries of few groups pass through the driver (a few numbers
each); those of many are joined on the executors and made once more, so the number
of groups has no limit.  Every pick is checked: a rank outside its bracket raises.

The interpolation is ``lo * (1 - frac) + hi * frac`` at position ``p * (n - 1)``.
Nulls, NaN and null group keys are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Shares at which a group's summary is read.
GRID = 200
#: The summary's accuracy is this many times the grid's.
SKETCH = 4
#: Slices of a bracket that are counted before values are.
SLICES = 1024
#: Up to so many groups, their summaries pass through the driver.
FEW_GROUPS = 1000
#: Up to so many rows in a group's brackets, one running sum goes over them.
DIRECT_ROWS = 2_000_000


def _prepare(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    data = df.select(*[F.col(c) for c in by], F.col(value).cast("double").alias("_x"))
    data = data.where(F.col("_x").isNotNull() & ~F.isnan("_x"))
    for c in by:
        data = data.where(F.col(c).isNotNull())
    return data


def summary(value: str | Column, grid: int = GRID) -> Column:
    """The quantile summary of a column without NaN, read at ``grid + 1`` even shares: an
    aggregate for callers that aggregate anyway."""
    shares = F.lit(np.arange(grid + 1) / grid)      # one literal, not an expression a share
    return F.percentile_approx(value, shares, F.lit(SKETCH * grid))


def _summaries(data: DataFrame, by: Sequence[str], ranks: Column, grid: int,
               taken: DataFrame | None = None) -> DataFrame:
    """Per group: n, the wanted ``ranks`` (rising, 0-based) and the ``zones`` that hold them."""
    found = taken if taken is not None else data.groupBy(*by).agg(
        F.count("_x").alias("_n"), summary("_x", grid).alias("_g"))
    found = found.where(F.col("_n") > 0).withColumn("_ranks", ranks)

    def bound(step: Column) -> Column:
        return F.get(F.col("_g"), F.least(F.greatest(step, F.lit(0)), F.lit(grid)).cast("int"))

    def zone(k: Column) -> Column:
        return F.struct(bound(F.floor(k / F.col("_n") * grid) - 2).alias("lo"),
                        bound(F.ceil((k + 2) / F.col("_n") * grid) + 2).alias("hi"))

    def joined(zones: Column, new: Column) -> Column:
        last = F.element_at(zones, -1)
        wider = F.struct(last["lo"].alias("lo"), F.greatest(last["hi"], new["hi"]).alias("hi"))
        return F.when((F.size(zones) > 0) & (F.try_element_at(zones, F.lit(-1))["hi"] >= new["lo"]),
                      F.concat(F.slice(zones, 1, F.size(zones) - 1), F.array(wider))) \
            .otherwise(F.concat(zones, F.array(new)))

    empty = F.array().cast("array<struct<lo:double,hi:double>>")
    zones = F.aggregate(F.transform("_ranks", zone), empty, joined)
    return found.select(*by, "_n", "_ranks", zones.alias("_zones"))


def _values_at(data: DataFrame, by: Sequence[str], ranks: Column, most: int, grid: int,
               taken: DataFrame | None = None,
               direct_rows: float | None = None, rows: int | None = None) -> DataFrame | None:
    """Per group: ``_n`` and ``_at``, a map from rank to value.  ``ranks`` is an expression
    of the group's ``_n`` and keys with ``most`` ranks at most."""
    by = list(by)
    direct_rows = DIRECT_ROWS if direct_rows is None else direct_rows
    if rows is not None and not by and rows <= direct_rows:
        # so few values are put in order by themselves
        counts = data.groupBy(F.lit(1).alias("_zone"), F.col("_x").alias("_v")).agg(
            F.count(F.lit(1)).alias("_c"))
        picked = _running(counts, by, lambda small: small.withColumn("_n", F.lit(int(rows)))
                          .withColumn("_ranks", ranks))
        return _mapped(picked, by) if rows else None
    found = _summaries(data, by, ranks, grid, taken)
    known = found.limit(FEW_GROUPS + 1).collect()
    if not known:
        return None
    large, hint = True, (lambda many: many)
    if len(known) <= FEW_GROUPS:      # few small rows: the first pass is not made again
        held = max(r["_n"] for r in known) * 5 * most / grid
        large = held > direct_rows
        found = data.sparkSession.createDataFrame(known, found.schema)
        hint = F.broadcast            # FEW_GROUPS rows at most
    if not by:
        zones = known[0]["_zones"]
        spread, ends = data, [F.lit(float(e)) for z in zones for e in (z["lo"], z["hi"])]
        one = {"_n": F.lit(known[0]["_n"]),
               "_ranks": F.array(*[F.lit(k) for k in known[0]["_ranks"]])}

        def with_group(small: DataFrame) -> DataFrame:
            return small.withColumns(one)
    else:
        ends = [F.col(f"_e{i}") for i in range(2 * most)]
        flat = [F.get("_zones", F.lit(i))[side].alias(f"_e{2 * i + (side == 'hi')}")
                for i in range(most) for side in ("lo", "hi")]
        spread = data.join(hint(found.select(*by, *flat)), by)

        def with_group(small: DataFrame) -> DataFrame:
            return small.join(hint(found.select(*by, "_n", "_ranks")), by)
    # zone 2 i lies between brackets, zone 2 i + 1 is the i-th bracket; a group's unused
    # ends are null and never hold
    x, zone = F.col("_x"), F.lit(0)
    for i, end in reversed(list(enumerate(ends))):
        beyond = x > end if i % 2 else x >= end
        zone = F.when(beyond, zone if i < len(ends) - 1 else F.lit(len(ends))).otherwise(F.lit(i))
    counts = (spread.withColumn("_zone", zone)
              .groupBy(*by, "_zone", F.when(F.col("_zone") % 2 == 1, x).alias("_v"))
              .agg(F.count(F.lit(1)).alias("_c")))
    return _mapped((_sliced if large else _running)(counts, by, with_group), by)


def _mapped(picked: DataFrame, by: list[str]) -> DataFrame:
    return picked.groupBy(*by, "_n").agg(
        F.map_from_entries(F.collect_list(F.struct("_rank", "_v"))).alias("_at"))


def _before(window) -> Column:
    return F.coalesce(F.sum("_c").over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def _mine(valid: Column | None = None) -> Column:
    """The wanted ranks among a row's; where ``valid`` does not hold there must be none."""
    mine = F.filter("_ranks", lambda k: (k >= F.col("_start")) & (k < F.col("_start") + F.col("_c")))
    return mine if valid is None else F.when(valid | (F.size(mine) == 0), mine).otherwise(
        F.raise_error(F.lit("a quantile's rank lies outside its bracket")))


def _running(counts: DataFrame, by: list[str], with_group: Callable) -> DataFrame:
    """Rank and value, by one running sum over the counts of each group."""
    start = _before(Window.partitionBy(*by).orderBy("_zone", "_v"))
    return (with_group(counts.withColumn("_start", start))
            .withColumn("_rank", F.explode(_mine(F.col("_zone") % 2 == 1)))
            .select(*by, "_n", "_rank", "_v"))


def _sliced(counts: DataFrame, by: list[str], with_group: Callable) -> DataFrame:
    """:func:`_running` for brackets of very many values: running sums by zone, by slice
    of a zone, and by value in the slices that hold a rank.  Brackets are sliced evenly
    between the least and greatest value that they hold."""
    zones = counts.groupBy(*by, "_zone").agg(
        F.sum("_c").alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    start = _before(Window.partitionBy(*by).orderBy("_zone"))
    hit = (with_group(zones.withColumn("_start", start))
           .withColumn("_ranks", _mine(F.col("_zone") % 2 == 1)).where(F.size("_ranks") > 0)
           .select(*by, "_zone", "_lo", "_hi", "_n", "_ranks", F.col("_start").alias("_first")))
    share = F.coalesce(F.try_divide(F.col("_v") - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(0.0))
    held = counts.join(hit, [*by, "_zone"]).withColumn("_slice", F.floor(share * SLICES).cast("int"))
    keys = [*by, "_zone", "_slice"]
    slices = (held.groupBy(*keys).agg(F.sum("_c").alias("_c"), F.first("_first").alias("_first"),
                                      F.first("_n").alias("_n"), F.first("_ranks").alias("_ranks"))
              .withColumn("_start", F.col("_first") + _before(
                  Window.partitionBy(*by, "_zone").orderBy("_slice")))
              .withColumn("_ranks", _mine()).where(F.size("_ranks") > 0)
              .select(*keys, "_n", "_ranks", F.col("_start").alias("_first")))
    return (held.select(*keys, "_v", "_c").join(slices, keys)
            .withColumn("_start", F.col("_first") + _before(Window.partitionBy(*keys).orderBy("_v")))
            .withColumn("_rank", F.explode(_mine())).select(*by, "_n", "_rank", "_v"))


def _positions(p: float) -> tuple[Column, Column, Column]:
    """Lower rank, upper rank and the share between them, of ``_n`` values."""
    h = F.lit(float(p)) * (F.col("_n") - 1)
    low = F.floor(h).cast("long")
    return low, F.least(low + 1, F.col("_n") - 1), h - low


def quantile_frame(df: DataFrame, value: str, probs: Sequence[float],
                   names: Sequence[str], by: Sequence[str] = (), grid: int = GRID,
                   taken: DataFrame | None = None, rows: int | None = None) -> DataFrame:
    """Quantiles of ``value`` at ``probs`` (linear rule) per group of ``by``: a DataFrame
    ``(by..., names...)`` with one row per group that has values.  ``taken`` may hold each
    group's ``_n`` and ``_g`` (:func:`summary`) if the caller has them; the first pass is
    then not needed.  Nor is it without ``by`` columns where ``rows``, the number of values
    (neither null nor NaN), is known to be at most DIRECT_ROWS."""
    ends = [k for p in probs for k in _positions(p)[:2]]
    ranks = F.array_sort(F.array_distinct(F.array(*ends)))
    found = _values_at(_prepare(df, value, by), by, ranks, len(ends), grid, taken,
                       rows=rows)
    if found is None:
        return df.limit(0).select(*by, *[F.lit(None).cast("double").alias(n) for n in names])

    def quantile(p: float) -> Column:
        low, high, frac = _positions(p)
        a, b = F.element_at("_at", low), F.element_at("_at", high)
        # same interpolation form as SQL engines' quantile_cont
        return F.when(frac == 0, a).otherwise(a * (F.lit(1.0) - frac) + b * frac)

    return found.select(*by, *[quantile(p).alias(n) for p, n in zip(probs, names)])


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float],
                    by: Sequence[str] = (), grid: int = GRID,
                    rows: int | None = None) -> dict[tuple, list[float]]:
    """:func:`quantile_frame` as ``{group_tuple: [q...]}``, for groups that fit on the
    driver; groups without values are absent."""
    names = [f"_q{i}" for i in range(len(probs))]
    found = quantile_frame(df, value, probs, names, by, grid, rows=rows).collect()
    return {tuple(r[c] for c in by): [r[n] for n in names] for r in found}


def bracketed_values(rows: DataFrame, by: Sequence[str], bracket: tuple[str, str],
                     rank: Column) -> dict[tuple, float]:
    """The value of one rank (0-based) per group, of ``rows`` with a column ``_x``, where the
    caller knows brackets (two columns) that hold it: one pass."""
    x, (low, high) = F.col("_x"), bracket
    zone = F.when(x < F.col(low), 0).when(x <= F.col(high), 1).otherwise(2)
    counts = (rows.withColumn("_zone", zone)
              .groupBy(*by, "_zone", F.when(F.col("_zone") == 1, x).alias("_v"))
              .agg(F.count(F.lit(1)).alias("_c")))
    found = _running(counts, list(by), lambda small: small.withColumn("_n", F.lit(0))
                     .withColumn("_ranks", F.array(rank))).collect()
    return {tuple(r[c] for c in by): r["_v"] for r in found}


def order_statistics(df: DataFrame, value: str, ranks: Sequence[int] | Column,
                     by: Sequence[str] = (), most: int = 1,
                     grid: int = GRID) -> dict[tuple, dict[int, float]]:
    """The k-th smallest values (0-based) per group, ``{group: {rank: value}}``.  ``ranks``
    are numbers, or an array expression of the ``by`` columns (``most`` ranks at most);
    ranks that a group does not have are left out."""
    if not isinstance(ranks, Column):
        most = len(ranks)
        ranks = F.array(*[F.lit(int(k)).cast("long") for k in sorted(set(ranks))])
    known = F.filter(ranks, lambda k: (k >= 0) & (k < F.col("_n")))
    found = _values_at(_prepare(df, value, by), by, known, most, grid)
    rows = found.collect() if found is not None else []
    return {tuple(r[c] for c in by): dict(r["_at"]) for r in rows}
