"""Sums over cells of a line, from which smooth kernel sums follow without rows.

A kernel sum ``sum(w * K(x - g))`` over many rows and a few points ``g`` needs one pass that
adds up, per cell of the line, the weighted powers of each row's place in its cell.  A
polynomial kernel is then a short sum over cells, exactly; an analytic one too, to the
accuracy of its series.  Rows are never copied once per point.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Cells:
    """``n`` cells of equal width from ``start``."""

    start: float
    width: float
    n: int

    @classmethod
    def over(cls, low: float, high: float, n: int) -> "Cells":
        width = (high - low) / n
        return cls(low, width, n) if high > low and width > 0 else cls(low, 1.0, 1)

    def number(self, x: Column) -> Column:
        """The cell of a value; the ends belong to the first and last one."""
        at = F.floor((x - F.lit(self.start)) / F.lit(self.width))
        return F.greatest(F.least(at, F.lit(self.n - 1)), F.lit(0)).cast("int")

    def number_of(self, x: float) -> int:
        """:meth:`number` of a driver-side value, by the same arithmetic."""
        return max(min(math.floor((x - self.start) / self.width), self.n - 1), 0)

    def centre(self, cell):
        return self.start + (cell + 0.5) * self.width

    def place(self, x: Column, cell: Column) -> Column:
        """Where a value lies in its cell, from -0.5 to 0.5."""
        return (x - (F.lit(self.start) + (cell + F.lit(0.5)) * F.lit(self.width))) / F.lit(self.width)


def power_sums(place: Column, weight: Column, degree: int) -> Column:
    """Sums of ``weight * place**j`` for j = 0 ... degree, as one array."""
    out, term = [], weight
    for _ in range(degree + 1):
        out.append(F.sum(term))
        term = term * place
    return F.array(*out)


def matrix(rows: list, name: str, degree: int) -> np.ndarray:
    """The power sums of collected cell rows: cell by power."""
    return np.array([r[name] for r in rows], dtype=float).reshape(len(rows), degree + 1)


GAUSS_DEGREE = 9
GAUSS_CELLS = 8         # cells a bandwidth


def gaussian_sums(df: DataFrame, x: Column, grid: list[float], low: float, high: float,
                  h: float) -> np.ndarray:
    """``sum(exp(-((g - x) / h)**2 / 2))`` over all rows for each value of ``grid``.

    Cells are an eighth of the bandwidth wide and the kernel is expanded about their centres
    in Hermite polynomials to degree 9: the series' rest is below ``1.09 * (1 / 16)**10 /
    sqrt(10!)``, that is 6e-16 a row.  One pass; a row per occupied cell reaches the
    driver, at most ``GAUSS_CELLS * (high - low) / h`` and in practice some thousands,
    however many rows there are."""
    n = max(1, math.ceil((high - low) / h * GAUSS_CELLS))
    cells = Cells(low, h / GAUSS_CELLS, n)
    number = cells.number(F.col("_x"))
    rows = (df.select(x.cast("double").alias("_x")).where(F.col("_x").isNotNull())
            .select("_x", number.alias("_cell"))
            .groupBy("_cell").agg(power_sums(cells.place(F.col("_x"), F.col("_cell")),
                                             F.lit(1.0), GAUSS_DEGREE).alias("m")).collect())
    rows.sort(key=lambda r: r["_cell"])
    sums = matrix(rows, "m", GAUSS_DEGREE)
    centres = cells.centre(np.array([r["_cell"] for r in rows], dtype=float))
    step = cells.width / h
    out = np.zeros(len(grid))
    for i, g in enumerate(grid):
        d = (g - centres) / h
        before, hermite = np.zeros_like(d), np.ones_like(d)
        series = np.zeros_like(d)
        for j in range(GAUSS_DEGREE + 1):
            series += hermite * sums[:, j] * step ** j / math.factorial(j)
            before, hermite = hermite, d * hermite - j * before
        out[i] = float((np.exp(-0.5 * d * d) * series).sum())
    return out


#: (1 - u**3)**3 by powers of u.
TRICUBE = np.array([1.0, 0, 0, -3.0, 0, 0, 3.0, 0, 0, -1.0])


def tricube_taylor(u: np.ndarray) -> np.ndarray:
    """Coefficients of ``(1 - (u + s)**3)**3`` by powers of s, for each u."""
    out = np.zeros((len(u), 10))
    for k in range(10):
        if TRICUBE[k]:
            for j in range(k + 1):
                out[:, j] += TRICUBE[k] * math.comb(k, j) * u ** (k - j)
    return out


def tricube_sums(cells: Cells, covered: np.ndarray, ones: np.ndarray, values: np.ndarray,
                 g: float, r: float) -> np.ndarray:
    """``(sum(w), sum(w d), sum(w d d), sum(w y), sum(w y d))`` with ``d = x - g`` and the
    tricube weight of radius r, over cells that lie wholly on one side of g and within r.
    ``covered`` numbers them; ``ones`` and ``values`` are their power sums of 1 and y."""
    offset = cells.centre(covered.astype(float)) - g
    side = np.sign(offset)
    kernel = tricube_taylor(np.abs(offset) / r) * (side[:, None] * cells.width / r) ** np.arange(10)

    def moment(sums: np.ndarray, power: int) -> float:
        # (x - g)**power = (offset + width * place)**power
        total = 0.0
        for a in range(power + 1):
            factor = math.comb(power, a) * offset ** (power - a) * cells.width ** a
            total += float((factor * (kernel * sums[:, a:a + 10]).sum(axis=1)).sum())
        return total

    return np.array([moment(ones, 0), moment(ones, 1), moment(ones, 2),
                     moment(values, 0), moment(values, 1)])
