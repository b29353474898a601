"""The analysis context: baseline (clean, enriched, unfiltered) and filtered tables.

Built once per (session, input, filter spec).  The enriched baseline is the
table every summary reads (about 40 times), so it is kept.  On a cluster whose
platform names a shared ``spark.checkpoint.dir`` it is written there as Parquet
and read back (``table``): that cuts the lineage (joins over lineitem), so a lost
executor costs a re-read, not a re-join.  Without one (local tests) it is cached.
"""

from __future__ import annotations

import uuid
import weakref
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from staylens.operators.features import PriceBounds, clean_listings, derive, finish, price_bounds
from staylens.operators.filters import FilterSpec, apply_filters, iqr_clean, with_reviews_filter
from staylens.operators.ml import KMeansModel, PCAResult, fit_kmeans, fit_pca
from staylens.functions import expressions, fixed
from staylens.operators import features, skew
from staylens.plans.kept import fingerprint, keep
from staylens.session import has_shared_checkpoint_dir
from staylens.sources import listings
from staylens.sources.listings import listings_from_tpch

#: The code that makes the derived table: part of its fingerprint.
CODE = (listings, features, skew, expressions, fixed)


@dataclass
class Context:
    spark: SparkSession
    baseline: DataFrame
    filtered: DataFrame
    bounds: PriceBounds
    spec: FilterSpec
    kept: str | None = None          # name of the kept table, if there is one
    _iqr: DataFrame | None = None
    _models: dict = field(default_factory=dict)

    @property
    def iqr(self) -> DataFrame:
        """The filtered table inside the price and occupancy IQR fences."""
        if self._iqr is None:
            self._iqr = iqr_clean(self.filtered)
        return self._iqr

    @property
    def reviewed(self) -> DataFrame:
        return with_reviews_filter(self.iqr)

    @property
    def pca(self) -> PCAResult:
        """PCA of the filtered table, fitted once."""
        if "pca" not in self._models:
            self._models["pca"] = fit_pca(self.filtered)
        return self._models["pca"]

    def kmeans(self, k: int = 4) -> KMeansModel | None:
        """k-means of the filtered table, fitted once per ``k``: a few numbers."""
        if k not in self._models:
            self._models[k] = fit_kmeans(self.filtered, k)
        return self._models[k]


def build_context(spark: SparkSession, raw: DataFrame, spec: FilterSpec = FilterSpec(),
                  materialize: str = "auto", partition_by: tuple[str, ...] = ()) -> Context:
    """``materialize``: ``"table"`` (Parquet under the shared checkpoint folder,
    cuts lineage; a later session with the same input files finds it again, see
    :mod:`kept`), ``"cache"``, ``"none"``, or ``"auto"`` = table when the platform
    names ``spark.checkpoint.dir``, else cache.  ``partition_by`` (table only):
    low-cardinality columns such as ``room_type`` whose filters then prune whole
    directories."""
    if materialize == "auto":
        materialize = "table" if has_shared_checkpoint_dir(spark) else "cache"
    staged = derive(clean_listings(raw))
    kept = None
    if materialize == "table":
        mark = fingerprint(staged, CODE)
        kept = "-".join([mark or uuid.uuid4().hex, *partition_by])
        staged = keep(staged, kept, partition_by)
    elif materialize == "cache":
        staged = staged.cache()
    bounds = price_bounds(staged)
    baseline = finish(staged, bounds)
    filtered = apply_filters(baseline, spec, bounds)
    return Context(spark, baseline, filtered, bounds, spec, kept)


_MEMO: "weakref.WeakKeyDictionary[SparkSession, dict]" = weakref.WeakKeyDictionary()


def tpch_context(spark: SparkSession, sf_dir: str, spec: FilterSpec = FilterSpec(),
                 materialize: str = "auto") -> Context:
    """Context over the listing star view of ``sf_dir`` (memoised per session)."""
    memo = _MEMO.setdefault(spark, {})
    key = (sf_dir, spec, materialize)
    if key not in memo:
        memo[key] = build_context(spark, listings_from_tpch(spark, sf_dir), spec, materialize)
    return memo[key]


def register_context(spark: SparkSession, sf_dir: str, ctx: Context,
                     materialize: str = "auto") -> None:
    """Make ``tpch_context(spark, sf_dir, ctx.spec)`` return ``ctx`` (e.g. a context
    built with a partitioned table by a batch job)."""
    _MEMO.setdefault(spark, {})[(sf_dir, ctx.spec, materialize)] = ctx
