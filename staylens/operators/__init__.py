"""Operators: ``f(df, ...) -> DataFrame`` functions over listing tables.

features (clean, derive, enrich), filters, quantiles (exact selection), summaries,
stats (histogram, KDE, trends, sample), ml (standardise, PCA, k-means) and skew
(hot-key salted joins).
"""
