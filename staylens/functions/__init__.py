from staylens.functions.expressions import (  # noqa: F401
    cut, exact_avg, exact_sum, haversine_km, min_distance_km, round2, safe_corr, season,
    label_dimension, nan_to_null,
)
