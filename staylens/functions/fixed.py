"""Fixed values that must equal the reference dashboard's for the same results.

FIXED VALUES - labels, bin edges, coordinates and weights as the dashboard uses
them, in its natural order.  Bins are right-closed ``(lo, hi]`` with the lowest
edge excluded unless stated (``pd.cut`` semantics); ``None`` as upper edge means
+infinity.
"""

from __future__ import annotations

# --- fixed values -----------------------------------------------------------------

PRICE_CATEGORY_LABELS = ["Budget", "Economy", "Standard", "Premium", "Luxury"]
PRICE_CATEGORY_PROBS = [0.2, 0.4, 0.6, 0.8]  # inner quintile cuts; lowest edge included

HOST_CATEGORY_EDGES = [0, 1, 5, 20, None]
HOST_CATEGORY_LABELS = ["Single Property", "Small Portfolio", "Medium Portfolio",
                        "Large Portfolio"]

BEACH_PROXIMITY_EDGES = [0, 1, 3, 5, None]
BEACH_PROXIMITY_LABELS = ["Beachfront (<1km)", "Near Beach (1-3km)",
                          "Mid Distance (3-5km)", "Inland (>5km)"]

HOST_EXPERIENCE_EDGES = [0, 10, 50, 100, None]
HOST_EXPERIENCE_LABELS = ["New (0-10 reviews)", "Growing (11-50)",
                          "Experienced (51-100)", "Veteran (>100)"]

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

# Season of the month of the last review (southern hemisphere).
SEASON_BY_MONTHS = [
    ("Summer", [12, 1, 2]),
    ("Fall", [3, 4, 5]),
    ("Winter", [6, 7, 8]),
    ("Spring", [9, 10, 11]),
]

# Points of interest (beaches) as (latitude, longitude).
BEACH_POINTS = [
    (-22.9711, -43.1823),
    (-22.9838, -43.2096),
    (-22.9874, -43.2232),
    (-23.0107, -43.3015),
    (-23.0241, -43.4757),
]
EARTH_RADIUS_KM = 6371.0

# Clean-price rule: strictly between these.
PRICE_FLOOR = 0.0
PRICE_CEILING = 10000.0

# Default sidebar filter: price band [min, p85], slider ceiling p95.
DEFAULT_PRICE_UPPER_PROB = 0.85
PRICE_SLIDER_MAX_PROB = 0.95
MIN_REVIEWS_DEFAULT = 0
AVAILABILITY_DEFAULT = (0, 365)

# Competition score weights: listings, price stability, occupancy.
COMPETITION_WEIGHTS = (0.4, 0.3, 0.3)

# Features for correlation, standardisation, PCA and k-means.
CORRELATION_FEATURES = ["price", "number_of_reviews", "reviews_per_month",
                        "availability_365", "calculated_host_listings_count",
                        "occupancy_rate", "estimated_revenue"]
CLUSTER_FEATURES = ["price", "number_of_reviews", "availability_365"]
KMEANS_DEFAULT_K = 4
STRONG_CORRELATION = 0.5

# Categorical columns summarised in the explorer.
CATEGORICAL_SUMMARY_COLUMNS = ["room_type", "neighbourhood_group", "host_category",
                               "price_category"]

HISTOGRAM_BINS = 50
KDE_GRID_POINTS = 100
SAMPLE_SIZE = 2000
SAMPLE_SEED = 42
