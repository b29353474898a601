"""Hand-made listing rows in the canonical schema."""

import datetime as dt

from staylens.sources.listings import LISTINGS_SCHEMA

DEFAULTS = dict(name="L", host_id=1, host_name="H", neighbourhood_group="North",
                neighbourhood="Alpha", latitude=-22.90, longitude=-43.20,
                room_type="Entire home/apt", price=100.0, minimum_nights=2,
                number_of_reviews=5, last_review=dt.date(2024, 2, 3),
                reviews_per_month=0.5, calculated_host_listings_count=1,
                availability_365=100)


def listings(spark, rows):
    out = []
    for i, r in enumerate(rows):
        d = dict(DEFAULTS, id=i + 1)
        d.update(r)
        out.append(tuple(d[f.name] for f in LISTINGS_SCHEMA.fields))
    return spark.createDataFrame(out, LISTINGS_SCHEMA)
