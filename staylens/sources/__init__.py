from staylens.sources.listings import (  # noqa: F401
    LISTINGS_SCHEMA, listings_from_tpch, parse_price, read_listings_csv, read_tpch,
)
