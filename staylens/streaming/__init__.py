from staylens.streaming.listings_stream import (  # noqa: F401
    enriched_stream, kpi_stream, run_to_memory, write_kpis,
)
