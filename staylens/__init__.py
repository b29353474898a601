"""staylens: short-stay listings analytics as Spark DataFrame operators.

Every operator is a plain function ``f(df, ...) -> DataFrame`` built from the
public DataFrame / SQL / ML interfaces.  Sub-packages:

* ``sources``   - ingestion (CSV with text prices, the TPC-H star view) and sinks
* ``functions`` - column expressions: bins, haversine, seasons, safe correlation
* ``operators`` - cleaning, enrichment, filters, summaries, statistics, ML
* ``plans``     - the named query catalogue used by ``__spark_entry__`` and the bench
* ``streaming`` - the same enrichment and KPIs over a stream of listing files
"""

__version__ = "0.1.0"
