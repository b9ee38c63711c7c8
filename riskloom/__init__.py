"""riskloom: banking credit / fraud / drift analytics expressed as Spark plans.

Sub-packages
------------
sources    readers, writers and the banking-shaped fixture views
functions  scalar Column builders (scoring rules, null-safe helpers, SQL functions)
operators  DataFrame -> DataFrame operators (features, joins, statistics, windows,
           governance, prompt tables, drift reports, Spark ML jobs)
plans      the registered query catalog (Spark plan + DuckDB oracle text per key)
streaming  Structured Streaming re-aims of the append-only logs
"""

__version__ = "0.1.0"
