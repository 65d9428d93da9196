"""envseries: time-series preparation and analysis operators on Spark.

Sub-packages
------------
sources    readers and writers (CSV long, nested JSON feeds, Parquet, sinks)
functions  column expressions (time handling, bins, flags, statistics)
operators  DataFrame -> DataFrame operators (reshape, profile, clean, ...)
plans      composed flows and the registered query catalogue
streaming  the hourly reshape on a Structured Streaming source
"""

__all__ = ["sources", "functions", "operators", "plans", "streaming"]
