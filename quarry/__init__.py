"""quarry: Spark-native ingestion profiling and retail/operations analytics.

Every operator takes DataFrames plus column names (and optional partition keys
and an explicit ordering) and returns a lazy DataFrame.  Nothing is collected
inside an operator except documented one-row scalars.
"""

__version__ = "0.1.0"
