"""helixframe: a PySpark-native engine for short-read and cohort sequence analytics.

Every operator takes DataFrames and parameters and returns a DataFrame; none of them writes files
(sinks are separate).  Relational work is expressed with built-in Spark SQL functions so that
Catalyst plans it; only inherently sequential per-locus algorithms run as grouped pandas functions.
"""

__version__ = "0.1.0"
