"""Event detection over timestamped, geotagged text, on Spark DataFrames."""

__version__ = "0.1.0"
