"""tidemark: condition-monitoring analytics for sensor time series, built on Spark DataFrames."""

__version__ = "0.1.0"
