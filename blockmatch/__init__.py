"""blockmatch: block-hash analytics on Spark DataFrames."""

__version__ = "0.1.0"
