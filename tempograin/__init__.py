"""tempograin: analytics for irregular time series on Spark DataFrames."""

__version__ = "0.1.0"
