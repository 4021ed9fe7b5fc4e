"""Data quality, cleaning, profiling and model building on Spark DataFrames."""
