"""wayfold: trip-trace intelligence on Spark DataFrames."""
