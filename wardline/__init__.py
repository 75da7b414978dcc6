"""Certificate-transparency analytics and training-data operators on Spark DataFrames."""
