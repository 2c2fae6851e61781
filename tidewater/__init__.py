"""Business-operations analytics and corpus preparation on Spark DataFrames."""
