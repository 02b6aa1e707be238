"""Order-management analytics, mining and streaming operators on Spark DataFrames."""
