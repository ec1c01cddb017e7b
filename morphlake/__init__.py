"""Object-table analytics on Spark: every operator takes DataFrames and returns a lazy DataFrame."""
