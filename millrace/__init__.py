"""millrace: dataflow analytics on Spark DataFrames."""
