"""millrace: query and data-processing operators for object data, written on Spark DataFrames."""
