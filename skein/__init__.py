"""Document question answering, record workflows and their plans on Spark DataFrames."""
