"""Property-graph analytics and text pipelines on PySpark DataFrames."""
