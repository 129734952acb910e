"""tidemark: time-series research analytics on PySpark DataFrames."""
