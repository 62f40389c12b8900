"""folioflow: hierarchical document analytics on PySpark DataFrames."""
