"""Session analytics and retrieval on PySpark DataFrames."""
