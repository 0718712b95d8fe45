"""Session-log analytics and corpus preparation, written on PySpark DataFrames."""
