"""tessera: key-value analytics and corpus preparation on PySpark DataFrames."""
