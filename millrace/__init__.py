"""millrace: batch-inference exchange analytics and corpus preparation on PySpark."""
