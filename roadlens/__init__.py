"""Road-risk analytics as PySpark DataFrame operators and jobs."""
