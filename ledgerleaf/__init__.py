"""Dataset-level document operators for PySpark."""
