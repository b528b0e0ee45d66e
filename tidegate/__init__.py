"""Tidegate: typed packet pipelines and corpus preparation on PySpark."""
