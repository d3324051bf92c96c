"""Catalog-change intelligence and training-data preparation on PySpark."""
