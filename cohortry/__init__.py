"""Cohort analytics on PySpark DataFrames."""
