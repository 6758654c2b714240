"""Districting analytics and training-data preparation on Spark."""
