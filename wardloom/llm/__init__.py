"""Operators for preparing language-model training data with Spark.

Nothing outside this subpackage imports it.
"""
