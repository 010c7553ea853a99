"""Operators of a training-data pipeline, each a Spark job on a table of documents.

Nothing else in the library imports this package.
"""
