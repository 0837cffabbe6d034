"""Operators of a training-data pipeline, each a function on DataFrames.

Nothing else in the library imports this subpackage.  ``registry`` lists its
queries and their SQL.
"""
