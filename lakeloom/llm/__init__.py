"""Operators for preparing training corpora: one module for each operator, all on Spark DataFrames.

Nothing else in the library imports this subpackage.
"""
