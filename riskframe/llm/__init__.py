"""Operators for large training-data pipelines.

Each module holds one operator with a general interface on DataFrames; the
registered queries in ``queries`` derive their columns from the operators'
outputs. Nothing outside this subpackage imports it.
"""
