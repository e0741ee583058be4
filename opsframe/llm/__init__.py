"""Operators for preparing training data: each module is one operator.

Nothing outside this package imports it. Every operator takes DataFrames and reads
only the columns it names, so further columns never clash; ``queries`` binds the
operators to the given tables.
"""
