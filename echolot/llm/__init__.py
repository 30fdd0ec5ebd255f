"""Operators for preparing language-model training data.

Nothing outside this folder imports it.  Every operator takes DataFrames and
returns a DataFrame; ``queries`` binds them to the tables of the test data.
"""
