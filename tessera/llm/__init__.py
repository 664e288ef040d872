"""Operators for preparing language-model training data.

Every operator is a function from DataFrames to DataFrames. Text-heavy inner
loops run in ``mapInArrow`` over Spark's partitions; joins, grouping, sorting
and iteration are Spark's.
"""
