"""A Spark-native analytics library for scored customer books.

A *book* is one table with an ID, a yes/no outcome, a model score, an amount and
some segment columns.  Every operator takes and returns DataFrames and names the
columns it reads as parameters.
"""
