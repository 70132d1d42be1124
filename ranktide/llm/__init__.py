"""Operators for preparing text corpora on Spark.

Each module holds one operator with a general interface, the thin query that
applies it to the ``documents`` table and, where SQL can say the same, the SQL
to compare with.  ``registry`` gathers the queries.
"""
