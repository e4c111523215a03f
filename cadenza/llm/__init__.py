"""Operators for preparing language-model training data, each over whole tables on Spark.

Nothing else in the library imports this subpackage. Every operator takes and
returns DataFrames; the contract queries that apply them are in ``queries``.
"""
