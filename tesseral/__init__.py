"""Relation-aware, schema-first queries that compile to Spark DataFrames."""
