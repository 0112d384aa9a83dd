"""Operators for training-data pipelines, their queries and the SQL that checks them."""
