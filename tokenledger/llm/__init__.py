"""Operators for large-scale training-data pipelines.

Each module holds one operator with a general interface; ``registry`` holds the
thin named queries and their DuckDB SQL. Nothing else in the library imports
this subpackage.
"""
