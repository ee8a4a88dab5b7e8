"""Operators for preparing training data, one module each, and their queries.

Nothing outside this subpackage imports it; __spark_entry__.py adds its queries
where it is present.
"""
