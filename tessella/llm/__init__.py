"""Operators of a training-data pipeline. Nothing outside this subpackage imports it, `__spark_entry__.py` excepted."""
