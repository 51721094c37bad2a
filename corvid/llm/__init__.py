"""Operators of a training-data pipeline.  Nothing outside this subpackage imports it."""
