"""Operators that a training-data pipeline needs; nothing else in the package imports this subpackage."""
