"""Registered queries over the driver's tables, and the same queries as DuckDB SQL."""
