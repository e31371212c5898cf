"""Queries of the operators over derived tables, each module with DuckDB SQL for its queries."""
