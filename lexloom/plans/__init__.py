"""Registered queries over the tables and their DuckDB SQL."""
