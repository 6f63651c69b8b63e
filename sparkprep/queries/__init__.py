"""Registered queries of the tabular operators, and the same in DuckDB SQL."""
