"""Relational operators: each takes DataFrames and returns lazy DataFrames unless its docstring says it runs jobs."""
