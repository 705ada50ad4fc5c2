"""Operators of the knowledge base: each takes DataFrames and returns one."""
