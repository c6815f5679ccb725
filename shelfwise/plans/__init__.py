"""Operators put together: cleaning runs, queries from a description, reports."""
