"""Scalar functions, casts and aggregates with streaming-SQL semantics."""
