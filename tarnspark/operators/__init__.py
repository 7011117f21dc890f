"""Operators on DataFrames: request parsing, nearest neighbours, cell indexes, decisions, profiling."""
