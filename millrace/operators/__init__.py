"""Operators: pure functions from DataFrames to DataFrames.

Plans return what would change; writers in ``millrace.sources.sinks`` apply it.
Moments are parameters, nothing reads a clock.
"""
