"""Pipelines: their types, their compiler, and how they become DataFrames."""
