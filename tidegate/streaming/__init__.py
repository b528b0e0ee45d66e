"""Streaming forms of the operators, and sessions of running pipelines."""
