"""Operators: scoring, aggregation, reports, generators, signals."""
