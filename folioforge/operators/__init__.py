"""Operators on DataFrames: pages, rules, merging, reports, catalogue."""
