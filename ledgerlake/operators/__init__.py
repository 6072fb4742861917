"""Ledger operators: pure functions from DataFrames to DataFrames. Dates are half-open; today is always a parameter."""
