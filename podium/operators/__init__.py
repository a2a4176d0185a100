"""Operators on DataFrames: gains, totals, boards, snapshots, comparison."""
