"""Operators over DataFrames: joins, graphs, folds, decisions, constraints, versions, matching."""
