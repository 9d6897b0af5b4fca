"""Operators over DataFrames: statistics, training, scoring, design, diagnostics, plot data."""
