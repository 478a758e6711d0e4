"""Uncertainty-aware tabular regression and its diagnostics as PySpark DataFrame operators."""
