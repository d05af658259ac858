"""Batch operators over DataFrames. Each is a plan; none collects rows."""
