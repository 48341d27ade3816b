"""Point-in-time signal scoring and walk-forward analytics on Spark DataFrames.

Every operator takes DataFrames (plus plain parameters) and returns a
DataFrame, for all entities and all as-of dates in one plan.
"""
