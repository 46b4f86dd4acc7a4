"""Cohort, endpoint, covariate, summary and model operators on DataFrames."""
