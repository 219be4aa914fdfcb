"""Candidate-agreement analytics on Spark: declarative plans over DataFrames."""
