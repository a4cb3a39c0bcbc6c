"""Data preparation, resampling, model selection and scoring on Spark DataFrames."""
