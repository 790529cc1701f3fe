"""Spark batch jobs for preparing, windowing and scoring time series, and for preparing text corpora."""
