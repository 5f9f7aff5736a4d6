"""Estimators: what Spark adds up is fitted in numpy, and what is fitted is applied in batches."""
