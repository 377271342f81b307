"""Multiparameter persistence and corpus preparation on Spark."""
