"""Regime analysis of ordered numeric series, and preparation of training text, as Spark jobs."""
