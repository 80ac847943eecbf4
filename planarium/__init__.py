"""Spark-first analytics for indoor spatial data and the corpora around it."""
