"""Trend and traffic analytics as Spark DataFrame jobs."""
