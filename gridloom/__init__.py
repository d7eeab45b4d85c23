"""Gridded-field, ensemble and corpus analytics as Spark DataFrame jobs."""
