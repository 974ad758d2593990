"""Disclosure analytics as Spark DataFrame jobs."""
