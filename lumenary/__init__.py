"""Opportunity analytics as declarative Spark plans."""
