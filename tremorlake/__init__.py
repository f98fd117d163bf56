"""Condition-monitoring analytics on Spark."""
