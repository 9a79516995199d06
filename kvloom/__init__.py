"""Keyed-state analytics on Spark."""
