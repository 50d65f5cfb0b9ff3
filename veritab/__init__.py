"""Verified analytics on Spark."""
