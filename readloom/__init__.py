"""Keyed sequencing-read analytics on Spark."""
