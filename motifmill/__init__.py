"""Approximate-motif analytics on Spark."""
