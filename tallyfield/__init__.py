"""Clustering statistics of large point sets on Spark."""
