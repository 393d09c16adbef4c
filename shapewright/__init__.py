"""Structural schema inference on Spark."""
