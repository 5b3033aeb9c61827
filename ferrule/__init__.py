"""Composition analytics on Spark."""
