"""Callweave: call and dependency graphs of source trees on Spark."""
