"""Structured Streaming over source trees."""
