"""Logical plans from facts to edges."""
