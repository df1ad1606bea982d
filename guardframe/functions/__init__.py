"""Scalar building blocks: regex dialect, byte cuts, SQL functions."""
