"""Ordered chunk streams."""
