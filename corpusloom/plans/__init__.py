"""Schemas and plans made of several operators."""
