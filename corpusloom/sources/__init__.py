"""Readers that give tables of a declared schema."""
