"""Operators on fragments, bags, pairs and groups."""
