"""Queries in the client's form, over the client's own tables."""
