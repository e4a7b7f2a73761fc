"""Catch-up pages, live changes per session, and result changes."""
