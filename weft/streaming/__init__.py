"""Structured Streaming: keyed state and entity changes."""
