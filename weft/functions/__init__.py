"""The registry of scalar functions."""
