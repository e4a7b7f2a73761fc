"""Relational building blocks of the planner."""
