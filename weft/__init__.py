"""A Spark-first engine for typed, nested, permission-aware queries over linked records."""
