"""A PySpark engine for evolving memory graphs."""
