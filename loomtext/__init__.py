"""A PySpark engine for text evaluation and corpus preparation."""
