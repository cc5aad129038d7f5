"""Operators for large training-data pipelines.

Nothing else in the library imports this package; ``__spark_entry__`` adds its
queries only where it is present.
"""
