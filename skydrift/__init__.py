"""Drift analytics on Spark: compare two views of the same records.

Every operator takes and returns DataFrames. Nothing here collects data that
grows with its input; see ``functions.order`` for how global orders, ranks and
exact percentiles are computed without a single-task sort.
"""

__version__ = "0.1.0"
