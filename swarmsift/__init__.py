"""swarmsift — Spark-native cleaning, discretizing, tree scoring and
population-based feature-subset search.

Every public function takes and returns DataFrames; nothing here creates a
session or runs at import time.
"""

__version__ = "0.1.0"
