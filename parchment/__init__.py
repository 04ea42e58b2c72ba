"""Document analytics as DataFrame-in, DataFrame-out PySpark operators."""
