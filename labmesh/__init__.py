"""Spark analytics for biomedical research networks.

Every public function takes DataFrames and parameters and returns a lazy
DataFrame. Times are never read from the clock: callers pass ``as_of``.
"""
