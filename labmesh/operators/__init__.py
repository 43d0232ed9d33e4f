"""Reusable relational operators: joins, ordering, runs, timelines."""
