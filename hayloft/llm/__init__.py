"""Operators for preparing training data.

Nothing outside this package imports it; ``entries`` lists the registered
queries and their SQL for ``__spark_entry__``.
"""
