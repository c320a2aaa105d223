"""Reuse of column expressions.

Building a large expression takes many calls into the JVM. Columns never change, so
functions that build them from column names alone build them once per application.
"""

from __future__ import annotations

from functools import wraps

from pyspark import SparkContext


def reused(build):
    """Cache what ``build`` returns for plain arguments (names, numbers, nothing)."""
    cache: dict = {}

    @wraps(build)
    def wrapper(*args, **kwargs):
        plain = (*args, *kwargs.values())
        if not all(isinstance(value, (str, int, float, bool, type(None))) for value in plain):
            return build(*args, **kwargs)
        context = SparkContext._active_spark_context
        key = (context.applicationId if context else None, args, tuple(kwargs.items()))
        if key not in cache:
            cache[key] = build(*args, **kwargs)
        return cache[key]

    return wrapper
