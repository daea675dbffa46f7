"""Reuse of column expressions.

Building a large expression from Python costs a call into the JVM per operator. Expressions over fixed column names
never change, so each is built once per JVM.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark import SparkContext
from pyspark.sql import Column


def built_once(build: Callable[..., Column]) -> Callable[..., Column]:
    """For functions of plain values such as column names."""
    kept: dict[tuple, tuple[object, Column]] = {}

    @functools.wraps(build)
    def get(*args):
        gateway = SparkContext._gateway
        found = kept.get(args)
        if found is None or found[0] is not gateway:
            found = (gateway, build(*args))
            kept[args] = found
        return found[1]

    return get
