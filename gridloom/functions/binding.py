"""Binding an expression to a name inside a larger one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it in ``body``.

    Long parsing expressions stay linear in size this way: inlined by the optimiser instead, each
    use of a part would repeat all that it is made of.
    """
    return F.transform(F.array(value), body)[0]
