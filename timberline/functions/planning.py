"""Hints that shape the plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def evaluated_once(flag: Column) -> Column:
    """The same boolean, in a form no filter is pushed through.

    Catalyst moves a filter below a projection by copying the projected expressions into
    it. On a chain of regular expressions every level of copying doubles the work. A
    projection that contains a non-deterministic expression is left in place; the partition
    id is one that is a constant at run time.
    """
    return flag & (F.spark_partition_id() >= 0)


def computed_once(value: Column) -> Column:
    """The same value, in a form that is not copied into the expressions that use it."""
    return F.when(F.spark_partition_id() >= 0, value)


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once per row, however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)
