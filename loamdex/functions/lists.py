"""Intersection and union of array Columns, as posting lists need them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def list_intersect(a: Column, b: Column) -> Column:
    """The elements of a that b holds too, in a's order and with a's repeats; null elements go, a null list gives null."""
    return F.filter(a, lambda x: F.array_contains(b, x))


def list_union(a: Column, b: Column) -> Column:
    """The distinct elements of both, those of a first; a null list gives null."""
    return F.array_union(a, b)
