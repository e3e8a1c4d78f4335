"""Dense and sparse vectors as built-in expressions; indexes begin at 0 and exact zeros are not stored."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sparse(dense: Column) -> Column:
    """A struct of idx, val and length of an array of numbers; a null array gives null."""
    pairs = F.filter(F.transform(dense, lambda v, i: F.struct(i.alias("i"), v.alias("v"))), lambda p: p.v != 0)
    return F.when(dense.isNotNull(), F.struct(F.transform(pairs, lambda p: p.i).alias("idx"), F.transform(pairs, lambda p: p.v).alias("val"), F.size(dense).alias("length")))


def dense(vector: Column) -> Column:
    """The array behind ``sparse``; an index that is repeated is an error."""
    values = F.map_from_entries(F.zip_with(vector.idx, vector.val, lambda i, v: F.struct(i, v)))
    places = F.filter(F.sequence(F.lit(0), F.greatest(vector.length - 1, F.lit(0))), lambda i: i < vector.length)
    return F.when(vector.isNotNull(), F.transform(places, lambda i: F.coalesce(F.try_element_at(values, i), F.lit(0.0).cast("float"))))
