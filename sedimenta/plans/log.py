"""The log's schema and range bounds."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: One row is one write: (seq, ord) orders all writes, a tombstone deletes its key.
LOG_SCHEMA = T.StructType(
    [
        T.StructField("key", T.BinaryType(), False),
        T.StructField("value", T.BinaryType(), True),
        T.StructField("is_tombstone", T.BooleanType(), False),
        T.StructField("seq", T.LongType(), False),
        T.StructField("ord", T.IntegerType(), False),
    ]
)


@dataclass(frozen=True)
class Bound:
    """One end of a key range."""

    kind: str = "unbounded"
    key: Any = None

    @classmethod
    def included(cls, key) -> Bound:
        return cls("included", key)

    @classmethod
    def excluded(cls, key) -> Bound:
        return cls("excluded", key)


UNBOUNDED = Bound()


def in_range(key: Column, lower: Bound = UNBOUNDED, upper: Bound = UNBOUNDED) -> Column | None:
    """The predicate of a range; None where both ends are open. Plain comparisons, so that it reaches the scan."""
    out = None
    for bound, closed, open_ in ((lower, "__ge__", "__gt__"), (upper, "__le__", "__lt__")):
        if bound.kind != "unbounded":
            test = getattr(key, closed if bound.kind == "included" else open_)(F.lit(bound.key))
            out = test if out is None else out & test
    return out
