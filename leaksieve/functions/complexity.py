"""How many character classes a string mixes."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column

# The four classes and the limits of the complexity filter.
CLASSES = ("[0-9]", "[A-Z]", "[a-z]", "[^a-zA-Z0-9]")
MIN_BYTES = 15
MIN_CLASSES = 3


def class_count(token: Column) -> Column:
    """Digits, upper case, lower case (all ASCII) and anything else; 0 to 4."""
    return reduce(add, (token.rlike(pattern).cast("int") for pattern in CLASSES))
