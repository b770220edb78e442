"""Small expression helpers shared by the other function modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it any number of times in ``body``.

    Catalyst has no let-binding: an expression that is mentioned twice inside a
    lambda is evaluated twice per element. A one-element ``transform`` binds it to
    a lambda variable instead.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def once(value: Column) -> Column:
    """``value`` as the output of a generator, for use in a ``select``.

    Filters and projections above copy the expression of an ordinary column into
    themselves and so repeat its work, also the filters that Spark adds under an
    explode. A generated column is computed once.
    """
    return F.explode(F.array(value))


def null_if_empty(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def is_blank(text: Column) -> Column:
    """True when the text has nothing but white space."""
    return ~text.rlike(r"\S")
