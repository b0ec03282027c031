"""Column functions on option values written as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DELETE = "__delete_field__"


def unquoted(value: Column) -> Column:
    """Drop the outer double quotes and the single quotes inside them."""
    without_double = F.regexp_replace(value, r'^"(.*)"$', "$1")
    return F.regexp_replace(without_double, r"^'(.*)'$", "$1")


def value_kind(value: Column, plain: Column) -> Column:
    """flag, boolean, integer, decimal or text; ``plain`` is the value without quotes."""
    return (
        F.when(value.isNull(), "flag")
        .when(value.startswith('"'), "text")
        .when(plain.isin("True", "False"), "boolean")
        .when(plain.rlike(r"^[+-]?\d+$"), "integer")
        .when(plain.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), "decimal")
        .otherwise("text")
    )
