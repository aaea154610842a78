"""Scalar cleaning / labelling expressions.

All are built-in Catalyst expressions, so they stay inside whole-stage codegen.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from lapse.config import FEATURE_LABELS
from lapse.functions.dates import as_col

UNKNOWN = "Unknown"
UNKNOWN_INVALID = "Unknown/Invalid"
OTHER = "Other"


def clean_age(c, min_valid: int = 0, max_valid: int = 100) -> Column:
    """null / below min / above max -> 'Unknown/Invalid', else integer text."""
    col = as_col(c)
    return F.when(
        col.isNotNull() & (col >= F.lit(min_valid)) & (col <= F.lit(max_valid)),
        col.cast("long").cast("string"),
    ).otherwise(F.lit(UNKNOWN_INVALID))


def code_text(c) -> Column:
    """numeric code -> integer text; null (or the -1 sentinel) -> 'Unknown'."""
    col = as_col(c)
    as_int = col.cast("long")
    return F.when(as_int.isNull() | (as_int == F.lit(-1)), F.lit(UNKNOWN)).otherwise(as_int.cast("string"))


def fill(c, value) -> Column:
    """null -> constant."""
    return F.coalesce(as_col(c), F.lit(value))


def direction(c) -> Column:
    """sign of a contribution as the label 'High' (raises risk) or 'Low'."""
    return F.when(as_col(c) > 0, F.lit("High")).otherwise(F.lit("Low"))


def driver_text(feature, contribution) -> Column:
    """'name (High|Low)' text of one driver."""
    return F.format_string("%s (%s)", as_col(feature), direction(contribution))


def feature_label(c) -> Column:
    """F8: feature name -> display label, falling back to the name itself."""
    mapping = F.create_map(*[F.lit(x) for x in chain.from_iterable(FEATURE_LABELS.items())])
    col = as_col(c)
    return F.coalesce(F.try_element_at(mapping, col), col)


def retention_score(p) -> Column:
    """(1 - p) * 100."""
    return (F.lit(1.0) - as_col(p)) * F.lit(100.0)
