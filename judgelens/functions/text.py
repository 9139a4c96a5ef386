"""Text normalisation and token sets, from code-generated built-ins only.

No higher-order lambdas are used: they would take the projection out of
whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from judgelens.constants import DIGIT_RUN, NON_WORD_RUN, WHITESPACE_RUN


def as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def normalize_query(value: Column | str) -> Column:
    """Grouping key of a query: white space collapsed, trimmed, lower case."""
    text = F.coalesce(as_column(value), F.lit(""))
    return F.lower(F.trim(F.regexp_replace(text, WHITESPACE_RUN, " ")))


def normalize_text(value: Column | str) -> Column:
    """Matching form of a text: lower-case letters and numbers, single spaces."""
    lowered = F.lower(F.coalesce(as_column(value), F.lit("")))
    return F.trim(F.regexp_replace(lowered, NON_WORD_RUN, " "))


def tokens(normalized: Column | str) -> Column:
    """Tokens of an already normalised text, repeats kept; empty text has none."""
    return F.array_remove(F.split(as_column(normalized), " "), "")


def digit_chunks(normalized: Column | str) -> Column:
    """Distinct runs of ASCII digits in a normalised text."""
    return F.array_distinct(F.regexp_extract_all(as_column(normalized), F.lit(DIGIT_RUN), F.lit(0)))


def shared_count(left: Column | str, right: Column | str) -> Column:
    """Number of distinct elements two arrays have in common."""
    return F.size(F.array_intersect(as_column(left), as_column(right)))


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """numerator / denominator, 0.0 where there is nothing to divide by."""
    return F.coalesce(F.try_divide(numerator.cast("double"), denominator.cast("double")), F.lit(0.0))


def ratio_or_null(numerator: Column, denominator: Column) -> Column:
    """numerator / denominator, null where the denominator is zero."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def is_blank(value: Column | str) -> Column:
    """Null, empty or spaces only, before any normalisation."""
    return F.length(F.trim(F.coalesce(as_column(value), F.lit("")))) == 0
