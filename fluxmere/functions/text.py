"""Scalar helpers that the shipped queries use, as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def split_blank(c: Column | str) -> Column:
    """Split at every single blank; empty parts stay."""
    return F.split(c, " ")


def split_space(c: Column | str) -> Column:
    """Split at every white space character; empty parts stay."""
    return F.split(c, r"\s")


def is_comment(c: Column) -> Column:
    return c.startswith("#")


def parse_int(c: Column) -> Column:
    """Whole number of a text; anything else fails under ANSI mode, as a strict parser does."""
    return c.cast("int")


def round_half_even(c: Column) -> Column:
    return F.bround(c).cast("long")


def after_last(c: Column | str, mark: str) -> Column:
    return F.substring_index(c, mark, -1)


def log1p_bucket(c: Column, keep: int = 10, gap: int = 65536) -> Column:
    """Priority of a label: its own place below ``keep``, then one place per power of e."""
    return F.lit(gap) * F.when(c < keep, c).otherwise(keep + F.bround(F.log(1 + c)).cast("int"))
