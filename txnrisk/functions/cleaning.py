"""Tolerant casts and code maps."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Channel codes and their names.
CHANNELS = {0: "Mobile", 1: "POS", 2: "ATM", 3: "Web"}

# The spellings each KYC map accepts as verified.
KYC_YES = {
    "any": ("yes", "y", "true", "1"),
    "title": ("Yes",),
    "lower": ("yes", "y", "True", "true"),
}


# The spellings of a time that are accepted besides ISO.
TIME_PATTERNS = ("y/M/d H:m[:s]", "M/d/y H:m[:s]", "MMM d y H:m[:s]", "d MMM y H:m[:s]", "y/M/d", "M/d/y")
_OFFSET = r"(?<=\d:\d{2})(:\d{2})?(\.\d+)?\s*(Z|UTC|[+-]\d{2}:?\d{2})$"


def known(col: Column) -> Column:
    """The number as a double; NaN counts as missing, like null."""
    value = col.cast("double")
    return F.when(~F.isnan(value), value)


def to_double(col: Column) -> Column:
    """Text or number to double; unparsable text and NaN become null."""
    value = col.try_cast("double")
    return F.when(~F.isnan(value), value)


def number_or_zero(col: Column) -> Column:
    return F.coalesce(to_double(col), F.lit(0.0))


def int_or_zero(col: Column) -> Column:
    """Integer text or number to long; ``'12.5'``, blanks and words become 0."""
    return F.coalesce(col.try_cast("long"), F.lit(0))


def to_timestamp(col: Column) -> Column:
    """Parse a timestamp; an unparsable value becomes null.

    Text with an offset gives the time as written, not shifted, since hours and weekdays are those of the place.
    """
    text = F.regexp_replace(F.trim(col.cast("string")), _OFFSET, "$1$2")
    parsed = F.coalesce(text.try_cast("timestamp"), *[F.try_to_timestamp(text, F.lit(p)) for p in TIME_PATTERNS])
    # The type is known when the plan is made, so a typed column is taken as it is.
    return F.when(F.typeof(col).isin("string", "void"), parsed).otherwise(col.try_cast("timestamp"))


def kyc_flag(col: Column, mode: str = "any") -> Column:
    """1 where the customer is verified, else 0.

    ``any`` accepts every spelling regardless of case, and any number that is not 0 once truncated; ``title`` only ``Yes``; ``lower`` only
    the lower-case words; ``numeric`` truncates a number to an integer (``'1.7'`` gives 1, words 0).
    """
    if mode == "numeric":
        return F.coalesce(to_double(col).try_cast("int"), F.lit(0))
    text = col.cast("string")
    if mode == "any":
        text = F.lower(F.trim(text))
    elif mode not in KYC_YES:
        raise ValueError(f"unknown kyc mode: {mode}")
    yes = text.isin(*KYC_YES[mode])
    if mode == "any":
        yes = yes | F.coalesce(F.abs(to_double(text)) >= 1, F.lit(False))
    return F.when(yes, 1).otherwise(0)


def channel_name(col: Column, default: str = "Mobile") -> Column:
    """Channel code (number or numeric text) to name; any other value to ``default``."""
    code = to_double(col)
    named = F.coalesce(*[F.when(code == value, F.lit(name)) for value, name in CHANNELS.items()])
    return F.coalesce(named, F.lit(default))
